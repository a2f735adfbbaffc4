import json

from pyspark.sql import functions as F

from adatlas.sources import sinks as K
from adatlas.sources import tables as S
from adatlas.sources.stored_library import Library
from adatlas.streaming.answers import follow


def test_pages_and_stored_work(spark, tmp_path):
    rows = [("i", 3, "", "short", "read by machine"), ("i", 1, "", "x" * 31, "ocr"), ("i", 2, "", None, None)]
    spark.createDataFrame(rows, S.PAGES).write.parquet(str(tmp_path / "p"))
    assert [(r.pos, r.page_no, r.text) for r in S.pages(spark, str(tmp_path / "p")).orderBy("pos").collect()] == [(0, 1, "x" * 31), (1, 2, ""), (2, 3, "read by machine")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text('{"signature":"a","version":1}\nbroken\n{"signature":"b","version":9}\n')
    assert [r.signature for r in S.stored(spark, str(tmp_path / "s"), "signature STRING").collect()] == ["a"]


def test_replay_reads_lists_and_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"brand": "Roca", "pages": [1], "confidence": 0.5}]))
    (tmp_path / "b.json").write_text(json.dumps({"meta": {}, "anunciantes": [{"brand": "Simon"}, {"brand": "Cos"}]}))
    assert sorted(r.brand for r in S.replay(spark, str(tmp_path)).collect()) == ["Cos", "Roca", "Simon"]


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [r.path.rsplit("/", 1)[1] for r in S.pdf_files(spark, str(tmp_path)).collect()] == ["a.bin"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img/x.jpg").write_bytes(b"not an image")
    expected = spark.createDataFrame([("i", 1, f"{tmp_path}/img/x.jpg"), ("i", 2, f"{tmp_path}/img/none.jpg")], "issue_id string, page_no int, image_path string")
    assert {(r.page_no, r.unreadable, r.low_resolution) for r in S.image_files(spark, str(tmp_path / "img"), expected).collect()} == {(1, True, False), (2, True, False)}


def test_exports(spark, tmp_path):
    ads = spark.createDataFrame([("i", 1, "Roca", [3, 8], "", "", "", "", "", 0.125, "ia", "n", ["short"]), ("j", 1, "Simon", None, "", "", "", "", None, 0.5, "ia", "n", None)], "issue_id string, adv_no int, brand string, pages array<int>, sector string, ad_size string, website string, email string, phone string, confidence double, method string, notes string, review_reasons array<string>")
    whole = spark.sql("SELECT 'i' AS issue_id, 'T' AS titulo, '1' AS numero, 'u' AS url, 'ia' AS modo, timestamp'2026-01-02 03:04:00' AS fecha, 8 AS paginas, 'parcial' AS estado, '' AS estado_analisis, array(array(1)) AS pliegos_fallidos, array(array(2)) AS pliegos_parciales, array(1) AS paginas_no_analizadas, CAST(array() AS array<int>) AS paginas_parciales, 'job' AS job_id, 1.5D AS coste_usd")
    K.write_csv(ads, whole, str(tmp_path / "csv"))
    row = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv")).where("issue_id = 'i'").first()
    assert list(row.asDict()) == [*K.CSV_COLUMNS.values(), "issue_id"] and len(K.CSV_COLUMNS) == 12
    assert (row.Marca, row.Paginas, row.Confianza, row["Estado analisis"], row.Cobertura) == ("Roca", "3, 8", "12%", "parcial", "no analizadas: 1")
    out, lib = str(tmp_path / "all"), str(tmp_path / "lib")
    assert K.export_results(ads, whole, out, "e1", 0.3, lib) and not K.export_results(ads, whole, out, "e1", 0.3, lib)
    assert [r.Marca for r in spark.read.parquet(f"{out}/e1/csv").collect()] == ["Simon"] and spark.read.parquet(f"{out}/e1/summary").count() == 12
    stored = Library(spark, lib)
    assert stored.read("issues").first().coste_usd == 1.5 and [r.brand for r in stored.read("advertisers").collect()] == ["Simon"]
    meta = spark.createDataFrame([("i", "T"), ("k", "U")], ["issue_id", "titulo"])
    K.write_json(ads, meta, str(tmp_path / "json"))
    back = {r.issue_id: [a.brand for a in r.anunciantes] for r in spark.read.json(str(tmp_path / "json")).collect()}
    assert back == {"i": ["Roca"], "k": []}


def test_publication_is_whole_or_nothing_and_once(spark, tmp_path):
    root, good = str(tmp_path / "out"), spark.range(3)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    try:
        K.publish(spark, {"a": good, "b": bad}, root, "e1")
        raise AssertionError("published")
    except Exception as e:
        assert "no" in str(e)
    assert not (tmp_path / "out/e1").exists()
    assert K.publish(spark, {"a": good}, root, "e1") and not K.publish(spark, {"a": good}, root, "e1")
    assert spark.read.parquet(f"{root}/e1/a").count() == 3
    done = spark.createDataFrame([("e1",)], ["export_id"])
    assert [r.export_id for r in K.new_exports(spark.createDataFrame([("e1",), ("e2",), ("e2",)], ["export_id"]), done).collect()] == ["e2"]


def test_answers_as_a_stream(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def send(name, spread, brand):
        (source / name).write_text(json.dumps({"issue_id": "i", "spread_no": spread, "page_nums": [1], "raw": json.dumps({"anuncios": [{"marca": brand, "confianza": 1}]})}) + "\n")

    send("a.json", 0, "Roca")
    for _ in range(2):
        follow(spark, str(source), target, str(tmp_path / "ck")).awaitTermination()
    send("b.json", 1, "Simon")
    send("c.json", 0, "Roca again")  # a spread that came before
    follow(spark, str(source), target, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.brand for r in spark.read.parquet(f"{target}/entries").collect()) == ["Roca", "Simon"]
    assert spark.read.parquet(f"{target}/answers").count() == 2


def test_a_table_of_results_is_replayed_as_their_files_are(spark, tmp_path):
    """Results by the hundred are no folders by the hundred."""
    texts = ['[{"brand":"a","pages":[1]}]', '{"anunciantes":[{"brand":"b","confidence":0.5},\n{"brand":"c"}]}', '{"advertisers":[{"brand":"d"}]}', '{"meta":{}}', "broken"] * 60
    for k, t in enumerate(texts[:5]):
        (tmp_path / f"{k}.json").write_text(t)
    rows = lambda df: sorted((r["at"], r.brand, str(r.pages), str(r.confidence)) for r in df.collect())
    table = spark.createDataFrame(list(enumerate(texts)), "issue_id int, value string")
    got = S.replayed(table, "issue_id")
    assert rows(got.where("issue_id < 5")) == rows(S.replay(spark, str(tmp_path))) and got.count() == 4 * 60
