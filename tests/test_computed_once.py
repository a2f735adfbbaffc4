"""Costly inputs are computed once by what is asked of them."""

from pyspark.sql import functions as F

from adatlas.operators import manifest as M
from adatlas.sources.stored_library import Library


def test_a_save_computes_advertisers_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(b):
        seen.add(1)
        return b

    rows = spark.createDataFrame([(1, "Acme", "Vino"), (1, "Bo", ""), (2, "Bo", None)], "issue_id long, brand string, sector string").withColumn("confidence", F.lit(0.5))
    meta = spark.createDataFrame([(1, "R", "12", 0.0), (2, "R", "12", 0.0), (3, "R", "12", 0.0)], "issue_id long, titulo string, paginas string, coste_usd double")
    ads = rows.withColumn("brand", counted.asNondeterministic()("brand")).where(F.length("brand") > 0)
    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.save(meta, ads)
    assert seen.value == 3
    assert {(r.issue_id, r.n_anunciantes) for r in lib.read("issues").collect()} == {(1, 2), (2, 1), (3, 0)}


def test_manifests_go_through_python_in_columns(spark):
    """Falling numbers of issues that lie in several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = [(i, k, f"http://a/page-{9 - k}.jpg", None if k == 3 else f"h{k % 4}", 1) for i in (1, 2) for k in range(1, 8)]
        images = spark.createDataFrame(rows, "issue_id long, idx int, url string, sha256 string, bytes long")
        got = {(r.issue_id, r.idx): (r.page_number, r.status, r.duplicate_of, r.source_url) for r in M.numbered(images).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i in (1, 2):
        assert [got[i, k][:3] for k in range(1, 8)] == [(8, "ok", None), (7, "ok", None), (6, "failed", None), (5, "ok", None), (4, "duplicate", 8), (3, "duplicate", 7), (2, "ok", None)]
        assert got[i, 1][3] == "http://a/page-8.jpg"
