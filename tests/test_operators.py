import json
import random

import pytest
from pyspark.sql import functions as F

from adatlas.operators import answers as A
from adatlas.operators import detect as D
from adatlas.operators import library as L
from adatlas.operators import manifest as M
from adatlas.operators import quality as Q
from adatlas.operators import report as R
from adatlas.operators import review as V

AD = "issue_id string, key string, brand string, pages array<int>, website string, email string, phone string, sector string, ad_size string, confidence double, method string, notes string"


def ad(brand, pages, confidence=0.65, website="", issue="i"):
    return (issue, brand.lower(), brand, pages, website, "", "", "", "", confidence, "heuristica", "n")


def test_detection_takes_the_last_mention_and_page_level_contacts(spark):
    pages = spark.createDataFrame([("i", 0, 5, "Publicidad www.roca.com tel 912345678"), ("i", 1, 6, "roca.es x@uno.org"), ("i", 2, 6, "miproarquitectura.es"), ("i", 3, 7, None)], "issue_id string, pos int, page_no int, text string")
    got = {r.key: r for r in D.brands(D.mentions(pages)).collect()}
    assert set(got) == {"roca", "uno"}
    roca = got["roca"]
    assert (roca.brand, roca.website, roca.pages, roca.phone, roca.email, roca.confidence, roca.notes) == ("Roca", "roca.es", [5, 6], "912345678", "x@uno.org", 0.4, D.PLAIN_NOTE)


def folded(rows):
    """The plain greedy fold over all brands of an issue."""
    kept = []
    for r in sorted(rows, key=lambda r: (-r["confidence"], r["brand"])):
        for k in kept:
            a, b = r["brand"].lower(), k["brand"].lower()
            if set(r["pages"]) & set(k["pages"]) and (a.startswith(b) or b.startswith(a)):
                if len(r["brand"]) < len(k["brand"]):
                    k["brand"], k["website"] = r["brand"], r["website"] or k["website"]
                k["pages"] = sorted({*k["pages"], *r["pages"]})
                k["website"] = k["website"] or r["website"]
                k["confidence"] = max(k["confidence"], r["confidence"])
                k["notes"] += D.MERGED_NOTE
                break
        else:
            kept.append(dict(r))
    return kept


def test_consolidation_equals_the_fold_over_whole_issues(spark):
    r = random.Random(6)
    rows = []
    for issue in range(12):
        names = {"".join(r.choice("Ab") for _ in range(r.randint(1, 5))) for _ in range(12)}
        names = list({n.lower(): n for n in names}.values())
        rows += [ad(n, sorted(r.sample(range(1, 5), r.randint(1, 2))), r.choice([0.4, 0.65]), r.choice(["", n + ".es"]), f"i{issue}") for n in names]
    frame = spark.createDataFrame(rows, AD)
    got = sorted((x.issue_id, x.brand, x.pages, x.website, x.confidence, x.notes) for x in D.consolidated(frame).collect())
    names = AD.replace("array<int>", "array").split(", ")
    wanted = []
    for issue in {x[0] for x in rows}:
        wanted += [(issue, k["brand"], k["pages"], k["website"], k["confidence"], k["notes"]) for k in folded([dict(zip([n.split()[0] for n in names], x)) for x in rows if x[0] == issue])]
    assert got == sorted(wanted)
    far = spark.createDataFrame([ad("Simon", [1]), ad("Simonelectric", [2])], AD)
    assert D.consolidated(far).count() == 2


def test_library(spark):
    rows = [("1", "Roca", "Alimentacion / Quesos", 1), ("1", "Simon", "Alimentacion / Carnes", 2), ("1", "Cosentino", "Bebidas / vinos", 3), ("2", "ROCA, S.A.", "", 4), ("2", "Simon", None, 5), ("2", "Porcelanosa", "", 6)]
    ads = L.stored_advertisers(spark.createDataFrame([(*r, None) for r in rows], "issue_id string, brand string, sector string, id int, confidence double"))
    last = L.latest(ads, ["brand", "id"])
    found = L.compared(spark.createDataFrame([("1", "2")], ["issue_a", "issue_b"]), last)
    assert {(r.status, r.brand) for r in found.collect()} == {("nuevo", "Porcelanosa"), ("perdido", "Cosentino"), ("recurrente", "ROCA, S.A."), ("recurrente", "Simon")}
    assert abs(L.fidelity(found).first().fidelidad - 2 / 3) < 1e-12
    assert {(r.sec, r.n) for r in L.share_of_voice(ads.where("issue_id = '1'")).collect()} == {("Alimentacion", 2), ("Bebidas", 1)}
    issues = spark.createDataFrame([("1", "T", "2024-01-01", 3), ("2", "T", "2024-01-01", 5), ("3", None, "2024-01-01", None)], "issue_id string, titulo string, fecha string, n_anunciantes int")
    assert L.history(ads, issues, F.lit("Roca")).count() == 2
    assert {(r.issue_id, r.prev, r.delta) for r in L.with_previous(issues).collect()} == {("2", None, "·"), ("1", 5, "-2"), ("3", None, "·")}
    assert L.without_issues(ads, spark.createDataFrame([("1",), ("2",)], ["issue_id"])).count() == 0
    meta = spark.createDataFrame([("1", "12", "0", None), ("9", "x", "1.5", "T")], "issue_id string, paginas string, coste_usd string, titulo string")
    assert {(r.issue_id, r.paginas, r.coste_usd, r.titulo, r.n_anunciantes) for r in L.stored_issues(meta, ads).collect()} == {("1", 12, None, "Revista", 3), ("9", None, 1.5, "T", 0)}


def test_review(spark):
    rows = [("i", "***", 0.9), ("i", "Roca", 0.9), ("i", "Vista", 0.5), ("i", "Roca Bath", 0.8), ("i", "Solo", 0.9), ("i", "-.-", 0.9), ("j", "---", 0.9)]
    issues = spark.createDataFrame([("i", "Revista"), ("j", None)], "issue_id string, titulo string")
    got = {(r.issue_id, r.brand): r.review_reasons for r in V.flagged(spark.createDataFrame(rows, "issue_id string, brand string, confidence double"), issues).collect()}
    # a name of hyphens and dots alone is empty once compared, and so begins every other name of its issue
    assert got == {("i", "***"): ["short", "weird"], ("i", "Roca"): ["variant"], ("i", "Vista"): ["low_conf", "magazine"], ("i", "Roca Bath"): ["variant"], ("i", "Solo"): [], ("i", "-.-"): ["short", "variant"], ("j", "---"): ["short"]}


def test_titles_are_those_of_the_issue(spark):
    ads = spark.createDataFrame([(i, "Steel", 0.9) for i in "abc"], "issue_id string, brand string, confidence double")
    issues = spark.createDataFrame([("a", "Steel Magazine"), ("b", "Copper"), ("d", "Steel")], "issue_id string, titulo string")
    assert {r.issue_id: r.review_reasons for r in V.flagged(ads, issues).collect()} == {"a": ["magazine"], "b": [], "c": []}


def test_variants_against_all_pairs(spark):
    r = random.Random(8)
    rows = [(f"i{r.randint(0, 3)}", "".join(r.choice("ab-") for _ in range(r.randint(0, 5)))) for _ in range(120)]
    norm = lambda s: s.replace("-", "")
    got = sorted((x.issue_id, x.brand, x.is_variant) for x in V.with_variants(spark.createDataFrame(rows, "issue_id string, brand string")).collect())
    apart = lambda a, b: norm(a) != norm(b) and norm(b) and (norm(a).startswith(norm(b)) or norm(b).startswith(norm(a)))
    assert got == sorted((i, b, any(j == i and bool(apart(b, c)) for j, c in rows)) for i, b in rows)


def test_review_items_first_pages_and_confidence(spark):
    ads = spark.createDataFrame([("i", 1, "A", None, None, [4, 2], ["low_conf"]), ("i", 2, "B", "s", 0.5, None, None)], "issue_id string, adv_idx int, brand string, sector string, confidence double, pages array<int>, review_reasons array<string>")
    ads = ads.withColumns({c: F.lit(None).cast("string") for c in ("website", "email", "phone", "ad_size", "method")})
    rows = V.review_items(ads).orderBy("adv_idx").collect()
    assert [(x.sector, x.confidence, x.pages, x.review_flag, x.review_label) for x in rows] == [("", 0.0, [4, 2], "low_conf", "Confianza baja"), ("s", 0.5, [], "", "")]
    pages = spark.createDataFrame([("i", 4, "a.jpg"), ("i", 2, "")], "issue_id string, page_no int, image_path string")
    assert {x.adv_idx: x.image_path for x in V.first_page(ads, pages).collect()} == {1: "a.jpg", 2: None}
    assert V.confident(ads, 0.4).count() == 1 and V.confident(ads).count() == 2


def test_decisions(spark):
    ads = spark.createDataFrame([("i", k, f"b{k}", "", "", "", "", "") for k in (0, 1)], "issue_id string, adv_idx int, brand string, sector string, website string, email string, phone string, ad_size string")
    d = spark.createDataFrame([("i", 0, 1, "drop", None), ("i", 1, 1, "keep", " A "), ("i", 1, 2, "keep", None), ("i", 9, 1, "drop", None)], "issue_id string, adv_idx int, seq int, state string, brand string")
    d = d.withColumns({c: F.lit(None).cast("string") for c in ("sector", "website", "email", "phone", "ad_size")})
    assert [(r.adv_idx, r.brand) for r in V.decided(ads, d).collect()] == [(1, "A")]
    assert tuple(V.review_counts(ads, d).first()) == ("i", 1, 1, 0)


RESPONSE = "issue_id string, spread_no int, page_nums array<int>, raw string"


@pytest.mark.parametrize(
    "raw,brands,valid",
    [
        ('{"anuncios":[{"marca":"Roca"},{"marca":"Simon"}]}', ["Roca", "Simon"], True),
        ('{"anuncios":[{"marca":"Roca","web":"roca.com"},{"marca":"Simon","web":"sim', ["Roca"], False),
        ('```json\n{"anuncios":[{"marca":"Roca"}]}\n```', ["Roca"], True),
        ("", [], False),
        ("no soy json", [], False),
        ('{"anuncios":[{"marca":"A {raro}","nota":"texto con } llave"}]}', ["A {raro}"], True),
        ('{ "anuncios" : [ ] }', [], True),
        ('[1]', [], False),
        ('{"anuncios":[{"marca":"A","x":{"marca":"B"}},{"marca":"C\\"}"},{"marca":"D', ["B", "A", 'C"}'], False),
        ('texto "{" {"marca":"A"} } {"marca":""} {"nada":1}', ["A"], False),
        (None, [], False),
    ],
)
def test_parsing(spark, raw, brands, valid):
    own = A.parsed(spark.createDataFrame([("i", 0, [1], raw)], RESPONSE))
    assert own.first().valid == valid
    assert [r.brand for r in A.validated(own).orderBy("item_idx").collect()] == brands


def test_validation(spark):
    items = [
        {"marca": "Ejemplo", "pagina": 1, "telefono": 912345678, "confianza": 0}, {"marca": " ", "confianza": 1}, 7, {"marca": "B", "pagina": "2", "confianza": "0.5"},
        {"marca": "C", "pagina": 9, "confianza": 0.5}, {"marca": "D", "confianza": True}, {"marca": "E", "confianza": 0.4, "web": None, "email": ["x"]},
    ]
    rows = A.validated(A.parsed(spark.createDataFrame([("i", 0, [1, 2], json.dumps({"anuncios": items}))], RESPONSE))).orderBy("item_idx").collect()
    assert [(r.brand, r.page_no, r.phone, r.confidence, r.reason, r.kept) for r in rows] == [
        ("Ejemplo", 1, "912345678", 0.0, None, True), (None, 1, "", 1.0, "marca invalida", False), (None, 1, "", 0.0, "registro no es objeto", False), ("B", 2, "", 0.5, None, True),
        ("C", 1, "", 0.5, "campos corregidos", True), ("D", 1, "", 0.0, "campos corregidos", True), ("E", 1, "", 0.4, "campos corregidos", True),
    ]


def test_cost_and_resume(spark):
    rates = spark.createDataFrame([("new", 2.0, 10.0, 2.5, 0.2), ("old", 3.0, 15.0, 3.75, 0.3)], ["model", *A.USAGE])
    use = spark.createDataFrame([("a", "unheard of", 1_000_000, 1_000_000, 1_000_000, 1_000_000, False), ("b", "old", 1_000_000, 1_000_000, 1_000_000, 1_000_000, True)], "issue_id string, model string, input long, output long, cache_write long, cache_read long, resumed boolean")
    assert {r.issue_id: (round(r.cost_usd, 6), round(r.new_usd, 6)) for r in A.usage_cost(use, rates, "new").collect()} == {"a": (14.7, 14.7), "b": (22.05, 0.0)}
    stored = spark.createDataFrame([("x", 2, True), ("y", 1, True), ("z", 1, False)], "signature string, version int, partial boolean")
    again, todo = A.resume(spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], ["signature"]), stored)
    assert {r.signature for r in again.collect()} == {"x", "z"} and {r.signature for r in todo.collect()} == {"y", "w"}
    # two issues with an equal spread: what one has stored is not the other's
    stored = spark.createDataFrame([(1, "x", 2, False), (2, "x", 1, True)], "issue_id int, signature string, version int, partial boolean")
    again, todo = A.resume(spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "issue_id int, signature string"), stored)
    assert [r.issue_id for r in again.collect()] == [1] and {r.issue_id for r in todo.collect()} == {2, 3}
    pages = spark.createDataFrame([("i", p, p) for p in range(1, 8)], "issue_id string, pos int, page_no int")
    assert [r.spread_no for r in A.spreads(pages).orderBy("pos").collect()] == [0, 1, 1, 2, 2, 3, 3]


def test_sources(spark):
    sources = spark.createDataFrame([("p", "pdf", None, None, True), ("d", "images", None, 3, False), ("n", "images", None, None, False), ("g", "images", None, None, False)], "issue_id string, kind string, viewer string, expected_pages int, local_pdf boolean")
    pages = spark.createDataFrame([("p", 1), ("p", 2), ("d", 1), ("d", 3), ("n", 1), ("g", 1), ("g", 3)], "issue_id string, page_no int")
    manifest = spark.createDataFrame([("d", 2, "failed"), ("g", 1, "ok"), ("g", 3, "ok")], "issue_id string, page_number int, status string")
    got = {r.issue_id: r for r in Q.checked_source(sources, pages, manifest).collect()}
    assert (got["p"].status, got["p"].expected_pages, got["p"].source_type) == ("lista", 2, "PDF local")
    assert (got["d"].status, got["d"].missing_pages, got["d"].failed_pages) == ("incompleta", [2], [2])
    assert (got["n"].status, got["n"].expected_pages, got["n"].completeness_known, len(got["n"].warnings)) == ("lista", None, False, 1)
    assert (got["g"].status, got["g"].expected_pages, got["g"].missing_pages) == ("incompleta", 3, [2])


def test_summary_metadata_and_coverage_texts(spark):
    ads = spark.createDataFrame([("i", "w", "", "1")], "issue_id string, website string, email string, phone string")
    meta = spark.sql("SELECT 'i' AS issue_id, 'T' AS titulo, CAST(NULL AS STRING) AS url, 'm' AS modo, timestamp'2026-01-02 03:04:00' AS fecha, 8 AS paginas, '' AS estado, 'parcial' AS estado_analisis, array(array(1, 2), array(4)) AS pliegos_fallidos, CAST(NULL AS array<array<int>>) AS pliegos_parciales, array(3, 4) AS paginas_no_analizadas, array(7) AS paginas_parciales")
    rows = R.summary_rows(ads, meta).orderBy("place").collect()
    assert [x.value for x in rows] == ["T", "—", "m", "02/01/2026 03:04", "8", "PARCIAL", "", "1", "1", "1", "1+2, 4"]
    assert meta.select(R.coverage_text()).first()[0] == "no analizadas: 3, 4; respuesta parcial: 7"
    sources = spark.createDataFrame([("PDF", "", 2, 2, "lista"), ("Lector", "Issuu", 3, None, "incompleta")], "source_type string, viewer string, obtained_pages int, expected_pages int, status string")
    assert [x[0] for x in sources.select(R.source_summary()).collect()] == ["PDF · 2/2 paginas · lista", "Lector (Issuu) · 3 paginas; total no publicado · incompleta"]
    runs = spark.createDataFrame([("a", "ia", 1.0, None, None, "m", 2, [[1]], [], 0, None, "parcial"), ("b", None, None, 1.0, 1.0, "", 0, None, None, 3, "x", "completo")], "issue_id string, modo string, cost_usd double, new_usd double, resumed_usd double, model string, resumed_spreads int, failed_spreads array<array<int>>, partial_spreads array<array<int>>, n_invalid int, fallback_reason string, estado string")
    got = {x.issue_id: x for x in R.run_metadata(runs).collect()}
    assert tuple(got["a"])[1:] == ("IA (analisis visual)", 1.0, 1.0, 0.0, "m", 2, [[1]], None, None, None, None, "parcial")
    assert tuple(got["b"])[1:] == ("Heuristica (modo gratis)", None, None, None, None, None, None, None, 3, True, "x", "completo")


def test_library_scans(spark):
    issues = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")], "issue_id long, fecha string")
    assert [x.issue_id for x in L.listed_issues(issues).collect()] == [3, 2, 1] and L.issue(issues, 2).count() == 1
    ads = spark.createDataFrame([(1, "b", None), (1, "a", "s"), (2, "c", "")], "issue_id long, brand string, sector string")
    assert [x.brand for x in L.listed_advertisers(ads, 1).orderBy("place").collect()] == ["a", "b"]
    assert [tuple(x) for x in L.library_view(ads).orderBy("issue_id", "place").collect()] == [(1, 1, "a", "s"), (1, 2, "b", ""), (2, 1, "c", "")]
    share = spark.createDataFrame([(1, "x", 2), (1, "a", 2), (1, "z", 5)], "issue_id long, sec string, n long")
    assert [x.sec for x in L.ordered_share(share).orderBy("place").collect()] == ["z", "a", "x"]


def test_coverage(spark):
    rows = [("a", "heuristica", 3, None, [2], None, 0, False), ("b", "ia", 2, [1, 2], None, None, 0, False), ("c", "ia", 2, None, None, None, 0, False)]
    got = {r.issue_id: (r.estado, r.paginas_analizadas, r.failed_pages) for r in Q.coverage(spark.createDataFrame(rows, "issue_id string, mode string, total_pages int, failed_pages array<int>, source_failed_pages array<int>, partial_pages array<int>, invalid_items int, fallback boolean")).collect()}
    assert got == {"a": ("parcial", 2, [2]), "b": ("fallido", 0, [1, 2]), "c": ("completo", 2, [])}


def test_manifest_numbers(spark):
    def rows(issue, numbers, hashes=None):
        return [(issue, k, f"http://h/page{n}.jpg?t=1" if n is not None else "http://h/x.jpg", (hashes or [str(j) for j in range(len(numbers))])[k - 1], 1) for k, n in enumerate(numbers, 1)]

    frame = spark.createDataFrame([*rows("a", [1, 1, 2, 5, 5, 5, 9]), *rows("b", [1, 2], ["h", "h"]), *rows("c", [4, None, 1], ["x", None, "y"]), *rows("d", [7, 2, 7, None])], "issue_id string, idx int, url string, sha256 string, bytes long")
    got = {}
    for r in M.numbered(frame).orderBy("issue_id", "idx").collect():
        got.setdefault(r.issue_id, []).append((r.page_number, r.status, r.duplicate_of))
    assert [x[0] for x in got["a"]] == [1, 2, 3, 5, 6, 7, 9]
    assert got["b"] == [(1, "ok", None), (2, "duplicate", 1)]
    assert got["c"] == [(4, "ok", None), (2, "failed", None), (1, "ok", None)]
    assert [x[0] for x in got["d"]] == [7, 2, 8, 4]


def test_html_links(spark):
    pages = spark.createDataFrame([(1, "https://example.test/x", '<a href="/aviso.pdf"><a href="/numero.pdf?token=abc&amp;download=1">'), (2, "http://b", '<div class="fb3d-thumbnail">'), (3, "http://c", "<iframe src='//e.issuu.com/1'>"), (4, "http://d", None)], "id int, url string, html string")
    assert [tuple(r) for r in M.pdf_links(pages).collect()] == [(1, "https://example.test/numero.pdf?token=abc&download=1")]
    assert sorted(map(tuple, M.viewers(pages).collect())) == [(2, "http://b", "3D FlipBook"), (3, "http://e.issuu.com/1", "Issuu")]


def test_appearances(spark):
    ads = spark.createDataFrame([("j", 1, "A", "", [3, 8], "", "", "012345678", "", 0.875, "ia", "", ["low_conf"]), ("j", 2, "B", "", [], "", "", "", "", None, "ia", None, None)], "issue_id string, adv_no int, brand string, sector string, pages array<int>, website string, email string, phone string, ad_size string, confidence double, method string, notes string, review_reasons array<string>")
    meta = spark.createDataFrame([("j", "job-123", "e", "", None, "T")], "issue_id string, job_id string, export_id string, estado string, url string, titulo string")
    rows = R.appearances(ads, meta).orderBy("appearance_id").collect()
    assert [(r.appearance_id, r.advertiser_id, r.page, r.phone) for r in rows] == [("job-123:a0001:p0003", "job-123:a0001", 3, "012345678"), ("job-123:a0001:p0008", "job-123:a0001", 8, "012345678"), ("job-123:a0002:n0001", "job-123:a0002", None, "")]


def test_rows_are_dealt_before_fields_are_picked_by_order(spark):
    """No aggregation stands below the exchange, where each picked field would carry the whole order of its row."""
    ads = spark.createDataFrame([(1, 2, 5, "Ab, S.A.", "", "e@x.es", "", "", "", 0.5, "ia", "", "z"), (1, 1, 6, "Ab", "w.es", "", "", "", "", 0.4, "ia", "", "z")], "issue_id int, page_no int, o1 int, brand string, website string, email string, phone string, sector string, ad_size string, confidence double, method string, notes string, unused string")
    merged, last = A.merged(ads, ["page_no", "o1"]), L.latest(L.stored_advertisers(ads), ["brand", "page_no", "o1"])
    for df in (merged, last):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "partial_m" not in plan.split("Exchange")[1]
    row = merged.first()
    assert (row.brand, row.pages, row.website, row.email, row.confidence) == ("Ab", [1, 2], "w.es", "e@x.es", 0.5)
    assert last.first().brand == "Ab, S.A."
