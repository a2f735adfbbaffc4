"""What is costly stands once in a plan: the optimizer copies what a filter or a plain explode asks about down to the rows."""

from pyspark.sql import functions as F

from adatlas.operators import answers as A
from adatlas.operators import detect as D


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def filters(df):
    return [line for line in plan(df).splitlines() if "Filter " in line]


def pages(spark):
    return spark.createDataFrame([(1, 0, 1, "Ver www.acme-tools.com info@acme.org 912345678, facebook.com x-y.es"), (1, 1, 2, "nada"), (2, 0, 1, None)], "issue_id long, pos int, page_no int, text string")


def test_texts_of_pages_are_searched_once(spark):
    found = D.mentions(pages(spark))
    assert plan(found).count("regexp_extract_all(") == 2  # addresses and phones
    assert not [f for f in filters(found) if "regexp" in f or "replace" in f]
    rows = found.orderBy("match_idx").select("issue_id", "match_idx", "root", "key", "email", "phone").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "acme-tools.com", "acme tools", "info@acme.org", "912345678"), (1, 1, "acme.org", "acme", "info@acme.org", "912345678"), (1, 3, "x-y.es", "x y", "info@acme.org", "912345678")]


def responses(spark):
    raws = ['{"anuncios":[{"marca":"Acme","pagina":1,"confianza":0.5},7]}', '{"anuncios":[]}', "nada", '{"anuncios":[{"marca":"Bo","pagina":1,"confianza":1}']
    return spark.createDataFrame([(1, k, [1, 2], r) for k, r in enumerate(raws)], "issue_id long, spread_no int, page_nums array<int>, raw string")


def test_answers_are_parsed_once(spark):
    rows = A.validated(A.parsed(responses(spark)))
    assert not [f for f in filters(rows) if "variant" in f or "json" in f]
    assert [tuple(r) for r in rows.orderBy("spread_no", "item_idx").select("spread_no", "item_idx", "brand", "reason").collect()] == [(0, 0, "Acme", None), (0, 1, None, "registro no es objeto"), (3, 0, "Bo", None)]


def test_partial_pages_ask_about_spreads(spark):
    rows = A.validated(A.parsed(responses(spark)), whole=True)
    own = A.partial_pages(rows)
    assert not [f for f in filters(own) if "variant" in f or "json" in f]
    assert [tuple(r) for r in own.collect()] == [(1, [1, 2])]
    good = A.partial_pages(A.validated(A.parsed(responses(spark).where("spread_no = 1")), whole=True))
    assert good.count() == 0


def test_phones_of_more_digits(spark):
    from adatlas.functions import text as X

    texts = ["tel 34 912 345 678", "5663481732", "512345678", "612345678", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.first_phone(F.col("t"))).collect()] == ["34 912 345 678", "5663481732", "", "612345678", ""]
