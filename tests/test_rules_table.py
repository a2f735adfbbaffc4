import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adatlas.functions import rules as RT
from adatlas.functions import text as X
from adatlas.operators import detect as D
from adatlas.operators import library as L
from adatlas.operators import manifest as M


def first(rules, text, ends):
    hits = [r for r in rules if r[0] is not None and r[1] and (text.endswith(r[1]) if ends else r[1] in text)]
    return min(hits, key=lambda r: (r[0], r[1], r[2]), default=None)


@pytest.mark.parametrize("ends", [False, True])
@pytest.mark.parametrize("most_bytes", [0, RT.MOST_BYTES])
def test_first_rule_equals_trying_all(spark, ends, most_bytes):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abñ.-") for _ in range(rng.randrange(n)))
    rules = [(rng.choice([1, 2, 3, None]), word(7), f"v{k}") for k in range(120)]
    texts = [word(20) for _ in range(200)] + ["", None, "aaaa"]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "id int, text string, priority int").repartition(3)
    table = spark.createDataFrame(rules, RT.RULE)
    got = {r.id: r.rule and tuple(r.rule) for r in RT.first_rule(df, F.col("text"), table, ends=ends, most_bytes=most_bytes).collect()}
    assert got == {k: None if t is None else first(rules, t, ends) for k, t in enumerate(texts)}


@pytest.mark.parametrize("most_bytes", [0, RT.MOST_BYTES])
def test_empty_rules_and_texts(spark, most_bytes):
    none, one = spark.createDataFrame([], RT.RULE), spark.createDataFrame([("a",)], "text string")
    assert [r.rule for r in RT.first_rule(one, F.col("text"), none, most_bytes=most_bytes).collect()] == [None]
    assert RT.first_rule(one.limit(0), F.col("text"), none, ends=True, most_bytes=most_bytes).count() == 0


def test_sectors_and_blocklist_by_table_equal_those_in_code(spark):
    sectors = ["", None, "  ", "Alimentación / Quesos", "ia", "usa ia hoy", "Española", "raro", "Bebidas / distribucion"]
    ads = spark.createDataFrame([(k, s) for k, s in enumerate(sectors)], "id int, sector string")
    groups = lambda df: sorted((r.id, r.sector_group) for r in df.collect())
    assert groups(L.with_sector_group(ads, L.sector_rules(spark))) == groups(L.with_sector_group(ads))
    pages = spark.createDataFrame([(1, 0, 1, "www.uno.es notfacebook.com dos.com google.com a.es tres.net")], "issue_id int, pos int, page_no int, text string")
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(D.mentions(pages, blocked=RT.table(spark, [(d, "") for d in X.BLOCKED_DOMAINS]))) == keys(D.mentions(pages))


def test_viewers_by_a_table_of_ones_own(spark):
    pages = spark.createDataFrame([(1, "http://a.es/x", '<iframe src="https://issuu.com/a"><a href="//read.own.example/b">')], "id int, url string, html string")
    assert [r.viewer for r in M.viewers(pages).collect()] == ["Issuu"]
    assert [tuple(r) for r in M.viewers(pages, RT.table(spark, [("own.example", "Own")])).collect()] == [(1, "http://read.own.example/b", "Own")]


@pytest.mark.parametrize("ends", [False, True])
def test_many_rules_meet_only_pieces_that_are_rules(spark, ends):
    """Each text holds hundreds of beginnings of rules and three rules; patterns of some hundred bytes share all but their ends."""
    rng = random.Random(2)
    long = "ñ" + "".join(rng.choice("abcdefgh") for _ in range(290))
    rules = [(k, f"ref {k}-", "a") for k in range(3000)] + [(9000 + k, f"{long}{k}.", "b") for k in range(300)] + [(99999, "-", "c")]
    texts = [f"anillo ref {k * 7 % 4000}-" for k in range(500)] + [f"x{long}{k * 3}." for k in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    table = spark.createDataFrame(rules, RT.RULE)
    got = {r.text: r.rule and tuple(r.rule) for r in RT.first_rule(df, F.col("text"), table, ends=ends, most_bytes=0).collect()}
    assert got == {t: first(rules, t, ends) for t in texts}
    made = RT.sieve(RT.keyed(RT.usable(table), ends), len(rules), ends)
    passed = sum(b.num_rows for b in made.passing(pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])))
    assert passed < 4 * len(texts)


def test_ends_that_all_texts_share_meet_no_rule(spark):
    """Of every address the last four signs are the same; only whole ends that are rules go on to the join."""
    table = spark.createDataFrame([(k, f"part-{k}.net", "blocked") for k in range(2000)], RT.RULE)
    texts = [f"hoja-{k}.net" for k in range(1000)] + [f"www.part-{k}.net" for k in range(1500, 2500)]
    made = RT.sieve(RT.keyed(RT.usable(table), True), 2000, True)
    passed = sum(b.num_rows for b in made.passing(pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])))
    assert passed < 1000
    got = RT.first_rule(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text"), table, ends=True, most_bytes=0)
    assert got.where("rule is not null").count() == 500


@pytest.mark.parametrize("most_bytes", [0, RT.MOST_BYTES])
def test_frequent_texts_meet_the_rules_once_a_batch(spark, monkeypatch, most_bytes):
    """Most rows have one of few texts. Those with rules are broadcast, so that rows are not dealt nor sorted; in a join, too, only the first rows of batches look for rules."""
    tables = {}
    monkeypatch.setattr(RT, "written", lambda df, name, write=RT.written: tables.setdefault(name, write(df, name)))
    monkeypatch.setattr(RT, "MOST_RULES", 3)
    table = spark.createDataFrame([(k, f"{k}-olt.es", "blocked") for k in range(20)] + [(50, "olt.es", "blocked")], RT.RULE)
    texts = [["cold.com", None, "", "3-olt.es"][k % 40] if k % 40 < 4 else "hot-olt.es" for k in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = RT.first_rule(df, F.col("text"), table, ends=True, most_bytes=most_bytes)
        assert out.columns == ["id", "text", "rule"]
        got = {r.id: r.rule and r.rule.pattern for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {k: {"hot-olt.es": "olt.es", "3-olt.es": "3-olt.es"}.get(t) for k, t in enumerate(texts)}
    assert tables["texts"].select("__id").distinct().count() <= 5 * 4
    assert ("hashpartitioning" in plan) == (most_bytes == 0)
