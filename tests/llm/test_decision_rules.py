import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adatlas.llm import decision_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "b", "a b a", "é", "Ω#", "\n", "\n\n", "\r\n", " ", "\t", " ", "|", "x <y>", "𝄞", "\n a\n", "\x0b"]
    return ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_counts_equal_plain_counting(spark):
    own = [None, "", " ", "\n", "a", "a a a a", "a a\na a\n", "\na\n\na", "word " * 40_000, "x y z " * 3 + "q", *texts(4, 200)]
    docs = spark.createDataFrame([(k, t, 1, "n") for k, t in enumerate(own)], "doc_id long, text string, n_words int, kept string").repartition(3)
    got = {r.doc_id: tuple(r)[1:6] for r in R.ruled(docs, spark.createDataFrame([], "doc_id long, quality int"))[0].collect()}
    assert got == {k: brute(t) for k, t in enumerate(own)}


def sample(seed, n=4000):
    """Two unlike kinds of bad rows, one of which needs two conditions."""
    rng = np.random.default_rng(seed)
    x = {name: rng.random(n) for name in ("a", "b", "c", "d")}
    bad = (x["a"] > 0.9) | ((x["b"] <= 0.3) & (x["c"] > 0.6))
    return x, ~bad, rng.random(n) < 0.33


def holds(rules, x):
    out = np.full(len(next(iter(x.values()))), not rules.verdict)
    for rule in reversed(rules.rules):
        out[np.logical_and.reduce([c.holds(x) for c in rule])] = rules.verdict
    return out


def test_covering_finds_planted_rules_and_tells_them_in_words():
    x, good, unseen = sample(1)
    rules = R.covering(x, good, unseen)
    fresh, wanted, _ = sample(2)
    assert (holds(rules, fresh) == wanted).mean() > 0.98 and not rules.verdict
    assert len(rules.rules) < 12 and "drop if" in str(rules) and str(rules).endswith("else keep")


def test_noise_is_pruned_away():
    rng = np.random.default_rng(3)
    x, good = {"a": rng.random(2000)}, rng.random(2000) < 0.7
    assert sum(map(len, R.covering(x, good, rng.random(2000) < 0.33).rules)) <= 10


@pytest.mark.parametrize("good, rest", [([], True), ([True] * 9, True), ([False] * 9, True)])
def test_labels_of_one_kind_decide_nothing(good, rest):
    good = np.array(good, bool)
    rules = R.covering({"a": np.arange(len(good), dtype=float)}, good, np.zeros(len(good), bool))
    assert rules.rules == [] and (not rules.verdict) is rest


def test_expression_gives_the_first_rule_that_holds(spark):
    rules = R.DecisionList([[R.Condition("a", True, 0.5), R.Condition("b", False, 1.0)], [R.Condition("a", True, 0.2)]], False)
    df = spark.createDataFrame([(0.6, 1.0), (0.6, 2.0), (0.2, 0.0)], "a double, b double")
    assert [tuple(r) for r in df.select(rules.fired(), rules.keeps()).collect()] == [(1, False), (2, False), (None, True)]


def test_learned_rules_hold_on_documents_not_seen(spark, tmp_path):
    """Bad texts hold bars; labels of held-out documents and null keys teach nothing; of two texts of an id one trains."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(900)]
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = " ".join(rng.choice(words) + (" |" if bad and rng.random() < 0.4 else "") for _ in range(rng.randrange(60, 200)))
        rows.append((k, text, "x"))
        labels.append((k, int(not bad), 0))
    rows += [(None, "one two " * 60, "x"), (7, " ".join(words[:70]), "x"), (7, " ".join(words[:70]), "x"), (8, None, "x"), (9, "short", "x")]
    labels += [(None, 0, 0), (3, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = R.op12(spark, str(tmp_path))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    told = got.where(held & ~F.col("base_failed")).select("doc_id", "kept").collect()
    assert len(told) > 90 and all(r.kept == (r.doc_id % 4 != 0) for r in told)
    assert got.count() == len(rows) and got.where("base_failed").count() == got.where("n_words < 50 or doc_id is null").count()
    assert got.where("base_failed and kept").count() == 0
    assert R.ruled(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))[0].count() == 0
