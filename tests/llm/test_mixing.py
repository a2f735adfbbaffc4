import random
from collections import Counter

import pytest

from adatlas.llm import mixing as M


def test_water_filling_by_hand(spark):
    # sizes 10, 100, 100; weights 5, 2, 1; goal 315: a stops at 20, then b (2 of 3 of the rest) at 196.67, c at 98.33
    rows = [(k, "w " * 10, s) for k, s in enumerate(["a"] + ["b"] * 10 + ["c"] * 10)] + [(100, None, "b"), (101, " ", "c")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int").repartition(3)
    got = M.mix(docs).collect()
    target = {r.source: round(r.target, 6) for r in got}
    assert target == {"a": 20.0, "b": round(295 * 2 / 3, 6), "c": round(295 / 3, 6)}
    for s in "abc":
        taken = sum(r.taken for r in got if r.source == s)
        assert target[s] - 10 < taken <= target[s]
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got) and {r.taken for r in got if r.size == 0} == {0}
    assert sorted(map(tuple, M.mix(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    assert M.mixed(docs).count() == sum(r.taken // 10 for r in got) and M.mixed(docs).columns == docs.columns


def test_null_sources_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (2, "c", "x"), (None, "d", "x"), (3, "", "y")], "doc_id long, text string, source string")
    got = M.mix(docs).collect()
    assert len(got) == 5 and {(r.source, r.source_size) for r in got} == {(None, 4), ("x", 2), ("y", 0)}
    assert [r.target for r in got if r.source == "y"] == [0.0, ]
    assert M.mix(docs.limit(0)).count() == 0 and M.mixed(docs.limit(0)).count() == 0
    assert all(r.taken == 0 for r in M.mix(docs.where("source = 'y'")).collect())


def taken_by_source(spark, rows, seed):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = M.mix(docs, seed=seed).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    gaps, left = {}, {}
    for r in got:
        gaps[r.source] = gaps.get(r.source, r.target) - r.taken
        if r.size and r.taken < 2 * r.size:
            left[r.source] = min(left.get(r.source, 1 << 60), r.size)
    return gaps, left


@pytest.mark.parametrize("seed", ["mix", "a", "b"])
def test_targets_are_met_where_one_document_is_half_a_source(spark, seed):
    """What is open at the end is less than any document that could still be taken."""
    rows = [(k * 2000 + j, "w " * (10_000 if j == 0 else 10), s) for k, s in enumerate("abc") for j in range(1001)]
    gaps, left = taken_by_source(spark, rows, seed)
    assert all(0 <= g < max(10, left.get(s, 10)) for s, g in gaps.items()), gaps
    assert all(g < 10 for g in gaps.values()), gaps


def test_gap_is_below_every_open_document(spark):
    rng = random.Random(4)
    rows = [(k, "w " * int(rng.paretovariate(0.7) * 3 % 5000), rng.choice(["a"] * 6 + ["b", "c", None])) for k in range(600)]
    gaps, left = taken_by_source(spark, rows, "mix")
    assert all(-1e-6 <= g and (s not in left or g < left[s]) for s, g in gaps.items()), (gaps, left)


def test_equal_rows_go_together_and_whole_rows_follow(spark):
    rows = [(k // 2, "w " * (k // 2 % 7), "s", k) for k in range(80)] + [(None, "w w", "s", -1), (None, "w", "t", -2), (500, "w " * 300_000, "t", -3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    got, whole = M.mix(docs).collect(), M.mixed(docs).collect()
    assert sum(r.taken for r in got) == sum(len(r.text.split()) for r in whole)
    counts = Counter(r.size for r in whole)
    assert all(counts[2 * k] == counts[2 * k + 1] for k in range(40))
    assert M.mix(docs.limit(0)).count() == 0
