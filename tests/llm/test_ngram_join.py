import random
import re

import numpy as np
import pytest

from adatlas.llm import ngram_join as J


def brute(rows, percent=85, shingle=4):
    """Sets of word tuples, all pairs, components."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        moved = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
        if not moved:
            break
    return {i: (len(sets[i]), label[i]) for i in ids}


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "and", "it"]) if r.random() < 0.3 else "".join(r.choice("aeioustr") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                k = r.randrange(len(w)) if w else 0
                w[k : k + 1] = r.choice([[], [word()], [w[k].upper() if w else "A", word()]])
        else:
            w = [word() for _ in range(r.choice([1, 2, 3, 4, 5, 12, 40, 120, 300]))]
            if r.random() < 0.3:
                w[len(w) // 2 : len(w) // 2] = passage
        texts.append(" ".join(w))
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 4)])
def test_join_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = [*corpus(seed), (1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE\ttwo"), (1006, "x " * 5000)]
    docs = spark.createDataFrame([(i, t, "zz") for i, t in rows], "doc_id long, text string, cls string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_key_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, "q r s t"), (9, "q r x t")], "doc_id long, text string")
    got = sorted(map(tuple, J.join(docs).collect()), key=str)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 2, 2), (None, 1, None), (9, 1, 9)], key=str)
    assert J.join(docs.limit(0)).count() == 0


def test_two_texts_under_one_key_and_heads_of_groups(spark):
    text = lambda name, n=30: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("b") + " end"), (3, text("c")), (3, text("c") + " end"), (None, text("a")), (None, text("d")), (4, ""), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.component_id) for r in J.join(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (None, 1), (None, None), (4, 4), (4, 4), (5, 5)], key=str)
    heads = J.join(docs, heads=True).distinct()
    kept = docs.select("doc_id", "text", J.F.xxhash64("text").alias("h")).join(heads, J.F.col("doc_id").eqNullSafe(heads["id"]) & (J.F.col("h") == heads["hash"]), "left_semi")
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 1, 3, None, 4, 4, 5], key=str)  # of a and b one each, of c one, d, and all without words


def test_met_tokens_across_batches():
    import pyarrow as pa

    r = random.Random(2)
    rows = sorted((r.randint(0, 12), r.randint(-9, 9)) for _ in range(120))
    for size in (1, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size])], ["token", "cls"]) for k in range(0, len(rows), size)]
        got = sorted(x for b in J.meet(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns)))
        of = {}
        for token, cls in rows:
            of.setdefault(token, set()).add(cls)
        assert got == sorted((c, min(s)) for s in of.values() if len(s) > 1 for c in s)


def test_divide_skip_finds_all_places_with_enough_lists():
    r = random.Random(3)
    for _ in range(300):
        lists = [sorted(r.sample(range(30), r.randint(0, 20))) for _ in range(r.randint(1, 12))]
        least = r.randint(1, 10)
        count = np.bincount([x for one in lists for x in one], minlength=30)
        assert dict(J.divide_skip(lists, least)) == {k: c for k, c in enumerate(count) if c >= least}
