import math

import numpy as np
import pytest

from adatlas.llm import ann, embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, component_id int"


def vectors(n=240, dim=12, seed=3):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i and r.random() < 0.5:
            v = np.array(out[r.integers(len(out))][1]) + r.choice([0, 0.1, 0.3]) * r.normal(size=dim)
        else:
            v = r.normal(size=dim) * r.choice([0.01, 1, 50])
        out.append((i * 5, [float(np.float32(x)) for x in v], int(r.integers(3)), 0, 0))
    out += [(5000, None, 1, 0, 0), (5001, [0.0] * dim, 1, 0, 0), (5002, [math.nan] + [1.0] * (dim - 1), 1, 0, 0), (5003, [None] + [1.0] * (dim - 1), 1, 0, 0), (5004, [], 1, 0, 0), (5005, out[0][1], None, 0, 0), (5006, [1.0, 2.0], 1, 0, 0), (5020, [math.inf] * dim, 2, 0, 0)]
    out += [(6000 + k, out[1][1], out[1][2], 0, 0) for k in range(30)]
    return out


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block,square", [(4096, 1024), (16, 7)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block, square):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "SQUARE", square)
    rows = vectors()
    frame = spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near(frame).collect()}
    links = {r[0]: set() for r in rows}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] is not None and a[2] == b[2] and usable(a[1]) and usable(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    label = {i: i for i in links}
    while any(label[j] < label[i] for i in links for j in links[i]):
        for i in links:
            label[i] = min([label[i], *(label[j] for j in links[i])])
    assert got == {i: (len(links[i]), label[i], label[i] == i) for i in links}
    assert E.near(frame.limit(0)).count() == 0


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, 0, 0), (1, [0.0, 1.0], 1, 0, 0), (2, [1.0, 0.01], 1, 0, 0), (1, [1.0, 0.0], 2, 0, 0), (3, [0.0, 2.0], 1, 0, 0), (3, [0.0, 2.0], 1, 0, 0)]
    got = sorted(map(tuple, E.near(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_quantisation_bound_is_rigorous():
    r = np.random.default_rng(1)
    for dim in (1, 3, 64):
        a, b = r.normal(size=(200, dim)) * 10.0 ** r.integers(-3, 3, (200, 1)), r.normal(size=(150, dim)) ** 3
        i, j = E.close_pairs(a, b, 0.2)
        c = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
        sure = np.abs(c - 0.2) > 1e-12
        found = np.zeros_like(c, bool)
        found[i, j] = True
        assert (found == (c >= 0.2))[sure].all()


@pytest.mark.parametrize("block", [4096, 50])
def test_search_finds_the_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "QUERIES", block)
    rows = vectors()
    frame = spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(3)
    got = {}
    for r in ann.search(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(r[0], np.array(r[1])) for r in rows if usable(r[1]) and len(r[1]) == 12]
    asked = [g for g in good if g[0] % 20 == 0]
    assert set(got) == {i for i, _ in asked}
    hits = 0
    for i, q in asked:
        best = sorted((-float(np.einsum("ij,j->i", v[None], q)[0]), j) for j, v in good if j != i)[:20]
        assert [r for r, _, _ in got[i]] == list(range(1, 21))
        assert all(abs(s - float(dict(good)[j] @ q)) < 1e-9 * max(1, abs(s)) for _, j, s in got[i])
        assert [(-s, j) for _, j, s in got[i]] == sorted((-s, j) for _, j, s in got[i])
        hits += len({j for _, j in best} & {j for _, j, _ in got[i]})
    assert hits / (20 * len(asked)) >= 0.95
    assert ann.search(frame.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 0, 0), (1, [0.5, 0.5], 1, 0, 0), (2, [0.5, 0.0], 1, 0, 0)], SCHEMA)
    assert [tuple(r) for r in ann.search(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]


def test_each_length_is_searched_apart_and_other_columns_are_ignored(spark):
    rows = [(0, [1.0, 0.0], "a", 1.0), (1, [2.0, 0.0], "b", 2.0), (20, [1.0, 1.0, 1.0], "c", 3.0), (21, [1.0, 0.0, 0.0], "d", 4.0), (40, [5.0], "e", 5.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score double")
    assert sorted(map(tuple, ann.search(frame).collect())) == [(0, 1, 1, 2.0), (20, 1, 21, 1.0)]


def test_share_of_reranked_rows_falls_and_recall_holds():
    r = np.random.default_rng(5)
    shares = []
    for n in (500, 8000):
        x = r.normal(size=(n, 32)) * r.choice([0.5, 1.0, 2.0], n)[:, None]
        top = float(np.linalg.norm(x, axis=1).max())
        level = ann.levelled(x, top)
        trees = [ann.Tree(level, ann.LEAF, r) for _ in range(ann.TREES)]
        first = np.concatenate(([0], np.cumsum([t.leaves for t in trees])))
        at = np.stack([t.leaf_of(level) for t in trees]) + first[:-1, None]
        counts = np.bincount(at.ravel(), minlength=first[-1])
        sizes = [counts[a:b].tolist() for a, b in zip(first, first[1:])]
        hits = rows = 0
        for i in range(0, n, n // 25):
            got = ann.candidates(ann.weights(*ann.opened(trees, sizes, np.append(x[i], 0), ann.OPEN * ann.TREES * n), first[-1]), at, ann.REACH * n ** (-1 / 3))
            s = x @ x[i]
            s[i] = -np.inf
            hits += len(set(got.tolist()) & set(np.argsort(-s)[:20].tolist()))
            rows += len(got) / n
        assert hits / (20 * len(range(0, n, n // 25))) >= 0.9
        shares.append(rows / len(range(0, n, n // 25)))
    assert shares[1] < 0.3 < shares[0]


def test_copies_do_not_stop_a_tree():
    x = np.repeat(np.array([[1.0, 2.0], [3.0, 4.0]]), [500, 3], axis=0)
    tree = ann.Tree(x, 8, np.random.default_rng(0))
    assert len(np.unique(tree.leaf_of(x))) <= tree.leaves
