import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adatlas.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, row int, dim string, id string"


@pytest.mark.parametrize("largest", [1, 154, 10**5, 10**9])
def test_packed_products_are_exact(largest):
    rng = np.random.default_rng(largest)
    a, c = (rng.integers(-largest, largest + 1, (k, 16)).astype(np.float64) for k in (5, 37))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in c] for p in a]
    assert H.products(a, c).tolist() == want
    assert H.products(a * 0, c).tolist() == [[0] * 37] * 5
    assert H.products(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2


def test_fields_share_one_number():
    c = np.array([[1.0, -2.0], [3.0, 0.0], [-3.0, 1.0]])
    assert H.packed(c, 3, 10, 2).tolist() == [[4 + 6 * 1024, 1 + 3 * 1024], [0, 4]]


def brute(rows, positives=5, negatives=3):
    seen = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v))
            if row not in seen:
                seen.append(row)
    out = []
    for a in (r for r in seen if r[0] % 50 == 0):
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in seen if b is not a and len(b[2]) == len(a[2])))
        for s, p, _ in [b for b in scored if b[2] == a[1]][:positives]:
            near = [b for b in scored if b[2] != a[1] and 50 * -s <= 100 * -b[0] <= 95 * -s][:negatives]
            out += [(a[0], p, k, b[1], -s, -b[0]) for k, b in enumerate(near, 1)]
    return sorted(out)


def op13(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in H.op13(spark, str(tmp_path)).collect())


def vectors(seed, n, dim=6, scale=1.0, labels=3):
    rng = random.Random(seed)
    return [(k, [rng.choice([0.0, 0.25, 0.5, rng.uniform(-0.3, 1)]) * scale for _ in range(dim)], rng.randrange(labels)) for k in range(n)]


def test_equals_brute_force_over_blocks(spark, tmp_path, monkeypatch):
    """Several blocks of anchors and candidates, ties, repeated rows, vectors that take no part, and other lengths."""
    monkeypatch.setattr(H, "CELLS", 240)
    rows = vectors(1, 230)
    rows += rows[:20] + [(1000, [1.0] * 6, None), (1050, None, 1), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1150, [math.inf] * 6, 1), (None, [1.0] * 6, 1), (1200, [math.nan] * 6, 2), (1250, [0.0] * 6, 2), (1300, [], 1), (1350, [1.0], 1), (1353, [0.9], 1), (1352, [0.7], 2)]
    got = op13(spark, tmp_path, rows)
    assert got == brute(rows) and any(r[0] == 1350 for r in got)


def test_large_components(spark, tmp_path):
    rows = vectors(2, 60, scale=1e5)
    assert op13(spark, tmp_path, rows) == brute(rows)


def test_empty_table_and_anchors_without_partners(spark, tmp_path):
    assert op13(spark, tmp_path, []) == []
    alone = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert H.mine(alone, F.col("id") == 50).collect() == []
