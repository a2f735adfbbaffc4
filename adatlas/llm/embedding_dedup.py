"""Embedding near-duplicates: int8 tile products with rigorous error bounds, then full precision where a pair may pass.

Vectors equal in every bit and label are one class with a count, so that thousands of copies cost one row. Classes of a
label are dealt by hash into blocks of a bounded size, and every pair of blocks is one tile, a task of bounded memory.
A tile returns link counts of its vectors and a spanning forest of its links, never the links themselves.
The work is quadratic in the distinct vectors of a label, as the exhaustive comparison asks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adatlas.llm.common import UnionFind, components, stash
from adatlas.llm.vectors import checked, matrix

#: Vectors of a block, of which a task holds two; vectors of a square of products within it.
BLOCK, SQUARE = 4096, 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 steps, the size of a step, and the length of what rounding left over, for each vector."""
    step = np.abs(x).max(1) / 127.0
    q = np.rint(x / step[:, None]).astype(np.int8)
    return q, step, np.linalg.norm(x - q * step[:, None], axis=1)


def close_pairs(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs with cosine >= least in double precision.

    For unit x = sq + e and y = tp + f: x.y - st q.p = sq.f + e.y, so the error is at most (1 + |e|) |f| + |e|.
    Pairs whose quantised cosine is below `least` by more than that bound can't pass; all others are computed again.
    """
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    (qa, sa, ea), (qb, sb, eb) = quantised(a / na[:, None]), quantised(b / nb[:, None])
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers stay exact
    about = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    i, j = np.nonzero(about + ((1 + ea)[:, None] * eb[None, :] + ea[:, None] + 1e-9) >= least)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 15):
        s, t = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        keep[at : at + (1 << 15)] = np.einsum("ij,ij->i", a[s], b[t]) / (na[s] * nb[t]) >= least
    return i[keep], j[keep]


def tile_links(x: np.ndarray, one: np.ndarray, two: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile, each once, as rows of x: found square by square."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    same = one is two
    for s in range(0, len(one), SQUARE):
        for t in range(s if same else 0, len(two), SQUARE):
            a, b = close_pairs(x[one[s : s + SQUARE]], x[two[t : t + SQUARE]], least)
            a, b = one[a + s], two[b + t]
            out.append((a[a < b], b[a < b]) if same and s == t else (a, b))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def near(df: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each vector: key, n_links, component_id, kept.

    Compared are vectors of equal, non-null label and equal length. Vectors that take no part (see `checked`) and those
    without a label have no links and are their own component. Rows that repeat an id, label and vector are one vector;
    if an id comes with several vectors, each has its row and its own links. Copies link with each other. Empty in,
    empty out.
    """
    same = F.when(F.col("v").isNotNull() & F.col("label").isNotNull(), F.xxhash64("label", "dim", "v"))
    rows = stash(checked(df, key, vector, label).distinct().withColumn("cls", same), "vectors")
    part = rows.where("cls is not null")
    classes = stash(part.groupBy("cls", "label", "dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = classes.join(blocks, ["label", "dim"]).withColumn("block", F.pmod("cls", F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "n", "v")

    def tile(table: pa.Table) -> pa.Table:
        i, j, dim = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("dim")[0].as_py()
        order = np.argsort(np.asarray(table.column("cls")), kind="stable")
        table = table.take(pa.array(order))
        cls, n, block = (np.asarray(table.column(k)) for k in ("cls", "n", "block"))
        x = matrix(table.column("v"), dim)
        one = np.flatnonzero(block == i)
        a, b = tile_links(x, one, one if i == j else np.flatnonzero(block == j), least)
        links = np.bincount(a, n[b], len(cls)) + np.bincount(b, n[a], len(cls))
        sets = UnionFind(len(cls))
        forest = [(s, t) for s, t in zip(a.tolist(), b.tolist()) if sets.union(s, t)]
        s, t = np.array(forest, np.int64).reshape(-1, 2).T
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(np.concatenate((cls[some], cls[s]))), "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cls[t])]), "links": pa.array(np.concatenate((links[some].astype(np.int64), np.zeros(len(s), np.int64))))})

    found = stash(dealt.groupBy("label", "dim", "i", "j").applyInArrow(tile, "a long, b long, links long"), "tiles")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    comps = components(found.where("b is not null").select("a", "b"))
    own = classes.select("cls", "rep", "n").join(links, F.col("cls") == F.col("a"), "left").join(comps, F.col("cls") == F.col("node"), "left")
    own = stash(own.select("cls", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component")), "groups")
    first = own.groupBy("component").agg(F.min("rep").alias("first"))
    of = own.join(first, "component").select("cls", "n_links", "first")
    out = rows.join(of, "cls", "left")
    component = F.coalesce("first", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), ok AS (
  SELECT * FROM e WHERE v IS NOT NULL AND label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r AS (
  SELECT a AS id, a AS far FROM p UNION SELECT r.id, p.b FROM r JOIN p ON r.far = p.a
), c AS (
  SELECT id, min(far) AS m FROM r GROUP BY id
), n AS (
  SELECT a, count(*) AS n FROM p GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(m, vec_id), vec_id) AS component_id, coalesce(least(m, vec_id), vec_id) = vec_id AS kept
FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.id = vec_id
"""
