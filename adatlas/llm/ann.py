"""Approximate nearest neighbours: a forest of random-projection trees searched through a shared priority queue for each
query, then exact reranking of the leaf candidates that most trees agree on.

The trees are fitted on a bounded, hash-picked sample (SAMPLE rows), in a space where all vectors have one length: the
largest inner product is the nearest vector there. Every row is then indexed by its leaf in each tree. A query walks all
trees through one queue, nearest leaves first, until the opened leaves hold OPEN of all entries; each gives its rows a
weight, more for a nearer leaf. The rows with the largest sums, REACH * n**(2/3) of n rows, are reranked in double
precision. That share falls as the table grows: 36 % of 2000 rows, 12 % of 50,000, 1 % of 100 million. Rows are dealt by
hash into blocks of a bounded size, each of which takes its part of them, so that copies of one vector are spread over
all blocks. Measured recall at 20 is in the README.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adatlas.llm.common import stash
from adatlas.llm.vectors import checked, matrix

#: Rows on which the trees are fitted, at most (about: they are picked by hash).
SAMPLE = 20_000
TREES, LEAF, OPEN, REACH = 16, 32, 0.35, 4.5
#: Weights of leaves; rows of an index block, and queries of a query block.
WEIGHTS, BLOCK, QUERIES = 16, 16_384, 2048


def levelled(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with one more component, so that all have length `top`, the greatest length of the table."""
    rest = np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate((x, rest[:, None]), 1)


class Tree:
    """One random-projection tree: each inner node splits at the median along the difference of two random rows."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.planes: list[np.ndarray] = []
        self.node: list[tuple[int, float, int, int]] = []  # plane (-1: a leaf), split, left, right
        self.leaves = 0
        self._grow(sample, np.arange(len(sample)), leaf, rng)
        self.planes = np.array(self.planes).reshape(-1, sample.shape[1])

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        me = len(self.node)
        self.node.append((-1, 0.0, self.leaves, 0))
        if len(rows) > leaf:
            for _ in range(4):  # a plane between copies splits nothing: another is tried
                a, b = x[rng.choice(rows, 2, False)]
                p = x[rows] @ (plane := (a - b) / (np.linalg.norm(a - b) + 1e-300))
                split = float(np.median(p))
                if 0 < np.count_nonzero(p <= split) < len(rows):
                    self.planes.append(plane)
                    at = len(self.planes) - 1
                    left = self._grow(x, rows[p <= split], leaf, rng)
                    right = self._grow(x, rows[p > split], leaf, rng)
                    self.node[me] = (at, split, left, right)
                    return me
        self.leaves += 1
        return me

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf number of each row."""
        at, out = [(0, np.arange(len(x)))], np.zeros(len(x), np.int32)
        while at:
            u, rows = at.pop()
            plane, split, left, right = self.node[u]
            if plane < 0:
                out[rows] = left
            elif len(rows):
                low = x[rows] @ self.planes[plane] <= split
                at += [(left, rows[low]), (right, rows[~low])]
        return out


def opened(trees: list[Tree], sizes: list[np.ndarray], query: np.ndarray, enough: float) -> tuple[list[int], list[float]]:
    """Leaves, numbered through all trees, that a query opens, and how far each is.

    One queue over all trees, least summed squared distance to crossed planes first.
    """
    along = [t.planes @ query for t in trees]
    first = np.concatenate(([0], np.cumsum([t.leaves for t in trees]))).tolist()
    queue = [(0.0, k, 0) for k in range(len(trees))]
    out, fars, held = [], [], 0
    while queue and held < enough:
        far, k, u = heapq.heappop(queue)
        while True:
            plane, split, left, right = trees[k].node[u]
            if plane < 0:
                break
            off = along[k][plane] - split
            heapq.heappush(queue, (far + off * off, k, right if off <= 0 else left))
            u = left if off <= 0 else right
        out.append(first[k] + left)
        fars.append(far)
        held += sizes[k][left]
    return out, fars


def weights(leaves: list[int], fars: list[float], total: int) -> np.ndarray:
    """A weight of each of `total` leaves: 0 unless opened, else 1 to WEIGHTS, the nearest most."""
    out = np.zeros(total, np.uint8)
    out[leaves] = 1 + np.floor((WEIGHTS - 1) * (1 - np.array(fars) / max(fars[-1], 1e-300))).astype(np.uint8)
    return out


def candidates(weight: np.ndarray, leaves: np.ndarray, share: float) -> np.ndarray:
    """The rows of a block with the largest sums of weights, `share` of them, ties included. leaves: trees by rows."""
    wanted = math.ceil(share * leaves.shape[1])
    if wanted >= leaves.shape[1]:
        return np.arange(leaves.shape[1])
    sums = np.zeros(leaves.shape[1], np.uint16)
    for own in leaves:
        sums += weight[own]
    return np.flatnonzero(sums >= np.partition(sums, len(sums) - wanted)[len(sums) - wanted])


def search(
    df: DataFrame, queries: DataFrame | None = None, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF,
    open_share: float = OPEN, reach: float = REACH, sample: int = SAMPLE, seed: int = 7,
) -> DataFrame:
    """For each row of `queries` (by default: of df with an id divisible by 20) its k nearest rows of df found, by inner product.

    Returns query_id, rank from 1, vec_id, score: nearest first, ties to the smaller id; never the query's own id; all
    candidates if there are fewer than k. Vectors that take no part (see `checked`) neither ask nor answer. Vectors of
    one length are compared with each other only; each length has a forest of its own. A repeated id counts once for
    each length, with its smallest vector by bytes. Other columns are ignored. An empty table gives an empty result.
    """
    spark = df.sparkSession
    valid = stash(checked(df, key, vector).where("v is not null").groupBy("id", "dim").agg(F.min("v").alias("v")), "vectors")
    asked = valid.where("id % 20 = 0") if queries is None else checked(queries, key, vector).where("v is not null").select("id", "dim", "v")
    out = None
    for row in valid.groupBy("dim").count().orderBy("dim").toLocalIterator():  # a row for each length of vectors
        same = F.col("dim") == row["dim"]
        near = found(valid.where(same).select("id", "v"), asked.where(same).select("id", "v"), row["dim"], row["count"], k, trees, leaf, open_share, reach, sample, seed)
        out = near if out is None else out.unionByName(near)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def found(valid: DataFrame, asked: DataFrame, dim: int, n: int, k: int, trees: int, leaf: int, open_share: float, reach: float, sample: int, seed: int) -> DataFrame:
    """The search among n stored vectors (id, v) of one length."""
    spark = valid.sparkSession

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max((float(np.linalg.norm(matrix(b.column(0), dim), axis=1).max()) for b in batches if b.num_rows), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    top = valid.select("v").mapInArrow(lengths, "most double").agg(F.max("most")).first()[0]
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample / n)
    picked = (valid.where(share) if n > sample else valid).toArrow()  # about `sample` rows
    base, rng = levelled(matrix(picked.sort_by("id").column("v"), dim), top), np.random.default_rng(seed)
    forest = [Tree(base, leaf, rng) for _ in range(trees)]
    first = np.concatenate(([0], np.cumsum([t.leaves for t in forest]))).tolist()
    total = first[-1]
    shared = spark.sparkContext.broadcast(forest)  # at most trees * 2 * sample / leaf planes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = levelled(matrix(batch.column(1), dim), top)
                at = np.stack([t.leaf_of(x) + f for t, f in zip(shared.value, first)], 1).astype("<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a in at], pa.binary())], ["id", "v", "leaves"])

    index = stash(valid.mapInArrow(place, "id long, v binary, leaves binary"), "index")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total, np.int64)
        for batch in batches:
            sums += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=total)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["leaf", "n"])

    counted = index.select("leaves").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()  # a row for each leaf of the sample's trees
    counts = np.zeros(total, np.int64)
    counts[np.asarray(counted.column("leaf"))] = np.asarray(counted.column("n"))
    sizes = [counts[a:b].tolist() for a, b in zip(first, first[1:])]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                asks = np.concatenate((x := matrix(batch.column(1), dim), np.zeros((len(x), 1))), 1)
                told = [weights(*opened(shared.value, sizes, q, open_share * trees * n), total).tobytes() for q in asks]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.binary())], ["id", "v", "weights"])

    width = max(1, spark.sparkContext.defaultParallelism)
    asked = stash(asked.repartition(width).mapInArrow(walk, "id long, v binary, weights binary"), "asked")
    blocks, parts = -(-n // BLOCK), max(1, -(-asked.count() // QUERIES))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = index.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    want = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    part_of = min(1.0, reach * n ** (-1 / 3))

    def rerank(rows: pa.Table, want: pa.Table) -> pa.Table:
        ids = np.asarray(rows.column("id"))
        out = []
        if len(ids):
            x = matrix(rows.column("v"), dim)
            at = np.ascontiguousarray(np.frombuffer(b"".join(rows.column("leaves").to_pylist()), "<i4").reshape(len(ids), trees).T)
            for query, v, told in zip(want.column("id").to_pylist(), want.column("v").to_pylist(), want.column("weights").to_pylist()):
                who = candidates(np.frombuffer(told, np.uint8), at, part_of)
                who = who[ids[who] != query]
                score = np.einsum("ij,j->i", x[who], np.frombuffer(v))  # row by row, so that copies have equal scores
                if len(who) > k:
                    good = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                    who, score = who[good], score[good]
                best = np.lexsort((ids[who], -score))[:k]
                out.append((np.full(len(best), query), ids[who[best]], score[best]))
        a, b, s = (np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3))
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

    near = rows.groupBy("block", "part").cogroup(want.groupBy("block", "part")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
