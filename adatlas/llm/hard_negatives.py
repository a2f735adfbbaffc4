"""Hard-negative mining by Kronecker-packed products.

Components are whole numbers. Biased to be positive, the components of several candidates are put into separate fields of
one wide number; one product for each anchor component then serves all of them, and the sums come apart again, as no
field can carry into the next. As many fields are packed as fit the 53 bits in which doubles are exact; where components
are so large that none fits, the same is done with Python's unbounded integers.

Anchors are a stated set; every row is a candidate. Both are dealt into blocks of bounded size, and every pair of blocks
is a task that returns a bounded number of rows for each anchor: first its best positives, then, when these are known
from all blocks, the best negatives for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adatlas.llm.common import stash

#: Candidates and anchors of a block at most, components of a block at most, candidates multiplied at once.
BLOCK, ANCHORS, CELLS, AT_ONCE = 8192, 1024, 1 << 22, 2048
#: Bits in which a double is exact; fields of an unbounded integer.
EXACT_BITS, FIELDS = 53, 8


def whole(df: DataFrame, scale: int, key: str, vector: str, label: Column) -> DataFrame:
    """(row, id, label, dim, v): v holds floor(scale * x) of each component as little-endian doubles; row is a hash of the others.

    Left out are rows with a null id or label and vectors that are null or hold a null or non-finite component, or one
    that isn't finite any more when scaled. Rows that repeat all of these are one.
    """
    own = df.where(F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull())
    own = own.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            dims = np.asarray(lists.value_lengths(), np.int64)
            ends = np.cumsum(dims)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(np.asarray(lists.flatten().fill_null(np.nan), np.float64) * scale) + 0.0  # no negative zero
            wrong = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            good = np.flatnonzero(wrong[ends] == wrong[ends - dims])
            v = [x[ends[k] - dims[k] : ends[k]].tobytes() for k in good.tolist()]
            take = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(dims[good].astype(np.int32)), pa.array(v, pa.binary())], ["id", "label", "dim", "v"])

    own = own.mapInArrow(parse, "id long, label long, dim int, v binary").distinct()
    return own.withColumn("row", F.xxhash64("id", "label", "dim", "v"))


def packed(c: np.ndarray, bias: int, width: int, fields: int) -> np.ndarray:
    """Candidates' components, biased, `fields` candidates to one number; what is left of the last group stays empty."""
    c = np.concatenate((c + bias, np.zeros((-len(c) % fields, c.shape[1]), c.dtype))).reshape(-1, fields, c.shape[1])
    out = c[:, 0].copy()
    for f in range(1, fields):
        out = out + c[:, f] * (1 << width * f)
    return out


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of c, whole numbers held as doubles.

    With a' = a + m and c' = c + n, none negative, sum a'c' stays below 2**width, so that a row of a' times packed rows
    of c' holds one sum in each field; sum ac = sum a'c' - m sum c' - n sum a' + dim m n.
    """
    dim, (m, n) = a.shape[1], (int(np.abs(x).max()) if x.size else 0 for x in (a, c))
    width = max(1, (dim * 2 * m * 2 * n).bit_length())
    fields = EXACT_BITS // width
    if fields:
        up, kind = a + m, np.int64
    else:
        exact = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
        a, c, fields, kind = exact(a), exact(c), FIELDS, object
        up = a + m
    wide = up @ packed(c, n, width, fields).T if dim else np.zeros((len(a), -(-len(c) // fields)))
    wide = wide.astype(kind)
    out = np.empty((len(a), wide.shape[1] * fields), kind)
    for f in range(fields):
        out[:, f::fields] = (wide >> width * f) & ((1 << width) - 1)
    sums = lambda x: x.sum(1).astype(kind) if dim else np.zeros(len(x), kind)
    return out[:, : len(c)] - (m * (sums(c) + dim * n))[None, :] - (n * (sums(a) + dim * m))[:, None] + dim * m * n


def best(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of some scores; of equal ones those that stand first."""
    s = scores[among]
    if len(s) > 4 * k and s.dtype != object:
        among = among[s >= np.partition(s, len(s) - k)[len(s) - k]]
        s = scores[among]
    return among[np.argsort(-s, kind="stable")[:k]]


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), dim)


def dealt(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and anchors in blocks i (of anchors) and j (of candidates), for each number of components apart."""
    most = lambda n: F.greatest(F.lit(1), F.least(F.lit(n), F.floor(F.lit(CELLS) / F.greatest("dim", F.lit(1)))))
    count = lambda df, n, name: df.groupBy("dim").agg(F.ceil(F.count("*") / F.first(most(n))).cast("int").alias(name))
    blocks = count(rows, BLOCK, "cs").join(count(anchors, ANCHORS, "as"), "dim")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cands = rows.join(blocks, "dim").withColumn("i", each("as")).withColumn("j", F.pmod("row", "cs").cast("int")).drop("as", "cs")
    own = anchors.join(blocks, "dim").withColumn("j", each("cs")).withColumn("i", F.pmod(F.xxhash64("row"), F.col("as")).cast("int")).drop("as", "cs")
    return cands, own


def tiled(rows: DataFrame, anchors: DataFrame, picked, schema: str) -> DataFrame:
    """Every pair of blocks is a task. picked(anchors, at, candidates, scores) yields rows of the schema for the anchor at `at`; candidates stand in order of id."""
    cands, own = dealt(rows, anchors)
    names = [c.split()[0] for c in schema.split(", ")]

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        left = left.rename_columns([c.removeprefix("of_") for c in left.column_names])
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            right = right.sort_by([("id", "ascending"), ("label", "ascending"), ("row", "ascending")])
            c = {k: np.asarray(right.column(k)) for k in ("id", "label", "row")}
            a, v = matrix(left.column("v"), dim), matrix(right.column("v"), dim)
            left = left.drop(["v"]).to_pylist()
            some = max(1, CELLS // max(1, len(v)))
            for at in range(0, len(a), some):
                scores = np.concatenate([products(a[at : at + some], v[to : to + AT_ONCE]) for to in range(0, len(v), AT_ONCE)], 1)
                for k, anchor in enumerate(left[at : at + some]):
                    out += picked(anchor, c, scores[k])
        return pa.table({name: pa.array([r[k] for r in out], pa.int64()) for k, name in enumerate(names)})

    own = own.toDF(*[f"of_{c}" for c in own.columns])  # both sides come from the same rows
    return own.groupBy("of_i", "of_j", "of_dim").cogroup(cands.groupBy("i", "j", "dim")).applyInArrow(tile, schema)


def bounded(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    is_anchor: a condition on `id`. An anchor's positives are its best other rows of the same label; to each of them
    belong its first rows of other labels whose score is from low % to high % of the positive's. Better is a greater
    inner product of floor(scale * component), then the smaller id. Compared are vectors of equal length.

    Rows without id, label or vector and vectors with a null or non-finite component take no part; zero and empty
    vectors do. Rows repeating id, label and vector are one; where an id comes with several labels or vectors, each is a
    row of its own, and other rows of an anchor's id are among its candidates. Scores beyond a long are compared
    exactly and returned as the nearest long. Other columns are ignored; an empty table gives an empty result.
    """
    rows = stash(whole(df, scale, key, vector, F.col(label) if isinstance(label, str) else label), "whole")
    anchors = rows.where(is_anchor)

    def same(anchor: dict, c: dict, scores: np.ndarray) -> Iterator[tuple]:
        among = np.flatnonzero((c["label"] == anchor["label"]) & (c["row"] != anchor["row"]))
        for k in best(scores, among, positives).tolist():
            yield anchor["row"], int(c["id"][k]), int(c["row"][k]), bounded(scores[k])

    found = tiled(rows, anchors, same, "anchor long, id long, row long, score long")
    first = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id", "row"))
    found = found.withColumn("place", first).where(F.col("place") <= positives)
    mates = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("mates"))  # at most `positives`
    anchors = stash(anchors.join(mates, F.col("anchor") == F.col("row")).drop("anchor"), "anchors")

    def other(anchor: dict, c: dict, scores: np.ndarray) -> Iterator[tuple]:
        among = np.flatnonzero(c["label"] != anchor["label"])
        own = scores[among]
        for mate in anchor["mates"]:
            least, most = -(-low * mate["score"] // 100), high * mate["score"] // 100
            for k in best(scores, among[((own >= least) & (own <= most)).astype(bool)], negatives).tolist():
                yield anchor["row"], anchor["id"], mate["place"], mate["id"], mate["score"], int(c["id"][k]), int(c["row"][k]), bounded(scores[k])

    found = tiled(rows, anchors, other, "anchor long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, row long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(own, F.col("id") % 50 == 0, label=label)


OP13_SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)
), p AS (
  SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b))::INT AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s QUALIFY rank <= 3
"""
