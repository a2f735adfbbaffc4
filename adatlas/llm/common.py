"""What several operators of this subpackage share: the folder for cut lineage,
words and their hashes from whole Arrow text columns, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of all word rules here: the bytes 0x20 and 0x09 to 0x0D, which never occur inside a UTF-8 character.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text handled at once by the numpy code; one longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir. Only where that is unset and Spark runs on this machine alone, as in tests, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("adatlas.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="adatlas-")
        spark.conf.set("adatlas.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later steps survive lost executors and don't compute it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a stashed table from which nothing will be read any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a filter for each key, and in all at least and at most, as powers of two: at most 32 MB are broadcast.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 28


def maybe_in(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose hash in `column` may be among `keys`: all that are, and few others.

    A filter of one bit for each hash, of bounded size, spares the shuffle of most rows before an exact join. Beyond
    2**28 bits more of the other rows pass, and none of the wanted ones is lost.
    """
    n = keys.count()
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))
    spot = F.pmod(F.col(key), F.lit(bits))
    maps = keys.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("__bits"))
    own = df.withColumn("__spot", F.pmod(F.col(column), F.lit(bits)))
    own = own.join(F.broadcast(maps), F.bitmap_bucket_number("__spot") == F.col("__bucket"))
    at = F.bitmap_bit_position("__spot")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return own.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("__spot", "__bucket", "__bits")


#: Bytes of rows that are handed to Python at once, and rows of a Parquet file that are decoded at once, at most, unless the session
#: says so itself. Spark's own 4096 rows of whole texts are arrays of 16 MB and more on the heap of each task.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def mapped(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in batches bounded by bytes; a worker gives back what memory it holds when a task ends."""
    spark = df.sparkSession
    for bound, most in BOUNDS.items():
        if not spark.sparkContext.getConf().contains(bound):
            spark.conf.set(bound, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n (null for null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def crc_mod_py(value: int | None, n: int) -> int | None:
    return None if value is None else zlib.crc32(str(value).encode()) % n


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins and ends in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.RecordBatch | pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Cuts a column of texts (of a batch: `text`) between documents into slices of about `most` bytes: rows, their bytes, their offsets."""
    data, offsets = text_bytes(texts.column("text") if isinstance(texts, pa.RecordBatch) else texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte begin and end of every word, and for each document the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1]))
    after = np.concatenate((solid[1:], [False]))
    begins = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept for chunks of usual length."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for p in (_P, _P_INV):
        x = np.full(n, p, np.uint64)
        x[:1] = 1
        made.append(np.multiply.accumulate(x))
    if n <= 2 * CHUNK_BYTES:
        _POWERS[:] = made
    return made[0], made[1]


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased first: a polynomial in prefix sums, then mixed with the length."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data))
    x = (_LOWER[data] if lower else data).astype(np.uint64)
    x += np.uint64(1)
    x *= power
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return mix((total[ends] - total[begins]) * inverse[begins] + mix((ends - begins).astype(np.uint64)))


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """For each document its set of distinct n-word shingles as sorted hashes; a shorter one is a single shingle; without words the set is empty."""
    k = np.uint64(0xD6E8FEB86659FD93)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        rolled = (rolled * k) ^ mix(words[i : i + len(rolled)] + np.uint64(i + 1))
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            x = rolled[a : b - n + 1].copy()
            x.sort()
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x)
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = (h * k) ^ mix(np.array([w]))[0]
            out.append(mix(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph of long ids: (node, component), component the smallest id reachable.

    Each round takes the smallest label among the neighbours and then jumps to the label's own label, so that
    long chains close in a number of rounds near the logarithm of their length. Only counts reach the driver; the
    state is written to the shared folder each round, that of the round before deleted. Null ends are dropped; an empty edge table gives an empty result.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = stash(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stash(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    held = labels
    for _ in range(rounds):
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.u).select("node", F.least("label", "near").alias("low"), (F.col("near") < F.col("label")).alias("moved"))
        to = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = low.join(to, low.low == to.at, "left").select("node", F.least("low", "further").alias("label"), (F.col("moved") | (F.col("further") < F.col("low"))).alias("moved"))
        new = stash(new, "labels")
        discard(held)
        held, labels = new, new.select("node", "label")
        if not new.where("moved").head(1):
            discard(both)
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


class UnionFind:
    """Disjoint sets of 0..n-1 within one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y
