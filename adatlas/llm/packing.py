"""Best-fit packing: documents' token ids into as few sequences as can be, by a grouping genetic algorithm on islands.

Documents are tokenized in one pass; only those longer than a sequence are cut. Pieces that fill a sequence are one.
The others are dealt at random into shards of a bounded number of pieces and put into bins by best fit, longest first.
Each shard with more bins than a lower bound is bred; then its well-filled bins are done, and the pieces of all others are
dealt again into fewer shards, until one shard is left or they get no fewer. Breeding: several islands, each a task of its
own, hold packings; a child takes over whole well-filled bins of one parent, bins of the other that hold any of the same
pieces go, and the displaced pieces are put in by best fit. Between rounds each island's elite moves to the next island.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adatlas.llm.common import chunks, discard, mapped, stash
from adatlas.llm.subwords import word_ids

MOST, END = 4096, 1
#: Pieces of a shard about; islands; rounds, with a migration between them; packings of an island; children of a round.
SHARD, ISLANDS, ROUNDS, PEOPLE, CHILDREN = 2048, 3, 4, 6, 30
#: Bins filled less than this part are packed again with those of other shards; pieces left over that are too many to go on.
POOR, STUCK = 0.995, 0.9


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized(docs: DataFrame, path: str | None = None, most: int = MOST, end: int = END, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""
    path = path or vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            rows = []
            for part, data, offsets in chunks(batch):
                ids, at = words.encode(data, offsets)
                ids, at = ids.astype("<u4").tobytes(), at.tolist()
                for name, a, b in zip(names[part], at, at[1:]):
                    own = ids[4 * a : 4 * b] + int(end).to_bytes(4, "little")
                    for k, s in enumerate(range(0, b - a + 1, most)):
                        piece = own[4 * s : 4 * (s + most)]
                        rows.append((name, k, s, len(piece) // 4, zlib.crc32(piece)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(source, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def least_bins(sizes: list[int], most: int) -> int:
    """Fewer bins than this there can't be, whatever the packing.

    For each k up to half a bin: pieces above most - k share a bin with none of k or more, those above a half are apart
    from each other, and pieces from k to a half that overflow the room beside these need bins of their own.
    """
    if not sizes:
        return 0
    x = np.sort(np.asarray(sizes, np.int64))
    upto = np.concatenate(([0], np.cumsum(x)))
    half = int(np.searchsorted(x, most // 2, "right"))  # of here on two never share a bin
    at = np.concatenate(([0], np.flatnonzero(np.diff(x[:half])) + 1))  # where k grows; with k = x[0] all pieces count
    alone = np.maximum(np.searchsorted(x, most - x[at], "right"), half) if half else np.array([len(x)])
    room = (alone - half) * most - (upto[alone] - upto[half])
    return int((len(x) - half + np.maximum(0, -(-(upto[half] - upto[at] - room) // most))).max())


class Packing:
    """Bins of piece numbers with their sums; bins with room are kept in order of room for best fit."""

    def __init__(self, sizes: list[int], most: int):
        self.sizes, self.most = sizes, most
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def copy_of(self, bins: list[list[int]]) -> Packing:
        self.bins = [list(b) for b in bins]
        self.fill = [sum(map(self.sizes.__getitem__, b)) for b in self.bins]
        return self

    def best_fit(self, pieces: list[int]) -> Packing:
        """Puts each piece, in the given order, into the fullest bin that has room for it."""
        room = sorted((self.most - f, k) for k, f in enumerate(self.fill) if f < self.most)
        for p in pieces:
            size = self.sizes[p]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, k = room.pop(at)
                self.bins[k].append(p)
                self.fill[k] += size
            else:
                left, k = self.most, len(self.bins)
                self.bins.append([p])
                self.fill.append(size)
            if left > size:
                insort(room, (left - size, k))
        return self

    def worth(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (the mean square of the fill)."""
        return -len(self.bins), sum((f / self.most) ** 2 for f in self.fill) / max(1, len(self.fill))

    def assigned(self) -> list[int]:
        out = [0] * len(self.sizes)
        for k, b in enumerate(self.bins):
            for p in b:
                out[p] = k
        return out


def from_assigned(sizes: list[int], most: int, bin_of: list[int]) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(bin_of, default=-1) + 1)]
    for p, k in enumerate(bin_of):
        bins[k].append(p)
    return Packing(sizes, most).copy_of(bins)


def crossed(one: Packing, two: Packing, rng: random.Random) -> Packing:
    """A child of one and two: whole well-filled bins of `two` are injected into `one`, its bins with any of their pieces go, and the displaced pieces are best-fitted, longest first. A few of the worst bins are dissolved as well."""
    order = sorted(range(len(two.bins)), key=lambda k: -two.fill[k])
    top = order[: max(1, len(order) // 2)]
    injected = rng.sample(top, max(1, rng.randint(1, max(1, len(top) // 3))))
    taken = {p for k in injected for p in two.bins[k]}
    kept = [k for k, b in enumerate(one.bins) if taken.isdisjoint(b)]
    poor = set(sorted(kept, key=lambda k: one.fill[k])[: rng.randint(1, 4)])
    bins = [two.bins[k] for k in injected] + [one.bins[k] for k in kept if k not in poor]
    child = Packing(one.sizes, one.most).copy_of(bins)
    held = {p for b in bins for p in b}
    loose = [p for p in range(len(one.sizes)) if p not in held]
    return child.best_fit(sorted(loose, key=lambda p: -one.sizes[p]))


def bred(sizes: list[int], most: int, seeds: list[list[int]], seed: int) -> list[list[int]]:
    """One round of an island: the bins of each piece in its best packings, the best first. seeds: packings that came in."""
    rng, least = random.Random(seed), least_bins(sizes, most)
    people = [from_assigned(sizes, most, s) for s in seeds]
    if not people:
        people = [Packing(sizes, most).best_fit(sorted(range(len(sizes)), key=lambda p: -sizes[p]))]
    while len(people[0].bins) > least and len(people) < PEOPLE:
        spread = rng.choice((1.2, 1.5, 2.0))
        people.append(Packing(sizes, most).best_fit(sorted(range(len(sizes)), key=lambda p: -sizes[p] * rng.uniform(1, spread))))
    people.sort(key=Packing.worth, reverse=True)
    for _ in range(CHILDREN):
        if len(people[0].bins) <= least or len(people) < 2:
            break
        one, two = (min(rng.sample(range(len(people)), 2)) for _ in range(2))
        child = crossed(people[one], people[two], rng)
        people[-1] = max(people[-1], child, key=Packing.worth)
        people.sort(key=Packing.worth, reverse=True)
    return [p.assigned() for p in people[:2]]


def dealt(pieces: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, pieces, sizes): a stored table of pieces dealt at random, about SHARD to a shard."""
    row = F.struct(*pieces.columns)
    at = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(shards))
    own = pieces.select(at.alias("shard"), row.alias("p")).groupBy("shard").agg(F.sort_array(F.collect_list("p")).alias("pieces"))
    return stash(own.withColumn("sizes", F.transform("pieces", lambda p: p.length.cast("int"))), "shards")


def fitted(whole: DataFrame, most: int) -> DataFrame:
    """(shard, bin_of, bins, least): each shard by best fit, longest first; least: fewer there can't be."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, sizes in zip(batch.column("shard").to_pylist(), batch.column("sizes").to_pylist()):
                done = Packing(sizes, most).best_fit(sorted(range(len(sizes)), key=lambda p: -sizes[p]))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([done.assigned()], pa.list_(pa.int32())), pa.array([len(done.bins)], pa.int32()), pa.array([least_bins(sizes, most)], pa.int32())], ["shard", "bin_of", "bins", "least"])

    return stash(whole.select("shard", "sizes").mapInArrow(fit, "shard long, bin_of array<int>, bins int, least int"), "fitted")


def islands(whole: DataFrame, fits: DataFrame, most: int, seed: int) -> DataFrame:
    """(shard, bred): the best packing found on the islands of each shard that best fit leaves above its least number of bins."""
    above = whole.select("shard", "sizes").join(fits.where("bins > least").select("shard", "bin_of"), "shard")
    home = stash(above.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))), "home")
    width = max(1, whole.sparkSession.sparkContext.defaultParallelism)
    state, done = home.select("shard", "island", "sizes", F.array("bin_of").alias("seeds")), None
    for r in range(ROUNDS):

        def breed(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    best = bred(row["sizes"], most, row["seeds"], hash((seed, r, row["shard"], row["island"])))
                    head = from_assigned(row["sizes"], most, best[0])
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([best], pa.list_(pa.list_(pa.int32()))), pa.array([len(head.bins)], pa.int32()), pa.array([head.worth()[1]], pa.float64())], ["shard", "island", "best", "bins", "worth"])

        before, done = done, stash(state.repartition(4 * width, "shard", "island").mapInArrow(breed, "shard long, island int, best array<array<int>>, bins int, worth double"), "islands")
        if before is not None:
            discard(before)
        elite = done.select(F.col("shard").alias("to_shard"), ((F.col("island") + 1) % ISLANDS).alias("to_island"), F.get("best", F.lit(0)).alias("guest"))
        state = home.join(done.select("shard", "island", "best"), ["shard", "island"]).join(elite, (F.col("shard") == F.col("to_shard")) & (F.col("island") == F.col("to_island")))
        state = state.select("shard", "island", "sizes", F.concat("best", F.array("guest")).alias("seeds"))
    return done.groupBy("shard").agg(F.max_by(F.get("best", F.lit(0)), F.struct(-F.col("bins"), "worth", -F.col("island"))).alias("bred"))


def laid_out(whole: DataFrame, bins: DataFrame, base: int) -> DataFrame:
    """The pieces with sequence_id (from base on), offset and fill. bins: (shard, bin_of)."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size, at = np.asarray(batch.column("sizes")[k].values), np.asarray(batch.column("bin_of")[k].values)
                order = np.argsort(at, kind="stable")
                upto = np.cumsum(size[order]) - size[order]
                begin = np.searchsorted(at[order], at[order])
                place = np.empty(len(size), np.int64)
                place[order] = upto - upto[begin]
                fill = np.bincount(at, size)[at].astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(k, 1), pa.array([place], pa.list_(pa.int64())), pa.array([fill], pa.list_(pa.int64())), batch.column("bin_of").slice(k, 1)], ["shard", "offset", "fill", "bin"])

    places = whole.select("shard", "sizes").join(bins, "shard").mapInArrow(lay, "shard long, offset array<long>, fill array<long>, bin array<int>")
    flat = whole.select("shard", "pieces").join(places, "shard").select("shard", F.explode(F.arrays_zip("pieces", "offset", "fill", "bin")).alias("z"))
    return flat.select("z.pieces.*", (F.lit(base) + F.col("shard") * (1 << 20) + F.col("z.bin")).cast("long").alias("sequence_id"), F.col("z.offset").alias("offset"), F.col("z.fill").alias("fill"))


def pack(docs: DataFrame, path: str | None = None, most: int = MOST, end: int = END, text: str = "text", key: str = "doc_id", seed: int = 11) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Texts of any length are read whole. Repeated rows are packed each; a null
    key stays null; other columns are ignored; an empty table gives an empty result.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = stash(tokenized(docs, path, most, end, text, key), "pieces")
    out = pieces.where(F.col("length") == most).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    loose, level, before, last = pieces.where(F.col("length") < most), 0, None, False
    while not last:
        n = loose.count()
        shards = max(1, -(-n // SHARD))
        last = shards == 1 or before is not None and n >= STUCK * before
        whole = dealt(loose, shards, seed + level)
        fits = fitted(whole, most)
        bins = fits.select("shard", "bin_of")
        if fits.where("bins > least").head(1):
            bins = fits.join(islands(whole, fits, most, seed + level), "shard", "left").select("shard", F.coalesce("bred", "bin_of").alias("bin_of"))
        done = stash(laid_out(whole, bins, level << 50), "packed")
        rich = done if last else done.where(F.col("fill") >= POOR * most)
        out = out.unionByName(rich.select(*columns, "sequence_id", "offset"))
        loose, level, before = done.where(F.col("fill") < POOR * most).select(*columns), level + 1, n
    return out.withColumnRenamed("doc_id", key)


def op4(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
