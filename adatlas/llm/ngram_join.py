"""N-gram Jaccard join: T-occurrence search with DivideSkip, and the groups of documents that its links make.

A document is its set of distinct word shingles. Equal sets are one class. All shingles have one order: hashes, except
that shingles found to be frequent come last (at most HEAVY, from counts within tasks). Two sets with the wanted Jaccard similarity
share at least `extra` of their first (n - need + extra) shingles, whatever the order, so

1. only those prefixes are dealt by shingle, and only shingles that two classes share stay;
2. a class that shares fewer than `extra` of them has no link and is dropped;
3. each other class goes, with its whole set, to the bucket of the smallest class on each shared shingle: any two classes
   that share a prefix shingle meet in a bucket;
4. in a bucket, each set searches the inverted lists of the others: short lists are merged by a heap, skipping to where
   enough of them may agree, long ones are probed by bisection, and sets reaching the overlap are linked.

Buckets above a size are cut into blocks by set size and every two blocks whose sizes can match are a task of their own.
A task returns a spanning forest of its links; pairs already connected in it aren't compared again.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adatlas.llm.common import chunks, components, discard, mapped, maybe_in, mix, shingle_hashes, stash, word_hashes, word_spans

#: Shingles that come last in the order, at most; how often one must stand in a window of a task's shingles, and in all that are so reported.
HEAVY, OFTEN, FREQUENT, WINDOW = 1 << 18, 3, 24, 1 << 22
#: Documents of a block of a large bucket.
BLOCK = 512
#: Hundredths of the least overlap that prefixes must share.
EXTRA = 12
#: Parts into which the rows of one bucket are dealt where they are joined with counts of it.
SALTS = 16
#: How DivideSkip weighs probing against merging.
MU = 0.01


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it may link with: 100 * overlap >= percent * union, union >= n."""
    return -(-percent * n // 100)


def overlap(n: int, m: int, percent: int) -> int:
    """The least overlap of linked sets of n and m: 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def set_key(x: np.ndarray) -> int:
    """One 64-bit number of a whole set, as a signed integer."""
    with np.errstate(over="ignore"):
        h = mix(np.array([np.add.reduce(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))) ^ mix(np.array([len(x)], np.uint64))[0]], np.uint64))
    return int(h.view(np.int64)[0])


def sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The first row and the shingle sets of each slice of a batch."""
    for rows, data, offsets in chunks(batch):
        begins, ends, first = word_spans(data, offsets)
        yield rows.start, shingle_hashes(word_hashes(data, begins, ends), first, shingle)


def prefix(x: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The prefix of a sorted set in the common order. heavy: frequent shingles, sorted, and their counts."""
    n = len(x)
    size = min(n, n - need(n, percent) + extra(n, percent))
    tokens, counts = heavy
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
        weight = np.where(tokens[at] == x, counts[at], 0)
        if weight.any():
            return x[np.lexsort((x, weight))[:size]]
    return x[:size]


def frequent(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand at least OFTEN times in some sets, and how often."""
    x = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate((at, [len(x)])))
    return x[at[runs >= OFTEN]], runs[runs >= OFTEN]


def extra(n: int, percent: int) -> int:
    """How many prefix shingles a set shares at least with any set that it links with.

    For sizes n >= m and overlap t, their prefixes share t - need(n) + extra(n) or t - need(m) + extra(m), whichever is
    less; as t >= need(n) and extra grows more slowly than need, neither is below extra of the one that is asked.
    """
    return max(1, EXTRA * need(n, percent) // 100)


class Lists:
    """Inverted lists of some sets: shingle to ascending places, only shingles that some two sets of the task share."""

    def __init__(self, members: list[np.ndarray], shared: np.ndarray):
        self.own: list[list[int]] = []
        self.lists: dict[int, list[int]] = {}
        for at, x in enumerate(members):
            x = x[np.isin(x, shared, assume_unique=True)].tolist() if len(x) else []
            self.own.append(x)
            for h in x:
                self.lists.setdefault(h, []).append(at)


def divide_skip(lists: list[list[int]], least: int, wants=None) -> Iterator[tuple[int, int]]:
    """(place, count so far) of all places that stand on at least `least` of the ascending lists.

    The longest lists are set apart; among the others places with least - (number apart) occurrences are found by a
    heap that jumps over places that can't reach it, then counted on by bisection in the lists set apart. wants: gives
    for a place the next one that is asked for (itself if it is), None if there is none.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least:
        return
    apart = min(least - 1, int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)), len(lists))
    merged, probed = lists[: len(lists) - apart], lists[len(lists) - apart :]
    wanted = least - apart
    at = [0] * len(merged)
    heap = [(x[0], k) for k, x in enumerate(merged)]
    heapq.heapify(heap)
    while len(heap) >= wanted:
        place, same = heap[0][0], []
        to = place if wants is None else wants(place)
        if to is None:
            return
        if to > place:  # all lists jump to the next place that is asked for
            while heap and heap[0][0] < to:
                same.append(heapq.heappop(heap)[1])
        else:
            while heap and heap[0][0] == place:
                same.append(heapq.heappop(heap)[1])
            if len(same) >= wanted:
                count = len(same)
                for k, x in enumerate(probed):
                    if count + len(probed) - k < least:
                        break
                    i = bisect_left(x, place)
                    count += i < len(x) and x[i] == place
                if count >= least:
                    yield place, count
                to = place + 1
            else:  # pop until wanted - 1 lists are out, then let all of them jump to the next place on the heap
                while heap and len(same) < wanted - 1:
                    same.append(heapq.heappop(heap)[1])
                if not heap:
                    return
                to = heap[0][0]
        for k in same:
            at[k] = bisect_left(merged[k], to, at[k])
            if at[k] < len(merged[k]):
                heapq.heappush(heap, (merged[k][at[k]], k))


def links(members: list[np.ndarray], sizes: list[int], percent: int, side: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, in ascending order of size. side: only links between different sides.

    A set is only searched for among the sets before it that it isn't connected with yet.
    """
    found: list[tuple[int, int]] = []
    if len(members) < 2:
        return found
    every = np.concatenate(members)
    every.sort()
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    index, group = Lists(members, shared), np.arange(len(members))
    sides = None if side is None else np.array(side)
    for a, own in enumerate(index.own):
        n = sizes[a]
        low = bisect_left(sizes, need(n, percent))  # smaller sets come first; each pair is met from its larger side
        least = overlap(n, sizes[low], percent)
        if low >= a or len(own) < least:
            continue

        def asked() -> list[int]:
            """Places of sets that a isn't connected with."""
            open_ = group[low:a] != group[a]
            if sides is not None:
                open_ &= sides[low:a] != sides[a]
            return (low + np.flatnonzero(open_)).tolist()

        places = asked()
        if not places:
            continue

        def wants(place: int) -> int | None:
            i = bisect_left(places, place)
            return places[i] if i < len(places) else None

        near = [x[bisect_left(x, low) : bisect_left(x, a)] for x in map(index.lists.__getitem__, own)]
        for b, count in divide_skip(near, least, wants):
            if count >= overlap(n, sizes[b], percent):
                found.append((a, b))
                group[group == group[b]] = group[a]
                places = asked()
    return found


def join(docs: DataFrame, percent: int = 85, shingle: int = 4, text: str = "text", key: str = "doc_id", heads: bool = False) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id (the smallest key reachable by links, itself included).

    Words are runs of non-space bytes with A-Z lower-cased. Two rows link when 100 * shared >= percent * all of their
    shingles. Null, empty and blank texts have an empty set and no link; a text shorter than a shingle is one shingle.
    Equal texts link; repeated rows too. Rows that share a key but no link are apart. A row without a key takes the
    component of those it links with, null if none of them has a key. An empty table gives an empty result. Other
    columns are ignored.

    heads: instead one row for each group, (id, hash), which is the key and the xxhash64 of the text of a row of it,
    that with the smallest key; every row without words is a group of its own (key and hash are null where these are).
    """
    source = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    signed = stash(mapped(source, partial(sign, shingle=shingle), "id long, hash long, n long, cls long, token long"), "signed")
    rows = signed.where("token is null").select("id", "hash", "n", "cls")
    shared = docs.sparkSession.sparkContext.broadcast(heavy_tokens(signed))
    # a class is told by one row: the smallest id, null last
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "hash"))
    classes = stash(rows.where("cls is not null").groupBy("cls").agg(first.alias("rep"), F.max("n").alias("n")), "classes")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return prefixes(batches, shingle, percent, shared.value)

    dealt = mapped(source.select("text"), begin, "token long, cls long")
    dealt = mapped(dealt.repartition("token").sortWithinPartitions("token", "cls"), meet, "cls long, bucket long")
    met = stash(dealt.groupBy("cls", "bucket").agg(F.count("*").alias("n_shared")), "met")
    routed = stash(routes(met, classes, percent), "routed")
    discard(met)
    # salted, as a bucket of near copies may hold many of all rows
    salt = F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")
    filled = routed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    filled = filled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = routed.withColumn("salt", salt).join(filled, ["bucket", "salt"])
    small = counted.where("blocks = 1").select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "cls", "rep")
    large = blocked(stash(counted.where("blocks > 1"), "large"), percent)
    tasks = F.collect_list(F.struct("cls", "bucket", "i", "j", "block"))  # of one class
    wanted = stash(small.unionByName(large).groupBy("rep.id", "rep.hash").agg(tasks.alias("tasks")), "wanted")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return with_sets(batches, shingle)

    asked = wanted.withColumnsRenamed({"id": "rep_id", "hash": "rep_hash"})
    sent = maybe_in(source, "hash", wanted, "hash").join(asked, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("hash") == F.col("rep_hash")))
    sent = mapped(sent.select("text", "tasks"), whole, "bucket long, i int, j int, block int, cls long, x binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for cls, blocks, members in by_task(batches):
            order = sorted(range(len(cls)), key=lambda k: (len(members[k]), cls[k]))
            sides = [blocks[k] for k in order]
            for s, t in links([members[k] for k in order], [len(members[k]) for k in order], percent, sides if len(set(sides)) > 1 else None):
                a.append(cls[order[s]])
                b.append(cls[order[t]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    edges = stash(mapped(sent.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), search, "a long, b long"), "links")
    groups = classes.join(components(edges), classes.cls == F.col("node"), "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    groups = stash(groups, "groups")
    least = groups.groupBy("component").agg(F.min("rep").alias("first"))
    if heads:
        return least.select("first.id", "first.hash").unionByName(rows.where("cls is null").select("id", "hash"))
    of = groups.join(least, "component").select("cls", F.col("first.id").alias("component_id"))
    return rows.join(of, "cls", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def sign(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Size and class of each text's set, and shingles found often in the task with their counts."""
    names = ["id", "hash", "n", "cls", "token"]
    window, size = [], 0

    def reported() -> pa.RecordBatch:
        tokens, counts = frequent(window)
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(counts.astype(np.int64)), none, pa.array(tokens.view(np.int64))], names)

    for batch in batches:
        n, keys = [], []
        for _, some in sets(batch, shingle):
            n += map(len, some)
            keys += [set_key(x) if len(x) else None for x in some]
            window += some
            size += sum(map(len, some))
            if size > WINDOW:
                yield reported()
                window, size = [], 0
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(len(n), pa.int64())], names)
    yield reported()


def heavy_tokens(signed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their counts: at most HEAVY."""
    heavy = signed.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    most = heavy.orderBy(F.desc("n"), "token").limit(HEAVY).toArrow()
    tokens, counts = np.asarray(most.column("token")).astype(np.int64).view(np.uint64), np.asarray(most.column("n")).astype(np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefixes(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(token, cls) for the prefix of each text's set; copies within a task are sent once."""
    done: set[int] = set()
    for batch in batches:
        for _, some in sets(batch, shingle):
            cls, tokens = [], []
            for x in some:
                if len(x) and (k := set_key(x)) not in done:
                    if len(done) < 1 << 20:
                        done.add(k)
                    p = prefix(x, heavy, percent)
                    cls.append(np.full(len(p), k, np.int64))
                    tokens.append(p.view(np.int64))
            if cls:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(cls))], ["token", "cls"])


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (token, cls) in this order: (cls, bucket) for every token of at least two classes, bucket being the smallest of them."""
    now, head, last, told = None, 0, 0, True  # the token at the end of the batch before, its first and last class, whether the first was sent
    for batch in batches:
        if not batch.num_rows:
            continue
        token, cls = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        fresh = np.concatenate(([token[0] != now], token[1:] != token[:-1]))
        copy = ~fresh & (cls == np.concatenate(([last], cls[:-1])))
        group = np.cumsum(fresh)  # 0: the token of the batch before
        heads = np.concatenate(([head], cls[fresh]))
        send = ~fresh & ~copy & (cls != heads[group])
        joined = np.unique(group[send])  # tokens whose first class has company
        if told:
            joined = joined[joined > 0]
        more = heads[joined]
        out = np.concatenate((cls[send], more)), np.concatenate((heads[group[send]], more))
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["cls", "bucket"])
        at_end = group[-1]
        told = bool((at_end == 0 and told) or (len(joined) and joined[-1] == at_end))
        now, head, last = token[-1], heads[at_end], cls[-1]


def routes(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(cls, bucket, rep, n): where each class has to go.

    A class that shares fewer than `extra` of its prefix with others has no link. One that shares s of them shares
    `extra` with each class that it links with: with all tokens in one order, by the load of their buckets, the first
    token of the two is among the first s - extra + 1, so that buckets beyond these, the fullest, need no visit.
    """
    salt = F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")  # a bucket may hold many of all rows
    load = met.groupBy("bucket").agg(F.count("*").alias("load")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = met.withColumn("salt", salt).join(load, ["bucket", "salt"]).join(classes, "cls")
    least = F.expr(f"greatest(1, {EXTRA} * ((n * {percent} + 99) div 100) div 100)")
    order = W.partitionBy("cls").orderBy("load", "bucket")  # at most as many rows as a prefix has tokens
    upto = F.sum("n_shared").over(order) - F.col("n_shared")
    all_of = F.sum("n_shared").over(W.partitionBy("cls"))
    return told.withColumns({"upto": upto, "shared": all_of}).where(F.col("upto") <= F.col("shared") - least).select("cls", "bucket", "rep", "n")


def with_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The whole set of each text for every task of it."""
    names, kinds = ["bucket", "i", "j", "block", "cls"], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    for batch in batches:
        for start, some in sets(batch, shingle):
            out = [(t, x) for k, x in enumerate(some) if len(x) for t in batch.column("tasks")[start + k].as_py()]
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array([t[c] for t, _ in out], k) for c, k in zip(names, kinds)), pa.array([x.astype("<u8").tobytes() for _, x in out], pa.binary())], [*names, "x"])


def blocked(counted: DataFrame, percent: int) -> DataFrame:
    """Cuts each large bucket into blocks by set size, and gives one task to every two blocks that can hold a link.

    Set sizes are first counted, so that the cut needs no order over a bucket's rows: classes of one size are dealt by
    hash over as many blocks as they fill, and small neighbouring sizes share a block.
    """
    counts = counted.groupBy("bucket", "n").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy("bucket").orderBy("n"))
    cuts = counts.withColumn("begin", F.floor((upto - F.col("c")) / BLOCK)).withColumn("wide", F.ceil(F.col("c") / BLOCK))
    cuts = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = counted.join(cuts, ["bucket", "n", "salt"]).withColumn("block", (F.col("begin") + F.pmod(F.xxhash64("cls"), F.col("wide"))).cast("int"))
    placed = stash(placed.select("bucket", "block", "cls", "rep", "n"), "placed")
    spans = placed.groupBy("bucket", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = spans.select("bucket", F.col("block").alias("i"), F.col("high").alias("high_i")), spans.select("bucket", F.col("block").alias("j"), F.col("low").alias("low_j"))
    pairs = left.join(right, "bucket").where(f"i <= j and 100 * high_i >= {percent} * low_j")  # a row for each two blocks, not documents
    pairs = stash(pairs.select("bucket", "i", "j"), "pairs")
    one = placed.join(pairs, (placed.bucket == pairs.bucket) & (placed.block == pairs.i)).select(placed.bucket, "i", "j", "block", "cls", "rep")
    two = placed.join(pairs, (placed.bucket == pairs.bucket) & (placed.block == pairs.j)).where("i < j").select(placed.bucket, "i", "j", "block", "cls", "rep")
    return one.unionByName(two)


def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Groups rows that arrive sorted by (bucket, i, j): classes, blocks and sets of one task at a time."""
    now, cls, blocks, members, seen = None, [], [], [], set()
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in range(3)))
        for key, block, k, x in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
            if key != now:
                if len(cls) > 1:
                    yield cls, blocks, members
                now, cls, blocks, members, seen = key, [], [], [], set()
            if k not in seen:  # a repeated row
                seen.add(k)
                cls.append(k)
                blocks.append(block)
                members.append(np.frombuffer(x.as_buffer(), "<u8"))
    if len(cls) > 1:
        yield cls, blocks, members


def op1(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w
), c AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM s GROUP BY ALL
), t AS (
  SELECT rep, n, unnest(s) AS t FROM c
), o AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS o FROM t a JOIN t b ON a.t = b.t AND a.rep <> b.rep AND b.n * 100 >= 85 * a.n AND a.n * 100 >= 85 * b.n GROUP BY ALL
), p AS (
  SELECT a, b FROM o WHERE 100 * o >= 85 * (na + nb - o)
), r AS (
  SELECT a AS id, a AS far FROM p UNION SELECT r.id, p.b FROM r JOIN p ON r.far = p.a
), m AS (
  SELECT id, min(far) AS m FROM r GROUP BY id
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce(least(m.m, c.rep), c.rep) END AS component_id
FROM s JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON m.id = c.rep
"""
