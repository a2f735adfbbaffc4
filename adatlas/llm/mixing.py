"""Mixing sources to target weights: capped water-filling over sources, then seeded whole and fractional repetitions.

DataFrame functions only. The rows of a source are never brought together. First the few documents are decided that hold
more than 1/1024 of their source each, then the others: the cut between those that are taken once more and those that
aren't is found among 4096 hash cells of each source from their summed sizes, then exactly among the documents of the
one cell in which it lies. What is still open is filled from the documents that weren't taken, the longest that fit
first. All is decided on a few numbers of each document; texts stay where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adatlas.functions.ordered import in_order
from adatlas.llm.common import stash

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, source: str) -> DataFrame:
    """Adds `place`, from 0, by code point with null last, by a range-partitioned sort: no task sees all sources."""
    order = [F.col(source).isNull(), F.col(source)]
    parts = stash(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    before = parts.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part")) - F.col("count")).drop("count")  # a row for each partition
    within = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("within", within).join(before, "part").withColumn("place", F.col("before") + F.col("within")).drop("part", "within", "before")


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Capped water-filling. sources: (source, source_size, place). Adds `target`, null-free.

    What is to be shared is `share` times all sizes, by weight; sources above `most` times their size stop there and
    their excess is shared among the others by weight, until none is above. Each round is one aggregate over sources.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    at = stash(sources.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(most))), "sources")
    total = at.agg(F.sum("source_size")).first()[0] or 0
    goal, level = float(total) * share, 0.0
    while True:
        # clamped at this level: those whose share at it would pass their cap
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        clamped, free = at.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        new = (goal - (clamped or 0.0)) / free
        if new <= level * (1 + 1e-12):
            break
        level = new
    return at.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)))


#: Sources whose goals, and documents whose decisions, are broadcast; beyond, they are joined by a shuffle. Hash cells of a source.
FEW, FEW_DOCUMENTS, CELLS = 10_000, 1_000_000, 4096
#: A document is long if this many of its size would be more than its source: there are fewer of them than that.
LONG = 1024
#: What tells an item, the equal rows of a key: they are taken together.
ITEM = ["h", "rid", "sid"]


def dealt(docs: DataFrame, seed: str, text: str, source: str, key: str, carry: bool) -> DataFrame:
    """(key, source, size, h, cell, rid, sid), and with `carry` the whole row: what the mix needs to know of each row."""
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    own = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("rid"), F.xxhash64(F.col(source)).alias("sid"), *row)
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("null"))).cast("binary"))
    return own.withColumn("h", hashed).withColumn("cell", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))


def filled(rest: DataFrame) -> DataFrame:
    """Of items (source, gap, words, h, rid, sid), none larger than its source's gap, those that fill it: the largest that still fits first, equal ones by hash. No item is left out that would still fit."""
    sizes = rest.groupBy("source", "gap", "words").agg(F.count("*").alias("n"))
    each = sizes.groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct("words", "n")), asc=False).alias("sizes"))  # the distinct sizes up to the gap
    take = "least(s.n, cast(floor(a.gap / s.words) as bigint))"
    step = f"if(a.gap >= s.words, named_struct('gap', a.gap - {take} * s.words, 'picks', array_append(a.picks, named_struct('words', s.words, 'm', {take}))), a)"
    start = "named_struct('gap', gap, 'picks', cast(array() as array<struct<words: bigint, m: bigint>>))"
    picks = each.select("source", F.explode(F.expr(f"aggregate(sizes, {start}, (a, s) -> {step}).picks")).alias("p")).select(F.col("source").alias("__source"), F.col("p.words").alias("__words"), F.col("p.m").alias("m"))
    met = rest.join(picks, rest.source.eqNullSafe(picks["__source"]) & (rest.words == picks["__words"]))
    return in_order(met.select("sid", "words", "m", "h", "rid"), ["sid", "words"], [(F.col("h"), False), (F.col("rid"), False)], number="nth").where("nth <= m").select(*ITEM)


def decided(docs: DataFrame, weights: list[float], share: float, most: float, seed: str, text: str, source: str, key: str, carry: bool) -> DataFrame:
    """Every row with its source's size and target and the number of `copies` that the mix takes."""
    own = dealt(docs, seed, text, source, key, False)
    own = stash(own.groupBy("source", "size", "cell", *ITEM).agg((F.count("*") * F.col("size")).alias("words")), "items")
    sums = stash(own.groupBy("source").agg(F.sum("words").alias("source_size")), "sources")
    goals = targets(ranked(sums, "source"), weights, share, most)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    goals = stash(goals.select("source", "source_size", "target", F.floor(rate + 1e-12).alias("whole")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "goals")
    same = lambda left, right: left.source.eqNullSafe(right.source)
    held = (lambda df: F.broadcast(df)) if goals.count() <= FEW else (lambda df: df)
    of = own.join(held(goals), same(own, goals)).select(own.source, "words", "cell", "rest", "source_size", *ITEM).where("words > 0")
    is_long = F.col("words") * LONG > F.col("source_size")
    # of the long ones as many, in order of hash, as come nearest to their part of what is to be taken
    all_long = W.partitionBy("source")
    upto = F.sum("words").over(all_long.orderBy(*ITEM).rowsBetween(W.unboundedPreceding, W.currentRow))
    part = F.col("rest") * F.sum("words").over(all_long) / F.col("source_size")
    long_ones = stash(of.where(is_long).withColumn("taken", (upto - F.col("words") / 2 <= part) & (upto <= F.col("rest"))), "long")  # fewer than LONG of a source
    so_far = long_ones.where("taken").groupBy(F.col("source").alias("of")).agg(F.sum("words").alias("so_far"))
    cells = stash(of.where(~is_long).groupBy("source", "cell").agg(F.sum("words").alias("size")), "cells")
    upto = F.sum("size").over(W.partitionBy("source").orderBy("cell"))
    cells = cells.withColumn("before", upto - F.col("size"))  # at most CELLS rows of a source
    goals = stash(goals.join(so_far, goals.source.eqNullSafe(F.col("of")), "left").withColumn("open", F.col("rest") - F.coalesce("so_far", F.lit(0))).drop("of"), "goals")
    cuts = cells.join(goals, same(cells, goals)).where("before <= open and before + size > open").select(cells.source, F.col("cell").alias("cut"), (F.col("open") - F.col("before")).alias("left"))
    short = cells.groupBy("source").agg(F.sum("size").alias("short"))
    goals = goals.join(cuts, same(goals, cuts), "left").select(goals.source, "source_size", "target", "whole", "open", F.coalesce("cut", F.lit(CELLS)).alias("cut"), "left")
    goals = goals.join(short, same(goals, short), "left").select(goals.source, "source_size", "target", "whole", F.coalesce("left", F.greatest(F.lit(0.0), F.col("open") - F.coalesce("short", F.lit(0)))).alias("left"), "cut")
    goals = held(stash(goals, "goals"))
    behind_cut = own.join(goals, same(own, goals)).where((F.col("cell") >= F.col("cut")) & (F.col("words") > 0) & ~is_long).select(own.source, "words", "cell", "cut", "left", *ITEM)
    within = F.sum("words").over(W.partitionBy("source", "cell").orderBy(*ITEM).rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = stash(behind_cut.where("cell = cut").withColumn("taken", within <= F.col("left")), "cut")  # one cell of each source
    used = edge.where("taken").groupBy("source").agg(F.sum("words").alias("used"))
    gaps = stash(goals.join(used, same(goals, used), "left").select(goals.source, (F.col("left") - F.coalesce("used", F.lit(0))).alias("gap")), "gaps")
    rest = [edge.where("not taken"), behind_cut.where("cell > cut"), long_ones.where("not taken")]
    rest = reduce(DataFrame.unionByName, [df.select("source", "words", *ITEM) for df in rest])
    rest = stash(rest.join(held(gaps), same(rest, gaps)).where("words <= gap").select(rest.source, "gap", "words", *ITEM), "behind")
    told = [long_ones.select(*ITEM, "taken"), edge.where("taken").select(*ITEM, "taken"), filled(rest).withColumn("taken", F.lit(True))]
    told = reduce(DataFrame.unionByName, told).groupBy(*[F.col(c).alias(f"of_{c}") for c in ITEM]).agg(F.bool_or("taken").alias("taken"))
    told = stash(told, "decisions")
    if told.count() <= FEW_DOCUMENTS:
        told = F.broadcast(told)
    rows = dealt(docs, seed, text, source, key, carry)
    rows = rows.join(goals, same(rows, goals)).drop(goals.source).join(told, [F.col(c) == F.col(f"of_{c}") for c in ITEM], "left")
    again = F.coalesce("taken", F.col("cell") < F.col("cut"))
    return rows.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + again.cast("int")).otherwise(0))


def mix(docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, source, size, source_size, target, taken (words that the mix takes, repeats counted).

    A document is taken floor(target / source_size) whole times, and once more if it stands before the cut in the
    order of md5(seed, key), where the source's taken words would first pass its target, or if it fills what is then
    still open, the largest that fits first: a source's taken words never pass its target, and stay below it by less
    than any document that isn't taken once more. Null or empty texts have size 0 and are taken 0 words; a source
    without words has target 0; a null source is a source of its own; rows of equal key, text and source are taken as
    often as each other; an empty table gives an empty result. Reruns agree, as only keys, texts and the seed decide.
    Other columns are ignored.
    """
    rows = decided(docs, list(weights), share, most, seed, text, source, key, False)
    return rows.select(F.col("key").alias(key), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken. Texts are not shuffled, unless more than FEW_DOCUMENTS documents stand at the cuts."""
    rows = decided(docs, list(weights), share, most, seed, text, source, key, True)
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || doc_id) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source
), c AS (  -- sources in the order in which they reach twice their size; the first k of them are full
  SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / w, source) AS k,
    sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source ROWS UNBOUNDED PRECEDING) - 2.0 * source_size AS cap_before,
    sum(w) OVER () - sum(w) OVER (ORDER BY 2.0 * source_size / w, source ROWS UNBOUNDED PRECEDING) + w AS w_left, 1.5 * sum(source_size) OVER () AS goal FROM s
), l AS (
  SELECT coalesce(max_by((goal - cap_before) / w_left, -k) FILTER ((goal - cap_before) / w_left < cap / w), max(cap / w)) AS level FROM c
), t AS (
  SELECT source, source_size, least(cap, w * level) AS target FROM c, l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t
), o AS (
  SELECT d.*, r.source_size, r.target, r.whole, greatest(0.0, r.target - whole * source_size) AS rest, size * 1024 > source_size AS long FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), a AS (  -- of the long ones as many as come nearest to their part
  SELECT *, sum(size) OVER w AS upto, sum(size) OVER (PARTITION BY source, long) AS part FROM o WINDOW w AS (PARTITION BY source, long ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)
), b AS (
  SELECT *, long AND upto - size / 2 <= rest * part / source_size AND upto <= rest AS first FROM a
), j AS (
  SELECT *, rest - coalesce(sum(size) FILTER (first) OVER (PARTITION BY source), 0) AS open FROM b
), p AS (  -- the first of the others that passes what is left, and all behind it, are open
  SELECT *, CASE WHEN long THEN NOT first ELSE coalesce(bool_or(upto > open) OVER (PARTITION BY source, long ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING), FALSE) END AS behind FROM j
), g AS (
  SELECT source, any_value(rest) - coalesce(sum(size) FILTER (NOT behind), 0) AS gap FROM p GROUP BY source
), z AS (
  SELECT p.source, p.size, gap, count(*) AS n, row_number() OVER (PARTITION BY p.source ORDER BY p.size DESC) AS k FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
  WHERE behind AND size > 0 AND size <= gap GROUP BY p.source, p.size, gap
), f AS (  -- the largest that still fits first
  SELECT source, k, size, least(n, floor(gap / size)) AS m, gap - least(n, floor(gap / size)) * size AS gap FROM z WHERE k = 1
  UNION ALL SELECT z.source, z.k, z.size, least(z.n, floor(f.gap / z.size)), f.gap - least(z.n, floor(f.gap / z.size)) * z.size FROM f JOIN z ON z.k = f.k + 1 AND z.source IS NOT DISTINCT FROM f.source
), q AS (
  SELECT *, row_number() OVER (PARTITION BY source, size, behind ORDER BY h, doc_id) AS nth FROM p
)
SELECT q.doc_id, q.size, q.source_size, q.target, ((whole + CASE WHEN NOT behind OR nth <= coalesce(m, 0) THEN 1 ELSE 0 END) * q.size)::BIGINT AS taken
FROM q LEFT JOIN f ON q.source IS NOT DISTINCT FROM f.source AND q.size = f.size
"""
