"""Rule tables: the first rule, by priority, whose pattern a text contains or ends with.

A table of rules (priority, pattern, value) takes the place of literals in code. Up to a checked size it is broadcast, once
as an Aho-Corasick automaton, so that a text is read once whatever the number of rules; beyond that size the pieces of
texts that a sieve of all patterns lets pass meet the rules in an equi-join. Both ways give the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adatlas.functions.sieve import Sieve
from adatlas.sources.shared import written

#: Bytes of texts, patterns and values, and number of rules, up to which a table is broadcast.
MOST_BYTES, MOST_RULES = 16 << 20, 500_000
#: Rows with found rules, in parts of all rows, up to which it is tried whether their texts are few.
SELDOM = 8
#: Bytes of the keys by which texts find patterns in a join: each pattern has the longest that fits. Bits of a sieve, as a power of two.
RUNGS, MOST_BITS = [*range(1, 33), 48, 64, 96, 128, 192, *[1 << k for k in range(8, 31)]], 29

RULE = T.StructType([T.StructField("priority", T.LongType()), T.StructField("pattern", T.StringType()), T.StructField("value", T.StringType())])


def table(spark, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rules from (pattern, value) pairs in order of priority."""
    return spark.createDataFrame([(k, *pair) for k, pair in enumerate(pairs)], RULE)


def usable(rules: DataFrame) -> DataFrame:
    """One rule for each pattern, the first by priority, then by value. Rules without a priority or with an empty pattern never hold."""
    own = rules.select(F.col("priority").cast("long").alias("priority"), "pattern", F.col("value").cast("string").alias("value")).where("priority is not null and pattern <> ''")
    return own.groupBy("pattern").agg(F.min(F.struct("priority", "value")).alias("r")).select("r.priority", "pattern", "r.value")


def finder(rules: list[tuple[int, str, str]], whole_end: bool) -> Callable[[str], tuple | None]:
    """The first rule that a text contains, or ends with."""
    if whole_end:
        by_end = {pattern: (priority, pattern, value) for priority, pattern, value in rules}
        sizes = sorted({len(p) for p in by_end})
        return lambda text: min((by_end[text[-n:]] for n in sizes if n <= len(text) and text[-n:] in by_end), key=lambda r: r[:2], default=None)
    automaton = ahocorasick.Automaton()
    for rule in rules:
        automaton.add_word(rule[1], rule)
    if not rules:
        return lambda text: None
    automaton.make_automaton()
    return lambda text: min((rule for _, rule in automaton.iter(text)), key=lambda r: r[:2], default=None)


def first_rule(df: DataFrame, text: Column, rules: DataFrame, into: str = "rule", ends: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds `into`, a struct (priority, pattern, value): the first rule by priority, then by pattern, whose pattern the text contains, or, with `ends`, ends with; null where there is none and for null texts."""
    own = usable(rules)
    if small(own, "pattern", "value", most_bytes=most_bytes):
        return by_automaton(df, text, [tuple(r) for r in own.collect()], into, ends)
    return by_join(df, text, own, into, ends, most_bytes)


def by_automaton(df: DataFrame, text: Column, rules: list[tuple[int, str, str]], into: str, ends: bool) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(rules)
    made: dict[str, Callable] = {}

    @F.pandas_udf(RULE)
    def find(texts: pd.Series) -> pd.DataFrame:
        if "f" not in made:
            made["f"] = finder(held.value, ends)
        codes, distinct = pd.factorize(texts)  # equal texts of a batch are read once
        found = [made["f"](t) or (None, None, None) for t in distinct] + [(None, None, None)]  # the last stands for null
        return pd.DataFrame([found[c] for c in codes], columns=RULE.names).astype({"priority": "Int64"})

    out = df.withColumn("__r", find(text))
    return out.withColumn(into, F.when(F.col("__r.priority").isNotNull(), F.col("__r"))).drop("__r")


def rung(size: Column, rungs: list[int] = RUNGS) -> Column:
    """The greatest rung that is not above a size."""
    return F.array_max(F.filter(F.array(*map(F.lit, rungs)), lambda n: n <= size))


def keyed(rules: DataFrame, ends: bool) -> DataFrame:
    """Adds __n and __key: a pattern's first bytes (with `ends` its last), as many as the greatest rung that fits; __rank, which rises with priority and pattern; and __size, the pattern's bytes."""
    own = rules.withColumn("__b", F.col("pattern").cast("binary")).withColumn("__size", F.octet_length("pattern"))
    own = own.withColumn("__n", rung(F.col("__size")))
    own = own.withColumn("__key", F.substring("__b", F.when(F.lit(ends), F.col("__size") - F.col("__n") + 1).otherwise(F.lit(1)), F.col("__n"))).drop("__b")
    own = own.repartitionByRange("priority", "pattern").sortWithinPartitions("priority", "pattern")
    return written(own.withColumn("__rank", F.monotonically_increasing_id()), "rules")


def sieve(rules: DataFrame, n_rules: int, ends: bool) -> Sieve:
    """What texts' pieces must pass, made from all keys; of bounded size."""
    sizes = {r[0]: r[1] for r in rules.groupBy("__n").agg(F.max("__size")).collect()}  # as many as rungs, at most
    bits = min(max(16, (16 * n_rules).bit_length()), MOST_BITS)
    made = Sieve(bits, sizes, ends)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, (slot, mask) in enumerate(made.slots(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), kind, np.int8)), pa.array(slot.astype(np.int64)), pa.array(mask.view(np.int64))], names=["kind", "slot", "mask"])

    found = rules.select("__key").mapInArrow(slots, "kind byte, slot long, mask long").groupBy("kind", "slot").agg(F.bit_or("mask").alias("mask"))
    made.fill(found.toArrow())  # 64 MB of bits at most
    return made


def first_alike(texts: pd.Series, rows: pd.Series) -> pd.Series:
    """For each row of a batch the number of the batch's first row of equal text."""
    codes, _ = pd.factorize(texts, use_na_sentinel=False)
    return rows.iloc[np.unique(codes, return_index=True)[1][codes]]


def small(rules: DataFrame, *texts: str, most_bytes: int) -> bool:
    """Whether a table with these texts may be broadcast."""
    n, size = rules.agg(F.count("*"), F.sum(sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0)))).first()
    return n <= MOST_RULES and (size or 0) <= most_bytes


def by_join(df: DataFrame, text: Column, rules: DataFrame, into: str, ends: bool, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A text meets the rules once for each batch that has it. Few texts that have a rule are broadcast to the rows, which stay where they are; else rows and found rules meet by the batch's row."""
    own = df.withColumn("__text", text.cast("string")).withColumn("__row", F.monotonically_increasing_id())
    own = written(own.withColumn("__id", F.pandas_udf(first_alike, "long")("__text", "__row")), "texts")
    firsts = own.where("__id = __row and __text is not null").select("__id", "__text")
    found = written(matched(firsts, rules, into, ends), "found")
    if most_bytes and SELDOM * found.count() <= own.count():
        few = written(firsts.join(found, "__id").select("__text", into).distinct(), "few")
        if small(few, "__text", f"{into}.pattern", f"{into}.value", most_bytes=most_bytes):
            return own.join(F.broadcast(few), "__text", "left").drop("__text", "__row", "__id")
    return own.join(found, "__id", "left").drop("__text", "__row", "__id")


def matched(texts: DataFrame, rules: DataFrame, into: str, ends: bool) -> DataFrame:
    """Of texts (__id, __text) those that a rule holds for: __id and the first. Pieces that pass the sieve of all rules' keys meet the rules with that key; the lowest rank is a text's rule."""
    ruled = keyed(rules, ends)
    held = texts.sparkSession.sparkContext.broadcast(sieve(ruled, ruled.count(), ends))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from held.value.passing(batch)

    pieces = texts.mapInArrow(passing, "__id long, __key binary, __piece binary")
    whole = F.coalesce("__piece", "__key")
    pattern = F.col("pattern").cast("binary")
    holds = F.endswith(whole, pattern) if ends else F.startswith(whole, pattern)
    best = pieces.join(ruled.select("__key", "pattern", "__rank"), "__key").where(holds).groupBy("__id").agg(F.min("__rank").alias("__rank"))
    return best.join(ruled.select("__rank", F.struct("priority", "pattern", "value").alias(into)), "__rank").select("__id", into)
