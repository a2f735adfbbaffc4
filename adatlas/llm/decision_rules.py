"""Quality rules: fixed counts of every text, and a learned decision list.

Counts and shares are taken from whole texts in one pass and stored; all else reads those few numbers. The list is learned
by sequential covering: a rule grows by the threshold that tells most about the rarer kind of document, is pruned on rows
that it hasn't seen, and what it covers is taken away before the next one grows. Learned rules are conjunctions of
thresholds on named numbers and come out as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adatlas.llm.common import chunks, mapped, mix, stash, word_hashes, word_spans
from adatlas.llm.labelled import ROWS, training_labels
from adatlas.llm.quality import statistics

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS, WINDOW = b"#*$%&|<>", 3
#: What rules may test besides the counts' shares: names of columns of quality.statistics.
NAMED = {
    2: "word_bytes", 3: "word_bytes_spread", 4: "capitals", 5: "digits", 6: "signs", 7: "stops", 8: "newlines", 9: "non_ascii", 10: "capital_words", 11: "words_with_sign",
    12: "words_before_full_stop", 13: "words_before_comma", 14: "words_before_exclamation", 15: "bars", 16: "long_words", 17: "short_words", 18: "distinct_words", 19: "commonest_word", 20: "distinct_pairs", 22: "distinct_lines",
}
SHARES = {"symbols_a_word": "n_symbols", "repeated_words": "n_repeat_words", "duplicate_lines_a_word": "n_dup_lines"}
TESTED = ["n_words", *SHARES, *NAMED.values()]
#: Thresholds tried for a number, digits of a threshold, conditions of a rule, rules of a list.
STEPS, DIGITS, CONDITIONS, RULES = 48, 3, 5, 24


def runs(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that brings equal keys of an owner together, where each run begins in it, and how long it is."""
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(o)), bool), (o[1:] != o[:-1]) | (k[1:] != k[:-1]))))
    return order, at, np.diff(np.concatenate((at, [len(o)])))


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of COUNTS for each text."""
    docs = len(offsets) - 1
    begins, ends, first = word_spans(data, offsets)

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[offsets[1:]] - total[offsets[:-1]]

    space = np.isin(data, np.frombuffer(b" \t\n\v\f\r", np.uint8))
    chars = within((data & 0xC0) != 0x80) - within(space)
    symbols = within(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    # lines with a word: from the text's begin or a line feed up to the next one or the text's end
    starts = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1)))
    starts = starts[starts < len(data)]
    stops = np.append(starts[1:], len(data))[: len(starts)]
    stops = stops - (data[np.maximum(stops - 1, 0)] == 10) if len(starts) else stops
    solid = np.concatenate(([0], np.cumsum(~space, dtype=np.int64)))
    some = solid[stops] > solid[starts]
    starts, stops = starts[some], stops[some]
    owner = np.searchsorted(offsets, starts, "right") - 1
    _, at, _ = runs(owner, word_hashes(data, starts, stops, lower=False))
    lines = np.bincount(owner, minlength=docs)
    repeated_lines = lines - np.bincount(np.sort(owner)[at] if len(at) else owner[:0], minlength=docs)
    # windows of three words of one text
    h = word_hashes(data, begins, ends, lower=False)
    owner = np.repeat(np.arange(docs), np.diff(first))
    inside = np.flatnonzero(owner[: max(0, len(owner) - WINDOW + 1)] == owner[WINDOW - 1 :])
    key = np.zeros(len(inside), np.uint64)
    for k in range(WINDOW):
        key = mix(key + h[inside + k] + np.uint64(k + 1))
    order, at, size = runs(owner[inside], key)
    again = inside[order[np.repeat(size > 1, size)]]
    covered = np.zeros(len(h), bool)
    for k in range(WINDOW):
        covered[again + k] = True
    repeated = np.bincount(owner[covered], minlength=docs)
    return np.stack([np.diff(first), chars, symbols, repeated_lines, repeated], 1).astype(np.int64)


def measured(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, COUNTS, TESTED): the numbers of every row."""
    names = list(NAMED.values())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x = [np.zeros((0, len(COUNTS)), np.int64)], [np.zeros((0, len(names)))]
            for _, data, offsets in chunks(batch):
                n.append(counts(data, offsets))
                x.append(statistics(data, offsets)[:, list(NAMED)])
            columns = [*np.concatenate(n).T, *np.concatenate(x).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["id", *COUNTS, *names])

    schema = ", ".join(["id long", *[f"{c} long" for c in COUNTS], *[f"{c} double" for c in names]])
    own = mapped(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), measure, schema)
    return own.withColumns({name: F.col(c) / F.greatest("n_words", F.lit(1)) for name, c in SHARES.items()})


class Condition(NamedTuple):
    """A number is at most a threshold, or above it."""

    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.name) > self.threshold if self.above else F.col(self.name) <= self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.threshold if self.above else x[self.name] <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


class DecisionList(NamedTuple):
    """Rules in order, each a conjunction; the first that holds gives `verdict`, none the opposite."""

    rules: list[list[Condition]]
    verdict: bool

    def expression(self, values: list, otherwise) -> Column:
        """The value of the first rule that holds, as nested conditions in order."""
        out = F
        for rule, value in zip(self.rules, values):
            out = out.when(reduce(Column.__and__, [c.column() for c in rule]), F.lit(value))
        return out.otherwise(otherwise) if self.rules else F.lit(otherwise)

    def fired(self) -> Column:
        """The number of the first rule that holds, from 1; null for none."""
        return self.expression(list(range(1, len(self.rules) + 1)), None).cast("int")

    def keeps(self) -> Column:
        return self.expression([self.verdict] * len(self.rules), not self.verdict)

    def __str__(self) -> str:
        verdicts = {True: "keep", False: "drop"}
        return "\n".join([*[f"{verdicts[self.verdict]} if {' and '.join(map(str, rule))}" for rule in self.rules], f"else {verdicts[not self.verdict]}"])


def thresholds(values: np.ndarray) -> np.ndarray:
    """Rounded values between the steps of a number's distribution."""
    q = np.unique(np.quantile(values, np.linspace(0, 1, STEPS + 1)))
    middle = (q[1:] + q[:-1]) / 2
    return np.unique([float(f"{v:.{DIGITS}g}") for v in middle])


def grown(x: dict[str, np.ndarray], y: np.ndarray) -> list[Condition]:
    """A conjunction that grows by the condition of most gain, p (log p/(p+n) - log P/(P+N)), until it covers the wanted rows alone or nothing gains."""
    rule: list[Condition] = []
    while 0 < y.sum() < len(y) and len(rule) < CONDITIONS:
        base, found, most = np.log2(y.mean()), None, 1e-9
        for name, values in x.items():
            cuts = thresholds(values)
            # rows by step: at most a threshold are all of the steps before it
            step = np.searchsorted(cuts, values, "left")
            low = np.stack([np.cumsum(np.bincount(step[y == kind], minlength=len(cuts) + 1))[:-1] for kind in (True, False)])
            for above, (p, n) in ((False, low), (True, np.array([[y.sum()], [(~y).sum()]]) - low)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > most:
                    found, most = Condition(name, above, float(cuts[k])), gain[k]
        if not found:
            break
        rule.append(found)
        keep = found.holds(x)
        x, y = {c: v[keep] for c, v in x.items()}, y[keep]
    return rule


def worth(rule: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> tuple[float, int]:
    """(p - n) / (p + n) among rows that a rule covers, and p."""
    keep = reduce(np.logical_and, [c.holds(x) for c in rule], np.ones(len(y), bool))
    p, n = int(y[keep].sum()), int((~y[keep]).sum())
    return (p - n) / (p + n) if p + n else -1.0, p


def covering(x: dict[str, np.ndarray], good: np.ndarray, unseen: np.ndarray) -> DecisionList:
    """Learns the list from labelled rows; `unseen` marks those that prune. Without rows of both kinds the list is empty and keeps all."""
    if not len(good) or good.all() or not good.any():
        return DecisionList([], False)
    verdict = bool(good.mean() < 0.5)
    y, rules = good == verdict, []
    left = np.ones(len(y), bool)
    while (y & left & ~unseen).any() and len(rules) < RULES:
        some = lambda mask: ({c: v[mask] for c, v in x.items()}, y[mask])
        rule = grown(*some(left & ~unseen))
        against = some(left & unseen)
        if not against[1].any():
            against = some(left & ~unseen)
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        if not shorter:
            break
        rule = max(shorter, key=lambda r: (worth(r, *against)[0], -len(r)))
        value, p = worth(rule, *against)
        if value <= 0 or not p:
            break
        rules.append(rule)
        left &= ~reduce(np.logical_and, [c.holds(x) for c in rule])
    return DecisionList(rules, verdict)


def learned(rows: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", most: int = ROWS) -> DecisionList:
    """The list for documents that pass the fixed rules, from at most about `most` labelled ones that aren't held out. rows: as of `measured`, with base_failed.

    Of several rows of an id one trains, by the order of their numbers.
    """
    own = training_labels(labels, label, key, most)
    sample = rows.where("not base_failed").join(own, rows.id == own.label_key).groupBy("id").agg(F.min(F.struct(*TESTED)).alias("x"), F.first("y").alias("y"))
    table = sample.select("x.*", "y", (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("unseen")).orderBy("id").toArrow()  # at most `most` rows
    return covering({c: np.asarray(table.column(c), np.float64) for c in TESTED}, np.asarray(table.column("y")) >= 0.5, np.asarray(table.column("unseen"), bool))


def ruled(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", least_words: int = 50, most_repeated: int = 50, most: int = ROWS) -> tuple[DataFrame, DecisionList]:
    """(one row for each row of docs: key, the counts, base_failed, kept, rule; the list). rule: the learned rule that decided, from 1; null where none held or the fixed ones failed.

    Fixed rules fail texts of fewer than `least_words` words, or with more than `most_repeated` % of repeated words; so
    null and empty texts fail. Without labels of both kinds all others are kept. A null key is never labelled;
    repeated rows are judged each; other columns are ignored; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = stash(measured(docs, text, key).withColumn("base_failed", failed), "numbers")
    rules = learned(rows, labels, label, key, most)
    out = rows.select(F.col("id").alias(key), *COUNTS, "base_failed", (~F.col("base_failed") & rules.keeps()).alias("kept"), F.when(~F.col("base_failed"), rules.fired()).alias("rule"))
    return out, rules


def op12(spark, sf_dir: str) -> DataFrame:
    return ruled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]
