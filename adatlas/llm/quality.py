"""Quality classifier: random Fourier features of document statistics, ridge scores from partition-summed normal
equations, isotonic calibration.

Statistics of every document are taken in one pass with numpy over whole texts and stored; all later steps read those
few numbers. The ridge is fitted on one part of a bounded sample of labelled rows, the calibration on the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adatlas.llm.common import chunks, crc_mod, mapped, mix, stash, word_hashes, word_spans
from adatlas.llm.labelled import ROWS, held_out, training_labels

#: Fourier features, width of the kernel in standard deviations, ridge weight, tasks that sum the equations.
FEATURES, WIDTH, RIDGE, TASKS = 256, 4.0, 1e-3, 8
SIGNS = b"#$%&*!|?@<>{}[]=_~^"
STATISTICS = 26


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS numbers for each text: lengths, shares of kinds of characters and words, and repetition."""
    docs = len(offsets) - 1
    begins, ends, first = word_spans(data, offsets)
    size, words = np.diff(offsets).astype(np.float64), np.diff(first).astype(np.float64)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]) * per_byte

    def words_in(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
        return (total[first[1:]] - total[first[:-1]]) * per_word

    sign = np.zeros(256, bool)
    sign[list(SIGNS)] = True
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122) | (data >= 128)
    length = (ends - begins).astype(np.float64)
    total = lambda m: np.concatenate(([0], np.cumsum(m, dtype=np.int64)))
    up, low, odd = total(upper), total(lower), total(sign[data])
    capitals = ((up[ends] - up[begins]) > 1) & ((low[ends] - low[begins]) == 0)
    last = data[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
    with_sign = (odd[ends] - odd[begins]) > 0
    h = word_hashes(data, begins, ends)
    owner = np.repeat(np.arange(docs), np.diff(first))

    def distinct(keys: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the number of distinct keys, and the count of its commonest."""
        if not len(keys):
            return np.zeros(docs), np.zeros(docs)
        k = np.sort(mix(keys ^ mix(who.astype(np.uint64))) >> np.uint64(20) | who.astype(np.uint64) << np.uint64(44))
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        runs = np.diff(np.concatenate((at, [len(k)])))
        doc = (k[at] >> np.uint64(44)).astype(np.int64)
        most = np.zeros(docs)
        np.maximum.at(most, doc, runs)
        return np.bincount(doc, minlength=docs).astype(np.float64), most

    kinds, most = distinct(h, owner)
    pair_owner = owner[:-1][owner[:-1] == owner[1:]] if len(owner) else owner
    pairs, _ = distinct((h[:-1] * np.uint64(3) + h[1:])[owner[:-1] == owner[1:]] if len(h) else h, pair_owner)
    # lines: begins after a newline or at the start
    starts = np.unique(np.concatenate((offsets[:-1][size > 0], np.flatnonzero(data == 10) + 1)))
    starts = starts[starts < len(data)]
    stops = np.concatenate((starts[1:], [len(data)])) if len(starts) else starts
    line_owner = np.searchsorted(offsets, starts, "right") - 1
    lines = np.bincount(line_owner, minlength=docs).astype(np.float64)
    line_kinds, _ = distinct(word_hashes(data, starts, np.maximum(stops, starts + 1)), line_owner)
    mean = words_in(length)
    columns = [
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(words_in(length**2) - mean**2, 0)), bytes_in(upper), bytes_in((data >= 48) & (data <= 57)),
        bytes_in(sign[data]), bytes_in((data == 46) | (data == 44) | (data == 59) | (data == 58)), bytes_in(data == 10), bytes_in(data >= 128), words_in(capitals), words_in(with_sign),
        words_in(last == 46), words_in(last == 44), words_in(last == 33), words_in((length == 1) & (last == 124)), words_in(length > 14), words_in(length < 3),
        kinds * per_word, most * per_word, pairs / np.maximum(words - 1, 1), np.log1p(lines), line_kinds / np.maximum(lines, 1), words / np.maximum(lines, 1) / 50.0,
        bytes_in((data == 64) | (data == 47)), np.log1p(kinds),
    ]
    return np.stack(columns, 1)


def measured(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, x): the statistics of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(data, offsets) for _, data, offsets in chunks(batch)]
            x = np.concatenate(parts) if parts else np.zeros((0, STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATISTICS).cast(pa.list_(pa.float64()))], ["id", "x"])

    return mapped(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), measure, "id long, x array<double>")


class Model:
    """Scaling, Fourier features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + 1)
        self.at, self.to = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.concatenate((np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.to), 0.0, 1.0)


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean score and mean label of each pool, ascending in both; labels are pulled in by one row of each kind."""
    pools: list[list[float]] = []
    for s, v in sorted(zip(scores.tolist(), y.tolist())):
        pools.append([s, v, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            s2, v2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + v2, pools[-1][2] + n2]
    return np.array([s / n for s, _, n in pools]), np.array([(v + 0.5 * (len(pools) > 1)) / (n + (len(pools) > 1)) for _, v, n in pools])


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", most: int = ROWS) -> Model:
    """rows: (id, x). Without labels of both kinds the score is their mean, or 0.5."""
    moments = rows.agg(*[F.avg(F.col("x")[i]) for i in range(STATISTICS)], *[F.stddev_pop(F.col("x")[i]) for i in range(STATISTICS)]).first()
    values = np.array([v if v is not None else 0.0 for v in moments])
    model = Model(values[:STATISTICS], values[STATISTICS:])
    own = training_labels(labels, label, key, most)
    sample = stash(rows.join(own, rows.id == own.label_key).groupBy("id").agg(F.min("x").alias("x"), F.max("y").alias("y")).select("id", "x", "y", (crc_mod("id", 3) == 0).alias("fits")), "sample")

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column("x").to_pylist()))
                total += np.concatenate((z.T @ z, (z.T @ np.asarray(batch.column("y")))[:, None]), 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums = sample.where("fits").select("x", "y").repartition(TASKS).mapInArrow(equations, "sums binary").collect()  # TASKS matrices
    total = sum((np.frombuffer(r["sums"]).reshape(FEATURES + 1, FEATURES + 2) for r in sums), np.zeros((FEATURES + 1, FEATURES + 2)))
    n = max(1.0, total[-1, -2])
    model.beta = np.linalg.solve(total[:, :-1] / n + RIDGE * np.eye(FEATURES + 1), total[:, -1] / n)
    rest = sample.where("not fits").select("x", "y").toArrow()  # at most the sample
    if rest.num_rows:
        model.at, model.to = isotonic(model.raw(np.array(rest.column("x").to_pylist())), np.asarray(rest.column("y")))
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", least: float = 0.5, most: int = ROWS) -> DataFrame:
    """One row for each row of docs: key, held_out, score, predicted.

    Null and empty texts are scored by their statistics like any other; a null key isn't held out; repeated rows are
    scored each; labels, languages and sources are no inputs; other columns are ignored; an empty table gives an empty
    result.
    """
    rows = stash(measured(docs, text, key), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, label, key, most))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.value.score(x))], ["id", "score"])

    out = rows.mapInArrow(score, "id long, score double")
    return out.select(F.col("id").alias(key), held_out("id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op7(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
