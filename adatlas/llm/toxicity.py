"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model that estimates their accuracies
and correlations, and a linear classifier trained on its posterior labels.

Voters are short fixed lexicons, words that stand out in labelled training rows (each a voter of its own), and patterns.
The label model is fitted by expectation maximisation on a bounded sample of labelled rows, the labels counting as one
more noisy voter; pairs of voters that still agree within a class are down-weighted. The classifier sees votes, counts
and rates, never labels, languages, sources or ids, and scores every whole text in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adatlas.llm.common import chunks, mapped, stash, text_bytes, word_hashes, word_spans
from adatlas.llm.labelled import ROWS, held_out, training_labels

#: Words of insult, by kind.
LEXICONS = {
    "fools": "idiot idiots idiotic moron morons moronic imbecile imbeciles fool fools dumb dumbass stupid dimwit halfwit clown clowns buffoon",
    "scorn": "worthless pathetic disgusting loser losers trash garbage scum filth filthy vile repulsive useless ridiculous revolting",
    "hate": "hate hateful despise vermin parasite parasites subhuman inferior",
    "threat": "kill die burn destroy punch strangle shoot hang",
    "oaths": "damn hell crap shit fuck fucking bitch bastard asshole arse piss whore slut",
    "german": "dumm dummkopf trottel depp arschloch scheisse scheiße widerlich wertlos abschaum versager",
    "french": "imbécile abruti connard connasse merde salaud salope débile répugnant minable",
    "spanish": "imbécil estúpido estúpida tonto tonta mierda cabrón puta asqueroso inútil patético",
}
TRIM = np.zeros(256, bool)
TRIM[list(b"\"'`()[]{}<>,.;:!?*#$%&|-_")] = True
#: Mined words at most, the labelled rows in which one must stand, EM rounds, trust in a given label.
MINED, SUPPORT, ROUNDS, TRUST = 400, 4, 40, 0.95
PATTERNS = 5
#: Rows that the driver's model code holds in full precision at once.
PART = 2000


def cores(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words without signs at their ends, lower-cased (ASCII), first word of each document; and word ends as they stand."""
    begins, ends, first = word_spans(data, offsets)
    b, e = begins.copy(), ends.copy()
    left = np.arange(len(b))
    while len(left := left[(b[left] < e[left]) & TRIM[data[np.minimum(b[left], len(data) - 1)]]]):
        b[left] += 1
    left = np.arange(len(e))
    while len(left := left[(b[left] < e[left]) & TRIM[data[np.maximum(e[left] - 1, 0)]]]):
        e[left] -= 1
    gone = b >= e
    b[gone], e[gone] = begins[gone], begins[gone]
    return word_hashes(data, b, e), first, begins, ends


def hashed(words: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(words, pa.string()))
    return word_hashes(data, offsets[:-1], offsets[1:])


class Voters:
    """All voters: a sorted table of word hashes with the voter of each, then the patterns."""

    def __init__(self, mined: np.ndarray):
        hashes, voter = [], []
        for k, words in enumerate(LEXICONS.values()):
            h = hashed(words.split())
            hashes.append(h)
            voter.append(np.full(len(h), k))
        hashes.append(mined)
        voter.append(len(LEXICONS) + np.arange(len(mined)))
        h, v = np.concatenate(hashes), np.concatenate(voter)
        self.hash, at = np.unique(h[::-1], return_index=True)  # a mined word is its own voter even if a lexicon has it
        self.voter = v[::-1][at]
        self.lexical = len(LEXICONS) + len(mined)
        self.n = self.lexical + PATTERNS
        self.you = np.sort(hashed("you your you're youre u ur du ihr tu vous vosotros usted".split()))

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each voter is moved in each document, and the documents' words."""
        h, first, begins, ends = cores(data, offsets)
        docs, words = len(offsets) - 1, np.diff(first)
        out = np.zeros((docs, self.n), np.float32)
        if len(h):
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit = np.flatnonzero(self.hash[at] == h)
            doc = np.searchsorted(first, hit, "right") - 1
            np.add.at(out, (doc, self.voter[at[hit]]), 1)
            # patterns: a hit after a word of address; two hits close by; a hit shouted; a hit with a sign of anger; three kinds of hits
            you = self.you[np.minimum(np.searchsorted(self.you, h), len(self.you) - 1)] == h
            near = np.concatenate(([0], np.cumsum(you)))
            np.add.at(out, (doc, np.full(len(hit), self.lexical)), (near[hit] - near[np.maximum(hit - 4, first[doc])] > 0).astype(np.float32))
            if len(hit) > 1:
                close = (np.diff(hit) < 12) & (doc[1:] == doc[:-1])
                np.add.at(out, (doc[1:], np.full(len(hit) - 1, self.lexical + 1)), close.astype(np.float32))
            shout = (data[begins[hit]] >= 65) & (data[begins[hit]] <= 90) & (data[np.minimum(begins[hit] + 1, len(data) - 1)] >= 65) & (data[np.minimum(begins[hit] + 1, len(data) - 1)] <= 90)
            np.add.at(out, (doc, np.full(len(hit), self.lexical + 2)), shout.astype(np.float32))
            np.add.at(out, (doc, np.full(len(hit), self.lexical + 3)), (data[ends[hit] - 1] == 33).astype(np.float32))
            out[:, self.lexical + 4] = (out[:, : self.lexical] > 0).sum(1) >= 3
        return out, words

    def features(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Votes, the damped count of hits, their rate and the number of voters moved."""
        hits = counts[:, : self.lexical].sum(1, keepdims=True)
        kinds = (counts[:, : self.lexical] > 0).sum(1, keepdims=True)
        return np.concatenate((np.minimum(counts, 1), np.log1p(hits), np.minimum(100 * hits / np.maximum(words[:, None], 20), 5), np.minimum(kinds, 6), kinds > 0), 1)


def label_model(votes: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posteriors of the latent class, and the model: prior, rates at which each voter moves by class, correlations, weights.

    votes: documents by voters, 0 or 1; given: labels in 0..1. Voters are independent given the class, but for pairs
    whose residuals still correlate: each one's evidence is divided by one plus its summed positive residual correlations.
    """
    n, m = votes.shape
    post = np.where(given > 0.5, TRUST, 1 - TRUST) * 1.0
    weight = np.ones(m)
    for step in range(ROUNDS):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        fired = votes.sum(0, dtype=np.float64)
        both = post.astype(votes.dtype) @ votes
        on = np.clip((both + 0.5) / (post.sum() + 1), 1e-4, 1 - 1e-4)
        off = np.clip((fired - both + 0.5) / ((1 - post).sum() + 1), 1e-4, 1 - 1e-4)
        if step in (5, 15):
            square = np.zeros((m, m))
            for at in range(0, n, PART):  # residuals of some rows at a time
                rest = votes[at : at + PART] - post[at : at + PART, None] * on - (1 - post)[at : at + PART, None] * off
                square += rest.T @ rest
            spread = np.sqrt(np.diag(square) / n) + 1e-9
            corr = square / n / np.outer(spread, spread)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(1))
        log = np.log(prior / (1 - prior)) + votes @ (weight * np.log(on / off * (1 - off) / (1 - on))).astype(votes.dtype) + (weight * np.log((1 - on) / (1 - off))).sum()
        log += np.where(given > 0.5, 1, -1) * np.log(TRUST / (1 - TRUST))
        post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return post, {"prior": np.array(prior), "on": on, "off": off, "correlations": corr if m else np.zeros((0, 0)), "weight": weight}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 25, toxic: float = 3.0) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear classifier on soft labels, by Newton's method; label 1 weighs `toxic` times label 0."""
    each = 1 + (toxic - 1) * y
    w, keep = np.zeros(x.shape[1] + 1), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        curve, slope = np.diag(keep) + 1e-9 * np.eye(len(w)), -keep * w
        for at in range(0, len(x), PART):  # some rows at a time
            a = np.concatenate((x[at : at + PART], np.ones((len(x[at : at + PART]), 1))), 1)
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            e = each[at : at + PART]
            curve += (a * (e * p * (1 - p))[:, None]).T @ a
            slope += a.T @ (e * (y[at : at + PART] - p))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int = ROWS) -> tuple[Voters, np.ndarray, float]:
    """Voters and the linear classifier. With no labelled rows, or none labelled 1, every score is low."""
    wanted = F.broadcast(training_labels(labels, label, key, rows))  # at most about `rows` keys
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    # of several texts of an id one trains, told by its hash
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    sample = stash(source.join(wanted, source.id == wanted.label_key).groupBy("id").agg(one, F.max("y").alias("y")).select("id", "text", "y"), "sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column("y")) > 0.5
            for part, data, offsets in chunks(batch):
                h, first, _, _ = cores(data, offsets)
                own = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
                flag = np.repeat(y[part], [len(o) for o in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(flag.astype(np.int64))], ["word", "toxic"])

    totals = sample.agg(F.sum((F.col("y") > 0.5).cast("long")), F.count("*")).first()
    bad, n = int(totals[0] or 0), int(totals[1])
    mined = np.zeros(0, np.uint64)
    if bad:
        table = mapped(sample.select("text", "y"), words, "word long, toxic long").groupBy("word").agg(F.sum("toxic").alias("k"), F.count("*").alias("all"))
        rate = (F.col("k") + 0.5) / (bad + 1.0) / ((F.col("all") - F.col("k") + 0.5) / (n - bad + 1.0))
        strong = table.where(F.col("k") >= SUPPORT).withColumn("lift", F.log(rate)).where("lift > 2").withColumn("gain", F.col("lift") * F.col("k"))
        mined = np.array([r["word"] for r in strong.orderBy(F.desc("gain"), "word").limit(MINED).collect()], np.int64).view(np.uint64)
    voters = Voters(mined)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column("y"))
            for part, data, offsets in chunks(batch):
                counts, size = voters.counts(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in counts], pa.binary()), pa.array(size.astype(np.int64)), pa.array(y[part])], ["counts", "words", "y"])

    got = mapped(sample.select("text", "y"), vote, "counts binary, words long, y double").toArrow()  # at most about `rows` rows
    counts = np.frombuffer(b"".join(got.column("counts").to_pylist()), np.float32).reshape(-1, voters.n)
    x = voters.features(counts, np.asarray(got.column("words")))
    if not bad:
        return voters, np.zeros(x.shape[1]), -3.0
    post, _ = label_model(np.minimum(counts, 1), np.asarray(got.column("y")))
    return voters, *logistic(x, post)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", least: float = 0.7, rows: int = ROWS, keep: bool = False) -> DataFrame:
    """One row for each row of docs: key, held_out, score, predicted; with `keep`, the row (a struct of the columns of docs) and its score.

    Null and empty texts have the score of a text without any vote; a null key isn't held out; repeated rows are scored
    each; other columns are ignored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, text, key, rows))
    # a text crosses to Python once: with `keep` it is part of the row
    source = docs.select(F.struct(*docs.columns).alias("row")) if keep else docs.select(F.struct(F.col(key).cast("long").alias("id")).alias("row"), F.col(text).cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, w, offset = model.value
        for batch in batches:
            texts = batch.column("row").field(text) if keep else batch.column("text")
            parts = [voters.features(*voters.counts(data, offsets)) @ w + offset for _, data, offsets in chunks(texts)]
            z = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["row", "score"])

    out = mapped(source, score, source.select("row").schema.add("score", "double"))
    if keep:
        return out
    out = out.select("row.id", "score")
    return out.select(F.col("id").alias(key), held_out("id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op2(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
