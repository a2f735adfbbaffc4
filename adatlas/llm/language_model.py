"""LM scoring: a causal self-attention model on subword ids, trained in numpy.

A text is its subword ids between two ends. The probability of the next id is that of its class, given by masked
attention over the last 16 to 32 ids, times that of the id within its class and after the id before it (rarer ones by
class, then by its own count), which comes from counts over all training documents. Documents are scored as streams cut into windows of 32 ids that overlap by
16: each id is scored once, all windows of a stream at once.

The attention weights begin with a hash-picked sample of SAMPLE training documents; then shards of about DEALT of them take
steps over the whole texts of a SHARE of all training documents, and the mean of their weights is kept. Shards are dealt
and ordered by hashes, and grow in number with the documents, so that scores don't hang on how the input is partitioned. The counts behind ids, classes,
words, the base score and its N and V cover every training document. Counts of the commonest words
(at most COMMON) are broadcast, those of all others are joined by the word.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adatlas.llm.common import chunks, crc_mod, mapped, stash, word_hashes, word_spans
from adatlas.llm.packing import vocabulary
from adatlas.llm.subwords import word_ids

#: Ids of the tokenizer and the end; classes, of which SINGLE are one id each; embeddings; sizes; ids of half a window.
IDS, END = 49_409, 49_408
CLASSES, SINGLE, OWN, DIM, WIDE, HALF = 32, 16, 4096, 16, 32, 16
#: Kinds of the id before, within counts: the commonest ids, then the classes of all others.
BEFORE = 512
#: Documents of the sample, ids of a document there, ids of a training step, passes and steps at least.
SAMPLE, PART, STEP, PASSES, STEPS = 3000, 512, 8192, 4, 200
#: Share of the training documents whose whole texts train the attention (SAMPLE of them at least), its rate there, ids handled at once.
SHARE, RATE, MOST = 1 / 8, 0.002, 1 << 18
#: Documents of a shard of training, about; shards at least; tasks that add up the shards' weights.
DEALT, SHARDS, ADDERS = 4000, 4, 16
#: Words whose counts are broadcast, at most; counts kept in a task before they are sent on.
COMMON, HELD = 200_000, 1_000_000
SMOOTH = 20.0


class Attention:
    """The model: weights, classes of ids and, once counted, the ids' log10 probabilities within classes."""

    def __init__(self, counts: np.ndarray, pairs: np.ndarray | None, seed: int = 5, around: np.ndarray | None = None):
        """counts: of each id; pairs: rows of (id, next id), or their counts by place as `contexts` has them in around."""
        rng = np.random.default_rng(seed)
        order, self.slot = ranked(counts)
        if around is None:
            around = np.bincount(contexts(pairs[:, 0], pairs[:, 1], order, self.slot), minlength=OWN * AROUND).reshape(OWN, AROUND)
        self.group = np.full(IDS, CLASSES - 1, np.int32)
        self.group[order[:SINGLE]] = np.arange(min(len(order), SINGLE))
        rest = order[SINGLE : OWN - 1]
        if len(rest):
            self.group[rest] = SINGLE + self._clusters(rest, counts, around[self.slot[rest]], rng)
        self.kind = BEFORE - CLASSES + self.group
        self.kind[order[: BEFORE - CLASSES]] = np.arange(min(len(order), BEFORE - CLASSES))
        normal = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": (0.3 * rng.normal(size=(OWN, DIM))).astype(np.float32), "q": normal(DIM, DIM), "k": normal(DIM, DIM), "v": normal(DIM, DIM), "x": normal(DIM, WIDE), "o": normal(DIM, WIDE), "b": np.zeros(WIDE, np.float32), "c": normal(WIDE, CLASSES), "d": np.zeros(CLASSES, np.float32), "r": np.zeros(2 * HALF, np.float32)}
        self.p["d"][np.bincount(self.group, minlength=CLASSES) == 0] = -1e4  # classes without an id get no share
        self.within = np.zeros((BEFORE, OWN), np.float32)
        self.own = np.zeros(IDS, np.float32)

    @staticmethod
    def _clusters(rest: np.ndarray, counts: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Groups the rarer ids by which common ids stand before and after them (k-means on square roots of shares)."""
        x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
        k = min(CLASSES - SINGLE - 1, len(rest))
        centre = x[rng.choice(min(len(rest), 4 * k), k, False)]
        for _ in range(12):
            at = np.argmin(((x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)[None]), 1)
            for g in range(k):
                if (at == g).any():
                    centre[g] = np.average(x[at == g], axis=0, weights=counts[rest[at == g]])
        return at

    def placed(self) -> dict[str, np.ndarray]:
        """What forward makes of each place's embedding, for weights that change no more."""
        e = self.p["e"]
        return {c: e @ self.p[c] for c in "qkvx"}

    def forward(self, ids: np.ndarray, fresh: np.ndarray, placed: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, dict]:
        """Class logits after each id of a stream (see `streamed`). fresh: whether each half window begins a text; placed: see there."""
        p, n = self.p, len(ids) // HALF
        slot = self.slot.take(ids)
        x = None if placed else p["e"].take(slot, 0)
        q, k, v, wide = (placed[c].take(slot, 0) if placed else x @ p[c] for c in "qkvx")
        q, k, v = (t.reshape(n, HALF, DIM) for t in (q, k, v))
        twice = lambda a: np.concatenate((np.concatenate((np.zeros_like(a[:1]), a[:-1])), a), 1)
        kk, vv = twice(k), twice(v)
        far = np.arange(HALF)[:, None] + HALF - np.arange(2 * HALF)[None, :]  # how far back each key stands
        s = np.matmul(q * p["q"].dtype.type(DIM**-0.5), kk.transpose(0, 2, 1))
        s += np.where(far >= 0, p["r"][np.clip(far, 0, 2 * HALF - 1)], p["r"].dtype.type(-1e9))
        s[fresh, :, :HALF] = -1e9  # what stands before belongs to another text
        a = np.exp(np.minimum(s, 60, out=s), out=s)
        total = (a @ np.ones(2 * HALF, a.dtype))[:, :, None]
        o = np.matmul(a, vv)
        o /= total
        o = o.reshape(-1, DIM)
        h = o @ p["o"]
        h += wide
        h += p["b"]
        np.maximum(h, 0, out=h)
        logits = h @ p["c"]
        logits += p["d"]
        return logits, {"slot": slot, "x": x, "q": q, "kk": kk, "vv": vv, "a": a, "total": total, "o": o, "h": h, "far": far}

    def backward(self, grad: np.ndarray, f: dict) -> dict[str, np.ndarray]:
        """Gradients of all weights for the gradient of the logits."""
        p, n = self.p, len(f["q"])
        dh = (grad @ p["c"].T) * (f["h"] > 0)
        do = (dh @ p["o"].T).reshape(n, HALF, DIM)
        da = np.matmul(do, f["vv"].transpose(0, 2, 1))
        a = f["a"] / f["total"]
        ds = a * (da - (da * a).sum(2, keepdims=True))
        scale = p["q"].dtype.type(DIM**-0.5)
        dq = (np.matmul(ds, f["kk"]) * scale).reshape(-1, DIM)
        dkk, dvv = np.matmul(ds.transpose(0, 2, 1), f["q"]) * scale, np.matmul(a.transpose(0, 2, 1), do)

        def once(t: np.ndarray) -> np.ndarray:
            out = t[:, HALF:].copy()
            out[:-1] += t[1:, :HALF]
            return out.reshape(-1, DIM)

        dk, dv, x = once(dkk), once(dvv), f["x"]
        dx = dh @ p["x"].T + dq @ p["q"].T + dk @ p["k"].T + dv @ p["v"].T
        cells = (f["slot"][:, None] * DIM + np.arange(DIM)).ravel()
        e = np.bincount(cells, dx.ravel(), OWN * DIM).reshape(OWN, DIM).astype(p["e"].dtype)
        r = np.bincount(np.clip(f["far"], 0, 2 * HALF - 1).ravel(), (ds.sum(0) * (f["far"] >= 0)).ravel(), 2 * HALF)
        return {"e": e, "q": x.T @ dq, "k": x.T @ dk, "v": x.T @ dv, "x": x.T @ dh, "o": f["o"].T @ dh, "b": dh.sum(0), "c": f["h"].T @ grad, "d": grad.sum(0), "r": r.astype(np.float32)}

    def fit(self, texts: list[np.ndarray], rate: float = 0.01, passes: int | None = None) -> Attention:
        """Adam on the cross-entropy of the next id's class. passes: over the texts, else PASSES or as many as STEPS takes."""
        ids, docs, _ = streamed(texts)
        fresh = begins(docs)
        moment = {c: (np.zeros_like(w), np.zeros_like(w)) for c, w in self.p.items()}
        steps, t = range(0, len(ids), STEP), 0
        passes = passes or max(PASSES, -(-STEPS // max(1, len(steps))))
        for _ in range(passes):
            for at in steps:
                to = min(at + STEP, len(ids))
                start = fresh[at // HALF : to // HALF].copy()
                start[:1] = True
                logits, kept = self.forward(ids[at:to], start)
                nxt = np.append(ids, END)[at + 1 : to + 1]
                use = (docs[at:to] == np.append(docs, -1)[at + 1 : to + 1]) & (docs[at:to] >= 0)
                g = np.exp(logits - logits.max(1, keepdims=True))
                g /= g.sum(1, keepdims=True)
                g[np.arange(to - at), self.group[nxt]] -= 1
                g *= (use / max(1, use.sum())).astype(np.float32)[:, None]
                t += 1
                now = rate * min(1.0, 2.0 * (1 - t / (len(steps) * passes + 1)))
                for c, d in self.backward(g.astype(np.float32), kept).items():
                    a, b = moment[c]
                    a += 0.1 * (d - a)
                    b += 0.01 * (d * d - b)
                    self.p[c] -= (now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def learn_counts(self, counts: np.ndarray, each: np.ndarray | None = None) -> None:
        """counts: BEFORE (kind of the id before) by OWN (place of the id), over all training documents; each: of every id, by which ids of the last place part its probability."""
        ids = np.bincount(self.slot, minlength=OWN)
        group = np.full(OWN, CLASSES - 1)
        group[self.slot] = self.group
        single = counts.sum(0) + 0.1 * (ids > 0)
        share = single / np.bincount(group, single, CLASSES)[group]
        of_class = np.stack([np.bincount(group, row, CLASSES) for row in counts])[:, group]
        p = (counts + SMOOTH * share) / (of_class + SMOOTH) / np.maximum(ids, 1)
        self.within = np.log10(np.maximum(p, 1e-30)).astype(np.float32)
        if each is not None:
            each = each + 0.1
            self.own = np.log10(each / np.bincount(self.slot, each, OWN)[self.slot] * ids[self.slot]).astype(np.float32)  # against an equal part

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text given as ids without ends. Every text begins a half window, so that its score doesn't depend on its neighbours."""
        if not texts:
            return np.zeros(0)
        ids, docs, first = streamed(texts)
        fresh, out, placed = begins(docs), np.zeros(len(ids)), self.placed()
        for at in range(0, len(ids), 1 << 11):  # half a window before each part is its context
            lo, hi = max(0, at - HALF), min(len(ids), at + (1 << 11))
            start = fresh[lo // HALF : hi // HALF].copy()
            start[:1] = True
            logits = self.forward(ids[lo:hi], start, placed)[0][at - lo :]
            nxt = ids[np.minimum(np.arange(at + 1, hi + 1), len(ids) - 1)]
            own = logits[np.arange(len(nxt)), self.group[nxt]]
            total = np.log(np.exp(np.minimum(logits, 60, out=logits), out=logits) @ np.ones(CLASSES, logits.dtype))
            out[at:hi] = (own - total) / np.log(10) + self.within[self.kind[ids[at:hi]], self.slot[nxt]] + self.own[nxt]
        out[docs != np.append(docs[1:], -1)] = 0  # nothing follows the last end
        out[docs < 0] = 0
        return np.add.reduceat(out, first)


#: Columns of an id's contexts: common ids and all others, before it and after it.
AROUND = 2 * SINGLE + 2


def ranked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur, commonest first, and the place of each id, the last place being for all rarer ones."""
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    slot = np.full(IDS, OWN - 1, np.int32)
    slot[order[: OWN - 1]] = np.arange(min(len(order), OWN - 1))
    return order, slot


def contexts(ids: np.ndarray, after: np.ndarray, order: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Cells of a table of OWN by AROUND that pairs of an id and the next one count in."""
    common = np.full(IDS, SINGLE)
    common[order[:SINGLE]] = np.arange(min(len(order), SINGLE))
    return np.concatenate((slot[after] * AROUND + common[ids], slot[ids] * AROUND + SINGLE + 1 + common[after]))


def streamed(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts between two ends, each beginning a half window: ids, the text of each id (-1 for filling), where texts begin."""
    size = np.array([len(t) + 2 for t in texts], np.int64)
    room = -(-size // HALF) * HALF
    first = np.cumsum(room) - room
    ids, docs = np.full(int(room.sum()), END, np.int32), np.full(int(room.sum()), -1, np.int32)
    for k, (t, a) in enumerate(zip(texts, first.tolist())):
        ids[a + 1 : a + 1 + len(t)] = t
        docs[a : a + len(t) + 2] = k
    return ids, docs, first


def begins(docs: np.ndarray) -> np.ndarray:
    """Whether each half window of a stream begins a text."""
    d = docs[::HALF]
    return np.concatenate(([True], d[1:] != d[:-1])) if len(d) else np.zeros(0, bool)


class Tally:
    """Counts of hashes, kept sorted and sent on when they become many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.parts.append((keys[counts > 0], counts[counts > 0]))
        self.size += len(keys)
        if self.size > 2 * HELD:
            keys, counts = self.drain()
            if len(keys) > HELD:
                return keys, counts
            self.parts, self.size = [(keys, counts)], len(keys)
        return None

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, back = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([c for _, c in self.parts]), len(keys)).astype(np.int64)
        self.parts, self.size = [], 0
        return keys, counts


def parts(texts: Iterable[pa.BinaryScalar]) -> Iterator[list[np.ndarray]]:
    """Texts as ids, about MOST ids at a time."""
    held, size = [], 0
    for x in texts:
        held.append(np.frombuffer(x.as_buffer(), "<u2"))
        size += len(held[-1])
        if size > MOST:
            yield held
            held, size = [], 0
    if held:
        yield held


def picked(texts: DataFrame, share: float) -> DataFrame:
    return texts.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1_000_000)) < max(1, int(1_000_000 * share))) if share < 1 else texts


def sampled(texts: DataFrame, n: int) -> list[np.ndarray]:
    """Ids of the sample's documents (of longer ones, some part)."""
    begin = F.expr(f"cast(2 * pmod(key, greatest(1, length(ids) div 2 - {PART})) as int) + 1")
    own = picked(texts, SAMPLE / max(1, n)).select("key", F.substring("ids", begin, F.lit(2 * PART)).alias("ids"))
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in own.toArrow().sort_by("key").column("ids").to_pylist()]


def counted_pairs(texts: DataFrame, cell, size: int) -> np.ndarray:
    """How often each of `size` cells is given by cell(ids, next ids) over all texts between two ends; summed in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for own in parts(batch.column("ids")):
                last = np.cumsum([len(x) + 2 for x in own]) - 1
                stream = np.full(last[-1] + 1, END, np.int32)  # each text between two ends
                inner = np.ones(len(stream), bool)
                inner[last] = inner[np.concatenate(([0], last[:-1] + 1))] = False
                stream[inner] = np.concatenate(own)
                use = np.ones(len(stream), bool)
                use[last] = False
                use = np.flatnonzero(use)
                total += np.bincount(cell(stream[use], stream[use + 1]), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])

    got = texts.select("ids").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most `size` rows
    table = np.zeros(size)
    table[np.asarray(got.column("key"))] = np.asarray(got.column("n"))
    return table


def taught(model: Attention, texts: DataFrame, n: int) -> Attention:
    """Trains on the whole texts of a share of the n documents, each once: every shard steps from the same weights, in order
    of keys, then the mean by ids is taken. The result is the same however the texts are partitioned."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names, schema = ["shard", "n", "weights"], "shard int, n long, weights binary"

    def row(shard: int, total: int, flat: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([total], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((shard, x) for b in batches for shard, x in zip(b.column("shard").to_pylist(), b.column("ids")))
        for shard, group in groupby(rows, key=lambda r: r[0]):
            own, total = copy.copy(shared.value), 0
            own.p = {c: w.copy() for c, w in own.p.items()}
            for some in parts(x for _, x in group):
                own.fit(some, RATE, 1)
                total += sum(map(len, some)) + len(some)
            yield row(shard, total, np.concatenate([w.ravel() for w in own.p.values()]).astype(np.float64) * total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("shard").to_pylist(), b.column("n").to_pylist(), b.column("weights")))
        for adder, group in groupby(rows, key=lambda r: r[0] % ADDERS):
            total, flat = 0, 0.0
            for _, m, x in group:
                total, flat = total + m, flat + np.frombuffer(x.as_buffer())
            yield row(adder, total, flat)

    share = min(1.0, max(SHARE, SAMPLE / max(1, n)))
    shards = max(SHARDS, int(n * share) // DEALT)
    own = picked(texts, share).select("key", "ids").dropDuplicates(["key"]).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(shards)).cast("int"))
    done = own.repartitionById(shards, F.col("shard")).sortWithinPartitions("key").mapInArrow(steps, schema)
    sums = done.repartitionById(ADDERS, F.col("shard") % ADDERS).sortWithinPartitions("shard").mapInArrow(added, schema).toArrow().sort_by("shard")  # at most ADDERS rows
    total = sum(sums.column("n").to_pylist())
    if total:
        flat, at = sum(np.frombuffer(x) for x in sums.column("weights").to_pylist()) / total, 0
        for c, w in model.p.items():
            model.p[c], at = flat[at : at + w.size].reshape(w.shape).astype(np.float32), at + w.size
    return model


def score(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", fold: int = 7, held: int = 2) -> DataFrame:
    """One row for each row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (A-Z lower-cased) and one end. Null and empty texts are the end alone. A null key isn't held out.
    Repeated rows are scored, and counted in training, each (the attention takes steps over each once). Without training rows N and V are 0. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark, path = docs.sparkSession, path or vocabulary()
    out_of = F.coalesce(crc_mod(key, fold) == held, F.lit(False))
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), out_of.alias("held_out"))
    source = own.withColumn("key", F.xxhash64("id", "text"))  # one number for a row's id and text

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tally, each = word_ids(path), Tally(), np.zeros(IDS, np.int64)
        names = ["key", "id", "held_out", "n_tokens", "ids", "kind", "n"]

        def counted(keys: np.ndarray, counts: np.ndarray, kind: int) -> pa.RecordBatch:
            m = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.uint64).view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(np.full(m, kind, np.int32)), pa.array(counts.astype(np.int64))], names)

        for batch in batches:
            held_in = np.asarray(batch.column("held_out"))
            for rows, data, offsets in chunks(batch):
                seen = {}
                ids, at = words.encode(data, offsets, lambda *x: seen.update(x=x))
                distinct, back, first = seen["x"]
                train = ~held_in[rows]
                if more := tally.add(distinct, np.bincount(back[np.repeat(train, np.diff(first))], minlength=len(distinct))):
                    yield counted(*more, 1)
                codes = ids.astype("<u2").tobytes()
                each += np.bincount(ids[np.repeat(train, np.diff(at))], minlength=IDS)
                each[END] += 2 * train.sum()
                m = rows.stop - rows.start
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(rows.start, m), batch.column("id").slice(rows.start, m), batch.column("held_out").slice(rows.start, m), pa.array(np.diff(first) + 1), pa.array([codes[2 * a : 2 * b] for a, b in zip(at.tolist(), at[1:].tolist())], pa.binary()), pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int64())], names)
        yield counted(*tally.drain(), 1)
        some = np.flatnonzero(each)
        yield counted(some, each[some], 2)

    done = stash(mapped(source, read, "key long, id long, held_out boolean, n_tokens long, ids binary, kind int, n long"), "read")
    texts = done.where("kind = 0").select("key", "id", "held_out", "n_tokens", "ids")
    counts = stash(done.where("kind = 1").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("c")), "words")
    found = done.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most IDS rows
    each = np.zeros(IDS)
    each[np.asarray(found.column("key"))] = np.asarray(found.column("n"))
    train = texts.where("not held_out")
    ends = train.count()
    order, slot = ranked(each)
    around = counted_pairs(train, lambda a, b: contexts(a, b, order, slot), OWN * AROUND)
    model = taught(Attention(each, None, around=around.reshape(OWN, AROUND)).fit(sampled(train, ends)), train, ends)
    kind = model.kind.astype(np.int32)
    model.learn_counts(counted_pairs(train, lambda a, b: kind[a] * OWN + slot[b], BEFORE * OWN).reshape(BEFORE, OWN), each)
    final = spark.sparkContext.broadcast(model)

    totals = counts.agg(F.sum("c"), F.count("*")).first()
    n_train, distinct = int(totals[0] or 0) + ends, int(totals[1]) + (ends > 0)
    size = float(n_train + distinct + 1)
    step = F.floor(F.log2("c") * 8)
    ladder = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)  # a few hundred rows
    held_words, least = 0, None
    for at, m in ladder:
        held_words += m
        if held_words > COMMON:
            break
        least = at
    common = counts.where(step >= least).toArrow() if least is not None else counts.limit(0).toArrow()  # at most COMMON rows
    words_of = np.asarray(common.column("word")).astype(np.int64).view(np.uint64)
    order = np.argsort(words_of)
    known = spark.sparkContext.broadcast((words_of[order], np.asarray(common.column("c")).astype(np.int64)[order]))

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c = known.value
        logs = np.log10((c + 1) / size)
        end = float(np.log10((ends + 1) / size))
        for batch in batches:
            every = np.asarray(batch.column("key"))
            for rows, data, offsets in chunks(batch):
                begins, stops, first = word_spans(data, offsets)
                h = word_hashes(data, begins, stops)
                at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                hit = words[at] == h if len(words) else np.zeros(len(h), bool)
                total = np.concatenate(([0], np.cumsum(np.where(hit, logs[at], 0) if len(words) else np.zeros(len(h)))))
                found = np.concatenate(([0], np.cumsum(hit)))
                keys = every[rows]
                rare = np.flatnonzero(~hit)
                owner = np.searchsorted(first, rare, "right") - 1
                m = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((keys, keys[owner]))), pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(h[rare].view(np.int64))]), pa.array(np.concatenate((found[first[1:]] - found[first[:-1]] + (ends > 0), np.zeros(len(rare), np.int64)))), pa.array(np.concatenate((total[first[1:]] - total[first[:-1]] + end, np.zeros(len(rare)))))], ["key", "word", "n_known", "logs"])

    parts = mapped(source.select("key", "text"), base, "key long, word long, n_known long, logs double")
    copies = texts.groupBy("key").agg(F.count("*").alias("copies"))  # a repeated row sends its words as often
    joined = parts.join(counts, "word", "left")  # the row of a whole text has no word
    rare = F.col("word").isNotNull()
    known_of = F.when(rare, (F.col("c") > 0).cast("long")).otherwise(F.col("n_known"))
    logs_of = F.when(rare, F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(size))).otherwise(F.col("logs"))
    sums = joined.groupBy("key").agg(F.sum(F.coalesce(known_of, F.lit(0))).alias("n_known"), F.sum(logs_of).alias("logs"))
    bases = sums.join(copies, "key").select("key", (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"), (F.col("logs") / F.col("copies")).alias("base_score"))

    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, n = batch.column("ids").to_pylist(), 0, batch.num_rows
            scores = np.zeros(n)
            while at < n:
                to, size = at, 0
                while to < n and (to == at or size < 1 << 18):
                    size += len(own[to])
                    to += 1
                scores[at:to] = final.value.score([np.frombuffer(x, "<u2") for x in own[at:to]])
                at = to
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "held_out", "n_tokens")), pa.array(scores)], ["key", "id", "held_out", "n_tokens", "score"])

    scored = mapped(texts, attend, "key long, id long, held_out boolean, n_tokens long, score double")
    return scored.join(bases, "key").select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def op6(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
