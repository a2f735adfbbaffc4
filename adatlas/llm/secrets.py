"""Secret scans: three exact rules, and a linear-chain conditional random field that tags words as begin, inside or
outside of a secret from their shape, the neighbouring words and features of the file, decoded by Viterbi.

The field learns from windows of words around what the rules find and around other odd words, in a bounded, hash-picked
sample of documents; half of its windows have their neighbouring words hidden. It then tags every word of every document
and adds runs that the rules miss; what the rules find always stays. Training reads the texts twice (to count and to pick
the sample); scoring needs one pass and no shuffle. The README has what the field finds where no rule matches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adatlas.llm.common import chunks, discard, mapped, stash, word_hashes, word_spans

#: The three rules and their least lengths.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
EDGES = "\"'`()<>[]{},;.:!?="

#: Documents of the training sample in which a rule may match; windows without a secret taken from it.
SAMPLE, WINDOWS = 3000, 6000
SIDE = 6
#: What is added to the outside score of every word when decoding, so that only clear runs are added to the rules' spans.
CAUTION = 3.0
SHAPES, WORDS, FILES = 896, 1024, 32
#: Begin of each feature's weights: shape, its length and digits, its turns and kinds, previous word, the one before, next word, file.
FEATURES = np.cumsum([0, SHAPES, 28, 32, WORDS, WORDS, WORDS, FILES])
O, B, I = 0, 1, 2  # noqa: E741


def rules(text: str, kinds: tuple[int, ...] = (0, 1, 2)) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all matches of the three rules, or some of them, in code points, by start and then kind."""
    found = []
    low = text.lower()
    if 0 in kinds and any(k in low for k in KEYWORDS):
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if 1 in kinds and "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if 2 in kinds:
        found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of words, first word of each document, and the feature numbers of every word."""
    begins, ends, first = word_spans(data, offsets)
    kind = np.full(256, 4, np.int8)  # digit, upper, lower, other letter, sign
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 0, 1, 2, 3
    k = kind[data]
    total = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
    part = lambda t: t[ends] - t[begins]
    size = (ends - begins).astype(np.int32)
    digits = part(total(k == 0))
    upper, lower, sign = part(total(k == 1)) > 1, part(total(k >= 2) - total(k == 4)) > 0, part(total(k == 4)) > 0
    turns = total(np.concatenate(([False], (k[1:] != k[:-1]) & ((k[1:] == 0) | (k[:-1] == 0))))) if len(k) else np.zeros(1, np.int32)
    turns = np.maximum(turns[ends] - turns[np.minimum(begins + 1, len(k))], 0)
    length = np.searchsorted([4, 8, 12, 16, 20, 32], size, "right")
    share = np.searchsorted([1, 20, 50], 100 * digits // np.maximum(size, 1), "right")
    size_digits, turns_kinds = length * 4 + share, np.searchsorted([1, 3, 6], turns, "right") * 8 + upper * 4 + lower * 2 + sign
    h = (word_hashes(data, begins, ends) % np.uint64(WORDS - 1)).astype(np.int32) + 1  # 0: no such word

    def moved(by: int) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        if by > 0:
            out[by:] = h[:-by]
        else:
            out[:by] = h[-by:]
        for step in range(abs(by)):  # not across documents
            edge = first[:-1] + step if by > 0 else first[1:] - 1 - step
            edge = edge[(edge >= first[:-1]) & (edge < first[1:])]
            out[edge] = 0
        return out

    words = np.diff(first)
    per_doc = np.concatenate(([0], np.cumsum(digits)))
    dense = 100 * (per_doc[first[1:]] - per_doc[first[:-1]]) // np.maximum(np.diff(offsets), 1)
    file = np.searchsorted([8, 32, 64, 128, 256, 1024, 4096], words, "right") * 4 + np.searchsorted([1, 3, 10], dense, "right")
    x = np.stack([size_digits * 32 + turns_kinds, size_digits, turns_kinds, moved(1), moved(2), moved(-1), np.repeat(file, words)], 1).astype(np.int32) + FEATURES[:-1].astype(np.int32)
    return begins, ends, first, x


class Field:
    """Weights of features by tag, and of tag pairs; inside can't follow outside or stand first."""

    def __init__(self):
        self.w = np.zeros((int(FEATURES[-1]), 3), np.float32)
        self.t = np.zeros((3, 3), np.float32)
        self.t[O, I] = -1e4

    def emissions(self, x: np.ndarray) -> np.ndarray:
        e = self.w[x[:, 0]]
        for c in range(1, x.shape[1]):
            e = e + self.w[x[:, c]]
        return e

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.15, l2: float = 1e-4) -> Field:
        """x: windows by words by features, y: their tags. Adam on the conditional log-likelihood, all windows at once."""
        n, length, _ = x.shape
        flat, one = x.reshape(n * length, -1), np.eye(3, dtype=np.float32)
        truth, pairs = one[y], np.einsum("nta,ntb->ab", one[y[:, :-1]], one[y[:, 1:]])
        moments = [np.zeros_like(p) for p in (self.w, self.w, self.t, self.t)]
        allowed = self.t > -1e3
        for step in range(1, rounds + 1):
            e = self.emissions(flat).reshape(n, length, 3)
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0] + self.t[O]
            for i in range(1, length):
                a[:, i] = e[:, i] + np.logaddexp.reduce(a[:, i - 1, :, None] + self.t, axis=1)
            for i in range(length - 2, -1, -1):
                b[:, i] = np.logaddexp.reduce(self.t + (e[:, i + 1] + b[:, i + 1])[:, None, :], axis=2)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            g = truth - np.exp(a + b - z[:, None, None])
            mutual = np.exp(a[:, :-1, :, None] + self.t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
            gw = np.stack([sum(np.bincount(flat[:, c], g[..., k].ravel(), len(self.w)) for c in range(flat.shape[1])) for k in range(3)], 1) / n - l2 * self.w
            gt = np.where(allowed, (pairs - mutual) / n - l2 * self.t, 0)
            for p, gr, m, v in ((self.w, gw, moments[0], moments[1]), (self.t, gt, moments[2], moments[3])):
                m *= 0.9
                m += 0.1 * gr
                v *= 0.99
                v += 0.01 * gr * gr
                p += (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best tags of one document."""
        t = self.t.tolist()
        score, back = [float(e[0, k]) + t[O][k] for k in range(3)], []
        for row in e[1:].tolist():
            step, new = [], []
            for k in range(3):
                s = [score[j] + t[j][k] for j in range(3)]
                j = s.index(max(s))
                step.append(j)
                new.append(s[j] + row[k])
            back.append(step)
            score = new
        tags = [score.index(max(score))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def runs(self, e: np.ndarray) -> list[tuple[int, int]]:
        """First and one after the last word of each tagged secret.

        A run of words that aren't outside can only win if some word of it gains more than transitions may add (at most
        `slack` for each word); a document without such a word needs no decoding.
        """
        slack = 2 * max(0.0, float((self.t - self.t[O, O]).max()))
        if not len(e) or not (e[:, 1:].max(1) - e[:, 0] + slack > 0).any():
            return []
        tags, out = self.viterbi(e), []
        for i, y in enumerate(tags):
            if y == B:
                out.append((i, i + 1))
            elif y == I and out and out[-1][1] == i:
                out[-1] = (out[-1][0], i + 1)
        return out


def char_at(data: np.ndarray) -> np.ndarray:
    """For each byte place, how many characters begin before it."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def windows(batch: pa.RecordBatch, kinds: tuple[int, ...] = (0, 1, 2)) -> Iterator[tuple[list[int], list[int]]]:
    """Training windows: around every word that a rule's match touches, and around odd words (digits or many capitals) and every 50th.

    Where a text holds a match of a rule that isn't among `kinds`, no window is taken of it.
    """
    width, other = 2 * SIDE + 1, tuple(k for k in (0, 1, 2) if k not in kinds)
    for rows, data, offsets in chunks(batch):
        begins, ends, first, x = features(data, offsets)
        texts = batch.column("text").slice(rows.start, rows.stop - rows.start).to_pylist()
        for d, text in enumerate(texts):
            a, b = int(first[d]), int(first[d + 1])
            if b - a < 2 or other and rules(text or "", other):
                continue
            at = char_at(data[offsets[d] : offsets[d + 1]])
            s, t = at[begins[a:b] - offsets[d]], at[ends[a:b] - offsets[d]]
            y = np.zeros(b - a, np.int64)
            for kind, start, end in rules(text or "", kinds):
                if kind == 0:  # the word that holds the value, not the name
                    start = max(start, ASSIGN.match(text, start).start(2))
                hit = np.flatnonzero((s < end) & (t > start))
                y[hit] = I
                y[hit[:1]] = B
            odd = (x[a:b, 0] % 8 >= 4) | ((x[a:b, 0] // 32) % 4 > 0)
            for c in np.flatnonzero((y > 0) | odd | (np.arange(b - a) % 50 == 25)).tolist():
                lo = min(max(0, c - SIDE), max(0, b - a - width))
                if b - a >= width:
                    yield x[a + lo : a + lo + width].ravel().tolist(), y[lo : lo + width].tolist()


def with_hidden_words(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window twice, once with its neighbouring words hidden, so that shapes alone must tell secrets too."""
    bare = x.copy()
    bare[..., 3:6] = FEATURES[3:6]
    return np.concatenate((x, bare)), np.concatenate((y, y))


def marked(text: str) -> Column:
    """Whether a rule may match in a text: by patterns, as Spark's lower() first makes some 3 GB of tables in each executor."""
    tails = "|".join(f"(?<={word[0]}){word[1:]}" for word in KEYWORDS)
    return F.contains(text, F.lit("AKIA")) | F.col(text).rlike("[0-9a-f]{32}") | F.col(text).rlike(f"(?i)[apst](?:{tails})")


def train(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Field | None:
    """The field, from a bounded sample of windows; None where the rules match nothing in the sample.

    About SAMPLE documents in which a rule may match and SAMPLE // 4 of all are picked by hash; of their windows at most
    WINDOWS // 2 with a secret and WINDOWS without.
    """
    source = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    source = source.withColumn("marked", marked("text"))
    n, hits = source.agg(F.count("*"), F.count_if("marked")).first()
    h, part = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)), lambda most, of: int(1_000_000 * min(1.0, most / max(1, of)))
    sample = source.where((h < part(SAMPLE // 4, n)) | (h < part(SAMPLE, hits)) & F.col("marked")).select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := list(windows(batch)):
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["x", "y"])

    found = stash(mapped(sample, cut, "x array<int>, y array<long>").withColumn("hit", F.exists("y", lambda v: v > 0)), "windows")
    taken = found.where("hit").orderBy(F.xxhash64("x")).limit(WINDOWS // 2).unionByName(found.where("not hit").orderBy(F.xxhash64("x")).limit(WINDOWS)).toArrow()
    discard(found)
    y = np.array(taken.column("y").to_pylist(), np.int64)
    if not (y > 0).any():
        return None
    return Field().fit(*with_hidden_words(np.array(taken.column("x").to_pylist(), np.int32).reshape(*y.shape, -1), y))


def spans(field: Field | None, column: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
    """All spans of each text of a column: those of the rules, and those of the field that touch none of them."""
    for rows, data, offsets in chunks(column):
        texts = column.slice(rows.start, rows.stop - rows.start).to_pylist()
        if field is not None:
            begins, ends, first, x = features(data, offsets)
            e = field.emissions(x)
            e[:, O] += CAUTION
        for d, text in enumerate(texts):
            text = text or ""
            base = rules(text)
            if field is not None:
                a, b = int(first[d]), int(first[d + 1])
                if more := field.runs(e[a:b]):
                    at = char_at(data[offsets[d] : offsets[d + 1]])
                    for i, j in more:
                        s, t = int(at[begins[a + i] - offsets[d]]), int(at[ends[a + j - 1] - offsets[d]])
                        while s < t and text[s] in EDGES:
                            s += 1
                        while s < t and text[t - 1] in EDGES:
                            t -= 1
                        if s < t and not any(s < q and p < t for _, p, q in base if _ < 3):
                            base.append((3, s, t))
                    base.sort(key=lambda z: (z[1], z[0]))
            yield base


def tagged(docs: DataFrame, text: str, key: str, field: Field | None, fitted: bool) -> DataFrame:
    """(row, spans): each row of docs as a struct, and what is found in its text."""
    field = field if fitted else train(docs, text, key)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a fixed number of weights
    source = docs.select(F.struct(*docs.columns).alias("row"))  # a text crosses to Python once, within its row
    found_type = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("kind", "start", "end")]))
    schema = T.StructType([*source.schema, T.StructField("spans", found_type)])
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans(shared.value, batch.column(0).field(text))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["row", "spans"])

    return mapped(source, tag, schema)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", field: Field | None = None, fitted: bool = False) -> DataFrame:
    """Adds `spans`, an array of (kind, start, end) in code points by start, then kind: assign, access, hex, crf.

    Null and empty texts have no spans. Whole texts are read, of any length. Rows may repeat: each is scanned. Other
    columns are kept; one named `spans` is replaced. An empty table gives an empty result.
    """
    named = F.transform("spans", lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1).alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return tagged(docs, text, key, field, fitted).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "spans"], named.alias("spans"))


def redact(docs: DataFrame, mark: str = "<SECRET>", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The same rows and columns with every span of the text, overlapping ones together, replaced by `mark`; n_chars, where present, follows.

    Null and empty texts and those without a span stay as they are; rows may repeat; columns of any name are kept; an
    empty table gives an empty result.
    """
    found, whole = tagged(docs, text, key, None, False), F.col("row")[text]
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s.start >= acc.at
        out = F.when(fresh, F.concat(acc.out, F.substring(whole, acc.at + 1, s.start - acc.at), F.lit(mark))).otherwise(acc.out)
        return F.struct(out.alias("out"), F.greatest(acc.at, s.end).alias("at"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc.out, F.substring(whole, acc.at + 1, F.length(whole))))
    new = {text: F.when(F.size("spans") > 0, done).otherwise(whole)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length(done).cast("long")).otherwise(F.col("row")["n_chars"])
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind != "crf")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest(found: list[tuple[int, int, int]]) -> str:
    """What base_sha256 is for the spans of one text."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found if k < 3).encode()).hexdigest()
