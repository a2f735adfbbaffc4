import random
import zlib

import numpy as np

from adatlas.llm import quality as Q
from adatlas.llm import toxicity as T
from adatlas.llm.common import text_bytes


def corpus(bad, n=600, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioustrnlmd") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        words, flag = [word() for _ in range(r.choice([8, 30, 120]))], int(r.random() < 0.3)
        docs.append((i, " ".join(bad(r, words) if flag else words), "en", "s", 0.0))
        if r.random() < 0.8:
            labels.append((i, 1 - flag, flag))
    return docs, labels


def insult(r, words):
    for _ in range(3):
        words.insert(r.randrange(len(words)), r.choice(["idiot", "Moron!", "zzgrut", "zzfrol,", "zzplim"]))
    return words


def junk(r, words):
    return [w.upper() + "!!" for w in words]


EXTRA = [(9000, None, None, None, None), (9001, "", "en", "s", 1.0), (9001, "", "en", "s", 1.0), (9002, "x " * 20000, "en", "s", 1.0), (None, "plain words", "en", "s", 1.0), (9003, "!!! ??", "en", "s", 1.0)]


def run(spark, classify, bad):
    docs, labels = corpus(bad)
    truth = {i: (q, t) for i, q, t in labels}
    frame = spark.createDataFrame(docs + EXTRA, "doc_id long, text string, lang string, source string, score double").repartition(3)
    out = classify(frame, spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs) + len(EXTRA)
    for r in out:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    again = classify(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert again.count() == 0
    return [(r.score, r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]


def test_toxicity_on_held_out_rows(spark):
    got = run(spark, T.classify, insult)
    assert all(p == int(s >= 0.7) for s, p, _ in got)
    assert np.mean([p == t for _, p, (_, t) in got]) > 0.95
    assert sum(p > t for _, p, (_, t) in got) == 0


def test_quality_on_held_out_rows(spark):
    got = run(spark, Q.classify, junk)
    assert all(p == int(s >= 0.5) for s, p, _ in got)
    assert np.mean([p == q for _, p, (q, _) in got]) > 0.95


def test_label_model_weighs_accurate_voters_and_sees_correlation():
    r = np.random.default_rng(0)
    y = (r.random(4000) < 0.3).astype(float)
    votes = np.stack([r.random(4000) < np.where(y, a, b) for a, b in ((0.8, 0.02), (0.6, 0.3), (0.7, 0.05))], 1).astype(float)
    votes = np.concatenate((votes, votes[:, 2:]), 1)  # the last voter copies the third
    given = np.where(r.random(4000) < 0.05, 1 - y, y)
    post, model = T.label_model(votes, given)
    assert abs(model["on"][0] - 0.8) < 0.05 and abs(model["off"][0] - 0.02) < 0.02
    assert model["correlations"][2, 3] > 0.9 and model["weight"][2] < 0.6 < model["weight"][0]
    assert np.mean((post > 0.5) == y) > np.mean(given == y)


def test_isotonic_is_monotone_and_keeps_means():
    x, y = Q.isotonic(np.array([3.0, 1, 2, 4, 5, 0]), np.array([0.0, 0, 1, 1, 1, 0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all()


def test_statistics_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["", "One two. TWO!\nOne", "a" * 50, "é ñ #x | y", "w w w w\nw w\n"]
    together = Q.statistics(*text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        assert np.allclose(Q.statistics(*text_bytes(pa.array([t])))[0], together[k])


def test_ridge_equals_direct_least_squares(spark):
    docs, labels = corpus(junk, 300)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double").repartition(4)
    rows = Q.measured(frame, "text", "doc_id")
    model = Q.fit(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    crc = lambda i: zlib.crc32(str(i).encode()) % 3
    own = {r.id: np.array(r.x) for r in rows.collect()}
    every = np.stack(list(own.values()))
    assert np.allclose(model.mean, every.mean(0)) and np.allclose(model.spread[every.std(0) > 1e-9], every.std(0)[every.std(0) > 1e-9])
    fits = [(own[i], q) for i, q, _ in labels if crc(i) == 0]
    z, y = model.features(np.stack([x for x, _ in fits])), np.array([q for _, q in fits], float)
    # the ridge as least squares over extra rows
    a = np.concatenate((z / np.sqrt(len(z)), np.sqrt(Q.RIDGE) * np.eye(z.shape[1])))
    direct = np.linalg.lstsq(a, np.concatenate((y / np.sqrt(len(z)), np.zeros(z.shape[1]))), rcond=None)[0]
    assert np.abs(z @ (model.beta - direct)).max() < 1e-6


def test_statistics_against_plain_counting():
    import pyarrow as pa

    for text in ("One two. TWO!\nOne", "é ñ #x | y @a/b 12", "w w w w\nw w\n", "a", "!!! ??"):
        raw, words = text.encode(), text.encode().split()
        got = Q.statistics(*text_bytes(pa.array([text])))[0]
        low = [w.lower() for w in words]
        share = lambda some: sum(some) / len(raw)
        of = lambda some: sum(some) / len(words)
        lines = raw.split(b"\n")[: -1 if raw.endswith(b"\n") else None]
        pairs = len(set(zip(low, low[1:]))) / max(len(words) - 1, 1)
        wanted = {
            0: np.log1p(len(raw)), 1: np.log1p(len(words)), 2: of(map(len, words)), 3: np.std([len(w) for w in words]), 4: share(65 <= b <= 90 for b in raw), 5: share(48 <= b <= 57 for b in raw),
            6: share(b in Q.SIGNS for b in raw), 7: share(b in b".,;:" for b in raw), 8: share(b == 10 for b in raw), 9: share(b >= 128 for b in raw), 11: of(any(b in Q.SIGNS for b in w) for w in words),
            12: of(w.endswith(b".") for w in words), 13: of(w.endswith(b",") for w in words), 14: of(w.endswith(b"!") for w in words), 15: of(w == b"|" for w in words), 16: of(len(w) > 14 for w in words), 17: of(len(w) < 3 for w in words),
            18: len(set(low)) / len(words), 19: max(map(low.count, low)) / len(words), 20: pairs, 21: np.log1p(len(lines)), 24: share(b in b"@/" for b in raw), 25: np.log1p(len(set(low))),
        }
        for k, v in wanted.items():
            assert abs(got[k] - v) < 1e-6, (text, k)


def test_votes_against_plain_counting():
    import pyarrow as pa

    mined = T.hashed(["zzgrut", "zzfrol"])
    voters, texts = T.Voters(mined), ["You IDIOT!!!!!!!!!!!! zzgrut", "(((((((((((moron))))))))))) idiot plain", "", "zzfrol. worthless zzgrut your trash", "kill"]
    counts, words = voters.counts(*text_bytes(pa.array(texts)))
    names = [*T.LEXICONS, "zzgrut", "zzfrol"]
    for text, got, n in zip(texts, counts, words):
        cores = [w.strip("\"'`()[]{}<>,.;:!?*#$%&|-_").lower() for w in text.split()]
        assert n == len(cores)
        for k, name in enumerate(names):
            assert got[k] == sum(c in T.LEXICONS[name].split() if name in T.LEXICONS else c == name for c in cores), (text, name)
