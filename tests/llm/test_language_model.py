import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from adatlas.llm import language_model as M

LOW = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus(n=150, seed=4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words, w = [], "the"
        for _ in range(r.choice([3, 40, 120])):
            w = r.choice({"the": ["cat", "dog", "old"], "old": ["cat", "dog"], "cat": ["sat", "ran"], "dog": ["ran", "sat"], "sat": ["the", "."], "ran": ["the", "."], ".": ["The", "the"], "The": ["old", "cat"]}[w])
            words.append(w if r.random() > 0.02 else f"odd{r.randrange(1000)}")
        out.append((i, " ".join(words), 1))
    return out


@pytest.mark.parametrize("common", [200_000, 3])
def test_scores(spark, monkeypatch, common):
    monkeypatch.setattr(M, "COMMON", common)
    monkeypatch.setattr(M, "SAMPLE", 60)
    monkeypatch.setattr(M, "STEPS", 60)
    rows = [*corpus(), (900, None, 1), (901, " \n", 1), (902, "x " * 6000, 1), (None, "the cat", 1), (903, "cat cat zebra zebra", 1), (903, "cat cat zebra zebra", 1)]
    got = M.score(spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)).collect()
    assert len(got) == len(rows)
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", LOW(t)) + [None]) for i, t, _ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((str(i), len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == wanted
    assert {r.train_tokens for r in got} == {n} and all(r.held_out == held(r.doc_id) for r in got) and all(r.score < 0 for r in got)
    plain = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in plain) > sum(r.base_score for r in plain)  # the order of words tells more than their counts
    assert M.score(spark.createDataFrame(rows[:1], "doc_id long, text string, score int").limit(0)).count() == 0


def test_probabilities_sum_to_one_and_ids_are_scored_once():
    r = np.random.default_rng(0)
    texts = [r.integers(0, 300, r.integers(0, 90)) for _ in range(40)]
    model = M.Attention(np.bincount(np.concatenate(texts), minlength=M.IDS), np.stack([texts[5][:-1], texts[5][1:]], 1))
    model.learn_counts(r.integers(0, 3, (M.BEFORE, M.OWN)) * (np.bincount(model.slot, minlength=M.OWN) > 0))
    # scores of one text do not depend on its neighbours
    together = model.score(texts)
    assert np.allclose(together, [model.score([t])[0] for t in texts], atol=1e-3)
    logits, _ = model.forward(np.full(M.HALF, M.END), np.array([True]))
    p = np.exp(logits[0] - logits[0].max())
    p /= p.sum()
    within = 10.0 ** model.within[model.kind[M.END], model.slot]
    assert abs((p[model.group] * within).sum() - 1) < 1e-3


def test_gradients_against_differences():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 50, 40) for _ in range(3)]
    model = M.Attention(np.bincount(np.concatenate(texts), minlength=M.IDS), np.stack([texts[0][:-1], texts[0][1:]], 1))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, docs, _ = M.streamed(texts)
    fresh, to = M.begins(docs), r.integers(0, M.CLASSES, len(ids))

    def loss():
        z, kept = model.forward(ids, fresh)
        z = z - z.max(1, keepdims=True)
        return (np.log(np.exp(z).sum(1)) - z[np.arange(len(ids)), to]).sum(), z, kept

    _, z, kept = loss()
    g = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    g[np.arange(len(ids)), to] -= 1
    grads = model.backward(g, kept)
    for name in ("q", "k", "v", "x", "o", "c", "r", "e"):
        w = model.p[name]
        at = tuple(r.integers(0, s) for s in w.shape) if name != "e" else (model.slot[ids[5]], 3)
        w[at] += 1e-5
        up = loss()[0]
        w[at] -= 2e-5
        down = loss()[0]
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at])), name


def test_every_id_has_its_own_count():
    r = np.random.default_rng(3)
    counts = np.concatenate((r.permutation(np.arange(1, 6001)), np.zeros(M.IDS - 6000, np.int64)))
    pairs = np.stack((np.arange(5999), np.arange(1, 6000)), 1)
    model = M.Attention(counts, pairs)
    last = np.flatnonzero(model.slot == M.OWN - 1)
    assert (counts[last] > 0).sum() == 6000 - M.OWN + 1
    model.learn_counts(r.integers(0, 3, (M.BEFORE, M.OWN)), counts)
    often, once, never = (int(last[np.argmax(counts[last] == c)]) for c in (1500, 1, 0))
    got = model.score([np.array([k]) for k in (often, once, never)]) - model.score([np.array([never])])
    assert np.allclose(model.own[[often, once]] - model.own[never], np.log10([15001, 11]), atol=1e-4) and got[0] - got[1] == pytest.approx(np.log10(1500.1 / 1.1), abs=1e-3)
    p = np.bincount(model.group, 10.0 ** (model.within[model.kind[M.END], model.slot] + model.own), M.CLASSES)
    assert np.allclose(p[np.bincount(model.group, minlength=M.CLASSES) > 0], 1, atol=1e-3)


def test_training_takes_whole_texts_of_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "SAMPLE", 1)
    monkeypatch.setattr(M, "SHARE", 1.0)
    a, b = np.tile([1, 2], 2000), np.tile([3, 4], 2000)
    texts = spark.createDataFrame([(k, (np.concatenate((a, b)) if k else a).astype("<u2").tobytes()) for k in range(8)], "key long, ids binary").repartition(4)
    counts, pairs = np.bincount(a, minlength=M.IDS) + np.bincount(b, minlength=M.IDS), np.stack((a[:-1], a[1:]), 1)
    start = M.Attention(counts, pairs).fit([a])
    before = start.score([b])[0]
    after = M.taught(start, texts, 8)
    assert after.score([b])[0] > before + 100  # b stands beyond the first 512 ids of texts only
    cells = M.counted_pairs(texts, lambda x, y: (x == 3) * (y == 4) + 2 * ((x == M.END) & (y == 1)), 4)
    assert cells[1] == 7 * 2000 and cells[2] == 8


def test_places_come_from_all_training_documents(spark, monkeypatch):
    seen = []
    kept = M.Attention.learn_counts
    monkeypatch.setattr(M.Attention, "learn_counts", lambda self, counts, each=None: (seen.append((counts, each)), kept(self, counts, each)))
    monkeypatch.setattr(M, "SAMPLE", 3)
    monkeypatch.setattr(M, "STEPS", 5)
    rows = [(k, "alpha beta gamma" if k % 50 else "omega zebra " * 9) for k in range(300)]
    M.score(spark.createDataFrame(rows, "doc_id long, text string")).count()
    (counts, each), train = seen[0], [t for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    assert each[M.END] == 2 * len(train) and each.sum() == counts.sum() + len(train)
    assert sorted(each[each > 0])[:2] == [9 * sum("omega" in t for t in train)] * 2


def test_scores_do_not_hang_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "SAMPLE", 40)
    monkeypatch.setattr(M, "STEPS", 5)
    monkeypatch.setattr(M, "DEALT", 25)
    r = np.random.default_rng(8)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"], r.integers(0, 60)))) for k in range(400)] + [(None, None), (3, "alpha beta")]
    rows += [(9, "copied text of one row")] * 200
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((-1 if d.doc_id is None else d.doc_id, d.n_tokens, d.score) for d in M.score(frame.repartition(n)).collect()) for n in (3, 7)]
    assert len(got[0]) == len(rows) and [g[:2] for g in got[0]] == [g[:2] for g in got[1]]
    assert np.allclose([g[2] for g in got[0]], [g[2] for g in got[1]], rtol=1e-6, atol=1e-6)
