import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from adatlas.llm import secrets as S


def corpus(n=300, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 60))]
        if i % 3 == 0:
            words[10:10] = ["token", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"']
        if i % 5 == 0:
            words[5:5] = ["AKIA" + "".join(r.choice("ABCDEFGHJKLMNP234567") for _ in range(16))]
        rows.append((i, " ".join(words), "en"))
    return rows


def test_rules_keep_leftmost_matches_of_enough_length():
    assert S.rules('x token="abcdefgh" y') == [(0, 2, 17)]
    assert S.rules("token=short") == []
    assert S.rules("é API-KEY apikey : 12345678,") == [(0, 10, 27)]
    assert S.rules("AKIAABCDEFGHIJKL AKIAABC") == [(1, 0, 16)]
    assert S.rules("f" * 33 + " " + "a" * 31) == [(2, 0, 33)]


def test_field_adds_what_the_rules_miss_and_keeps_clean_text(spark):
    rows = corpus()
    missed = "lina toner token = '" + "9F3a" * 9 + "' sorel"  # in mixed case no hex match, and the name rule takes it
    upper = "lina toner token -> " + "9F3C" * 10 + " sorel tona lirs nale"
    docs = spark.createDataFrame([*rows, (900, missed, "en"), (901, upper, "en"), (902, None, "en"), (903, "", "en"), (904, "solo", "en")], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in S.scan(docs).collect()}
    assert len(found) == docs.count()
    for i, text, _ in rows:
        base = [(S.KINDS[k], s, e) for k, s, e in S.rules(text)]
        assert [tuple(x) for x in found[i].spans if x.kind != "crf"] == base
        if not base:
            assert found[i].spans == []
    assert [x.kind for x in found[900].spans] == ["assign"]
    assert any(x.kind == "crf" and upper[x.start : x.end].startswith("9F3C") for x in found[901].spans)
    assert found[902].spans == found[903].spans == found[904].spans == []


def half_fitted(rows):
    """A field from every other row."""
    batch = pa.RecordBatch.from_arrays([pa.array([t for i, t, _ in rows if i % 2 == 0])], ["text"])
    found = list(S.windows(batch))
    y = np.array([f[1] for f in found])
    return S.Field().fit(*S.with_hidden_words(np.array([f[0] for f in found], np.int32).reshape(*y.shape, -1), y))


def test_field_finds_held_out_secrets_that_no_rule_matches():
    rows = corpus(400, 7)
    field, found, wrong, secrets = half_fitted(rows), 0, 0, 0
    texts = []
    for i, text, _ in rows:
        if i % 2:
            hidden = re.sub(r'token = "([0-9a-f]{40})"', lambda m: "valor -> " + m[1].upper(), text)
            texts.append(re.sub("AKIA(?=[A-Z0-9]{16})", "ASIA", hidden))
    for text, spans in zip(texts, S.spans(field, pa.array(texts))):
        assert S.rules(text) == []
        true = [m.span() for m in re.finditer("[0-9A-F]{40}|ASIA[A-Z0-9]{16}", text)]
        secrets += len(true)
        found += sum(any(s < q and p < t for _, s, t in spans) for p, q in true)
        wrong += sum(not any(s < q and p < t for p, q in true) for _, s, t in spans)
    assert secrets > 60 and found >= 0.9 * secrets and wrong <= 0.02 * secrets


def test_skipping_of_documents_loses_no_run():
    rng = np.random.default_rng(3)
    field = half_fitted(corpus(120, 2))
    for _ in range(300):
        e = rng.normal(size=(int(rng.integers(1, 12)), 3)).astype(np.float32) * 4
        tags, runs = field.viterbi(e), field.runs(e)
        assert sum(j - i for i, j in runs) == sum(t != S.O for t in tags)


def base_of(text):
    """The three rules as they are stated, apart from the module's."""
    found = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_query_against_rules_stated_apart(spark, tmp_path):
    long = "wörter " * 40_000 + 'SECRET: "' + "Ab1" * 20 + '"' + " ende" * 1000
    texts = [t for _, t, _ in corpus(60, 4)] + [None, "", "api_key='a.b-c_d=' apikey=12345678 token=\u017fecret12", "tokentoken=abcdefgh" + "f" * 32, "password = password = 12345678", "AKIAAKIA" + "A" * 9 + "f" * 40, long]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in S.op10(spark, str(tmp_path)).collect():
        want = base_of(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf")] == want


def test_viterbi_against_all_taggings():
    import itertools

    rng = np.random.default_rng(0)
    field = S.Field()
    field.t[:] = rng.normal(size=(3, 3))
    field.t[0, 2] = -1e4
    for n in (1, 2, 5):
        e = rng.normal(size=(n, 3)).astype(np.float32)
        score = lambda y: sum(e[i, k] + field.t[y[i - 1] if i else 0, k] for i, k in enumerate(y))
        assert field.viterbi(e) == list(max(itertools.product(range(3), repeat=n), key=score))


def test_redact_and_empty_table(spark):
    docs = spark.createDataFrame([(1, 'é token="abcdefgh12" end', 24, None), (2, None, None, "x"), (1, 'é token="abcdefgh12" end', 24, None)], "doc_id long, text string, n_chars long, kind string")
    out = S.redact(docs).orderBy("doc_id").collect()
    assert [r.text for r in out] == ['é <SECRET>" end', 'é <SECRET>" end', None] and out[0].n_chars == 15
    assert S.redact(docs.limit(0)).columns == docs.columns and S.redact(docs.limit(0)).count() == 0


def test_marks_are_those_of_the_rules_without_lower_casing(spark):
    texts = ["no", "", "My PassWord", "passwd", "a SECRET", "toKEN", "API_Key", "apikey", "api-key", "AKIA", "akia", "f" * 32, "F" * 32, "a" * 31, "to\u212aen", "tassword", "é tOken", "x\nsecret"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    lowered = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    want = [any(k in lowered(t) for k in S.KEYWORDS) or "AKIA" in t or bool(S.HEX.search(t)) for t in texts]
    found = docs.select(S.marked("text").alias("marked"))
    assert [r.marked for r in found.collect()] == want
    assert "lower(" not in found._jdf.queryExecution().toString()


def test_texts_are_read_in_small_batches(spark):
    S.redact(spark.createDataFrame([(1, "token=abcdefgh")], "doc_id long, text string")).collect()
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
