import random
import re

import corpus_pipeline as C
from adatlas.llm import mixing, packing, secrets


def test_stages_keep_clean_documents_and_take_effect(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(120):
        words, toxic = [word() for _ in range(40)], int(i % 6 == 0)
        if toxic:
            words[3:3] = ["you", "idiot", "moron!", "pathetic"]
        if i % 10 == 1:
            words[5:5] = ["token", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"']
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, toxic))
    docs += [(500 + k, docs[2][1], "en", "s1", 0) for k in range(5)] + [(600, docs[4][1] + " end", "en", "s1", 0), (700, None, None, None, None), (701, "", "en", "s2", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = own.columns
    clean = C.without_toxic(spark, own, str(tmp_path))
    ids = sorted(x.doc_id for x in clean.collect())
    assert clean.columns == columns and ids == sorted(d[0] for d in docs if d[0] % 6 or d[0] >= 500)
    single = C.without_near_copies(spark, clean, str(tmp_path))
    assert single.columns == columns and sorted(x.doc_id for x in single.collect()) == [i for i in ids if not 500 <= i < 510 and i != 600]
    hidden = C.without_secrets(spark, single, str(tmp_path))
    texts = {x.doc_id: x.text for x in hidden.collect()}
    assert hidden.columns == columns and len(texts) == single.count()
    before = {d[0]: d[1] for d in docs}
    for i, t in texts.items():
        assert not secrets.rules(t or "")
        assert t == before[i] if i % 10 != 1 or i >= 500 else "<SECRET>" in t
    mix = C.mixed_sources(spark, hidden, str(tmp_path))
    taken = {x.doc_id: x.taken for x in mixing.mix(hidden).collect()}
    sizes = {}
    for x in mix.collect():
        sizes[x.doc_id] = sizes.get(x.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", x.text))
    assert mix.columns == columns and sizes == {i: t for i, t in taken.items() if t}
    last = C.packed(spark, mix, str(tmp_path)).collect()
    assert sum(x.length for x in last) == sum(x.length for x in packing.tokenized(mix).collect())
    assert C.run(spark, str(tmp_path)).count() == len(last) and [n for n, _ in C.STAGES][1] == "near_copies"


def test_stages_on_empty_tables_null_keys_and_clashing_names(spark, tmp_path):
    names = ["row", "score", "spans", "hash", "id", "cls", "copies", "cell", "h", "key", "size", "text_class", "__score", "__n"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    rows = [(i, words(i), "en", "s", 5, *["v"] * len(names)) for i in range(6)] + [(None, words(9), None, None, None, *[None] * len(names)), (None, None, None, None, None, *[None] * len(names)), (7, "", "en", "s", 0, *["v"] * len(names))]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        back = {(r.doc_id, r.text): r for r in out.collect()}
        if name != "mixing":  # which takes no empty text
            assert set(back) == {(r[0], r[1]) for r in rows}, name
        assert all(r[n] == ("v" if i is not None else None) for (i, _), r in back.items() for n in names), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    last = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in last) == 2 and len(last) == len(rows)
    assert C.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_copies_are_those_of_five_words_and_four_fifths(spark, tmp_path):
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    edited, added, apart = words("e", 50), words("a", 44), words("n", 48)
    texts = [edited, edited[:25] + ["other"] + edited[26:], added, added + words("more", 9), apart, apart[:24] + ["other"] + apart[25:]]
    similar = lambda a, b, n: (lambda x, y: len(x & y) / len(x | y))(*({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (a, b)))
    for a, b in (texts[:2], texts[2:4]):
        assert similar(a, b, 5) >= 0.8 and similar(a, b, 4) < 0.85
    assert similar(*texts[4:], 5) < 0.8
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    assert sorted(x.doc_id for x in C.without_near_copies(spark, docs, str(tmp_path)).collect()) == [0, 2, 4, 5]
