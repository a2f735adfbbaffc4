import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from adatlas.llm import packing as P
from adatlas.llm.common import text_bytes
from adatlas.llm.subwords import WordIds

TEXTS = ["", " \n\t ", "Hello, World! it's 42 o'clock", "ÉCOLE naïve Straße İstanbul ΣΊΣΥΦΟΣ ﬁne é", "<|endoftext|> a b", "x y z\u0085w  q \x1cq", "日本語 テキスト 😀😀 !!!", "a" * 3000, "don't 'll we've ### $$$ a.b_c"]


def test_word_ids_equal_whole_text_ids():
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    words = WordIds(path, most=20)
    for texts in (TEXTS, TEXTS[::-1], [None, *TEXTS]):
        ids, at = words.encode(*text_bytes(pa.array(texts, pa.string())))
        for text, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def test_breeding_reaches_a_perfect_packing():
    r = random.Random(5)
    sizes = []
    for _ in range(40):  # 40 full bins cut at random
        cuts = sorted(r.sample(range(1, 1000), r.randint(1, 4)))
        sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 1000])]
    r.shuffle(sizes)
    first = P.bred(sizes, 1000, [], 1)
    best = first
    for step in range(6):
        best = P.bred(sizes, 1000, best, step)
    packing = P.from_assigned(sizes, 1000, best[0])
    assert max(packing.fill) <= 1000 and sum(packing.fill) == sum(sizes) and len(packing.bins) <= 41
    assert packing.worth() >= P.from_assigned(sizes, 1000, first[0]).worth()


def cut_bins(seed, most=30, bins=8):
    """Sizes that fill `bins` bins, cut at random."""
    r, sizes = random.Random(seed), []
    for _ in range(bins):
        cuts = sorted(r.sample(range(1, most), r.randint(1, 3)))
        sizes += [b - a for a, b in zip([0, *cuts], [*cuts, most])]
    return sizes


def test_pack_breeds_where_best_fit_needs_more_sequences(spark):
    for seed in (0, 4):
        sizes = cut_bins(seed)
        fitted = P.Packing(sizes, 30).best_fit(sorted(range(len(sizes)), key=lambda p: -sizes[p]))
        assert len(fitted.bins) == 9
        docs = spark.createDataFrame([(i, "the " * (n - 1)) for i, n in enumerate(sizes)], "doc_id long, text string")
        out = P.pack(docs, most=30).toPandas()
        assert sorted(out.length) == sorted(sizes) and out.sequence_id.nunique() == 8
        assert out.groupby("sequence_id").length.sum().max() == 30


def test_pack_cuts_only_long_documents_and_leaves_no_gap(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 16)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "of", "and", "to"]) for _ in range(r.choice([0, 3, 30, 80, 99, 100, 250])))) for i in range(80)]
    rows += [(500, None), (7, rows[7][1]), (None, "the of")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    out = P.pack(docs, most=100).toPandas()
    whole = Tokenizer.from_file(P.vocabulary())
    wanted = []
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        wanted += [(i, k // 100, k, len(ids[k : k + 100]), zlib.crc32(np.array(ids[k : k + 100], "<u4").tobytes())) for k in range(0, len(ids), 100)]
    got = [(None if np.isnan(a) else int(a), *map(int, rest)) for a, *rest in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    out = out.sort_values(["sequence_id", "offset"])
    total = out.groupby("sequence_id").length
    assert total.sum().max() <= 100 and (total.cumsum() - out.length == out.offset).all()
    sizes = sorted(map(int, out.length), reverse=True)
    # shards of 16 pieces are packed apart, but for their poor bins
    assert total.ngroups <= len(P.Packing(sizes, 100).best_fit(range(len(sizes))).bins) + 1
    assert P.pack(docs.limit(0)).count() == 0


def fewest(sizes, most):
    """By trying every place of every piece."""
    best = [len(sizes)]

    def put(k, fill):
        if len(fill) < best[0]:
            if k == len(sizes):
                best[0] = len(fill)
            else:
                for j in {f: j for j, f in enumerate(fill) if f + sizes[k] <= most}.values():
                    put(k + 1, [f + sizes[k] * (i == j) for i, f in enumerate(fill)])
                put(k + 1, [*fill, sizes[k]])

    put(0, [])
    return best[0]


def test_lower_bound_against_all_packings():
    r, sharp = random.Random(4), 0
    for _ in range(300):
        most = r.choice([7, 10, 30])
        sizes = sorted((r.randint(1, most) for _ in range(r.randint(0, 8))), reverse=True)
        least, best = P.least_bins(sizes, most), fewest(sizes, most)
        assert -(-sum(sizes) // most) <= least <= best, (sizes, most)
        sharp += least == best
    assert sharp > 270
    assert P.least_bins([3000] * 5, 4096) == 5 and P.least_bins([], 9) == 0 and P.least_bins([2048] * 5, 4096) == 3


def test_each_shard_above_its_bound_is_bred(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 24)
    sizes = [n for seed in range(24) for n in cut_bins(seed, bins=4)]
    docs = spark.createDataFrame([(i, "the " * (n - 1)) for i, n in enumerate(sizes)], "doc_id long, text string").coalesce(1)
    seen, islands = [], P.islands

    def watched(whole, fits, most, seed):
        out = P.stash(islands(whole, fits, most, seed), "watched")
        better = fits.join(out, "shard").where("array_max(bred) + 1 < bins").count()
        seen.append((whole.count(), out.count(), better))
        return out

    monkeypatch.setattr(P, "islands", watched)
    bred = P.pack(docs, most=30).toPandas()
    assert any(shards > 1 and above and better for shards, above, better in seen), seen
    assert sorted(bred.length) == sorted(sizes) and bred.groupby("sequence_id").length.sum().max() == 30
    monkeypatch.setattr(P, "islands", lambda whole, fits, most, seed: fits.select("shard", P.F.col("bin_of").alias("bred")))
    plain = P.pack(docs, most=30).toPandas()
    assert bred.sequence_id.nunique() <= plain.sequence_id.nunique()
