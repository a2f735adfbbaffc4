import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from adatlas.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int, n int, chain string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(v)] for c, v in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for s in members:
        if s:
            children[s[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, who in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(who) - 1) * len(s[-1][1].encode()) if s else 0
    out = []
    for s, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(sequences[c]) == len(s))
        out.append((min(who), len(s), min(members[s[:-1]]) if s else None, len(who), children[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(5)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def conversations(seed, convs, most):
    rng = random.Random(seed)
    rows, turns = [], [("user", "a"), ("user", "bé"), ("system", None), (None, "a"), ("user", ""), ("user", "long " * 5000)]
    for c in range(convs):
        for t in range(rng.randrange(most + 1)):
            rows.append((c, rng.choice([t, t, t, None, 1]), *turns[min(rng.randrange(len(turns)), rng.randrange(len(turns)))]))
    return rows


@pytest.mark.parametrize("seed, piece_bits", [(1, 2), (2, 12)])
def test_trie_equals_counting_every_prefix(spark, seed, piece_bits):
    """Pieces of four turns take the way of conversations that are longer than a row."""
    rows = conversations(seed, 40, 21) + [(None, 0, "user", "a"), (50, 0, "user", "a"), (50, 0, "user", "a")]
    assert result(P.build(made(spark, rows), piece_bits=piece_bits)) == brute(ordered(rows))


def test_deep_conversations_share_long_beginnings(spark):
    rows = [(c, t, "user", str(t if t < 40 * c else (c, t))) for c in range(4) for t in range(130 - c)]
    want = brute(ordered(rows))
    assert result(P.build(made(spark, rows), piece_bits=4)) == want
    assert result(P.build(made(spark, rows), piece_bits=7)) == want


def test_rebuilding(spark, tmp_path):
    """Groups whose head is absent or short, and conversations that end up without turns."""
    rows = [r for r in conversations(3, 60, 12) if r[0] % 10]
    made(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute(rebuilt(ordered(rows)))
    assert any(not turns for turns in rebuilt(ordered(rows)).values())
    assert result(P.op11(spark, str(tmp_path))) == want


def test_empty_tables_and_conversations_without_an_id(spark):
    assert result(P.build(made(spark, []))) == []
    assert result(P.build(made(spark, [(None, 1, "user", "a")]))) == []


def test_ids_of_many_members_are_hashed_in_order(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 60000, 7)]
    got = result(P.build(made(spark, rows)))
    want = hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
    assert got == [(0, 0, None, len(rows), 1, 1, (len(rows) - 1) * 4, hashlib.sha256(b"").hexdigest()), (0, 1, 0, len(rows), 0, 1, (len(rows) - 1) * 4, want)]
