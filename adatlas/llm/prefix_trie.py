"""Prefix trie of conversations by van Emde Boas recursion.

A conversation is a sequence of tokens of 20 bytes, one for each turn. Each round cuts every sequence at half depth: what
stands before the cut is named and goes on in the upper trie; what stands after it goes on in the lower trie that
hangs at that name. Equal pieces meet and are counted, and upper trie and lower forests go into the next round together,
with half the depth, until each piece is one turn. So a node at depth d = odd * 2^k is named in the round that cuts at
2^k, and the names of the cuts that a piece has passed through, its `chain`, belong to the set bits of its depth.

Totals then go upward. A node's weight is added to every lower trie that it lies in, those of its chain: depth-many
ancestors are served by logarithmically many sums. Level by level, the totals of what hangs at the ends of a lower trie
are grafted onto the totals of the cut above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adatlas.functions.ordered import in_order
from adatlas.llm.common import stash

#: The root's name, the bytes of a name and of a token (md5 of role and text, length of the text).
ROOT, NAME, TOKEN = "X'00000000000000000000000000000000'", 16, 20
#: Turns of a piece before the first cut, as a power of two: a longer conversation lies in several rows, and only a digest of each of its pieces is brought together.
PIECE_BITS = 12
#: Members' ids are joined in blocks of so many ids, a power of two, before they are hashed in order.
ID_BITS = 12


def token(role: Column, text: Column) -> Column:
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.md5(body.cast("binary")), F.lpad(F.hex(F.octet_length(text)), 8, "0"))


def turns(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, tok): the turns of each conversation in order, pos from 0, tok as hexadecimal digits."""
    own = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), token(F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))).alias("tok"))
    return in_order(own, ["conv"], [(F.col("turn"), False)], [(F.col("tok"), False)], number="pos").select("conv", (F.col("pos") - 1).alias("pos"), "tok")


def chain(start: str, seq: str, upto: str, bits: int) -> Column:
    """The names of the cuts before `upto` tokens of a sequence whose first `start` hangs at: one for each set bit, from the highest."""
    last = f"if(length(a.c) = 0, {start}, substring(a.c, length(a.c) - {NAME - 1}, {NAME}))"
    named = f"concat(a.c, unhex(md5(concat({last}, substring({seq}, a.at * {TOKEN} + 1, shiftleft({TOKEN}, k))))))"
    step = f"if(getbit({upto}, k) = 1, named_struct('c', {named}, 'at', a.at + shiftleft(1, k)), a)"
    return F.expr(f"aggregate(sequence({bits}, 0), named_struct('c', X'', 'at', 0), (a, k) -> {step}).c")


def end_of(names: str, start: str) -> Column:
    """The last name of a chain, or where it begins."""
    return F.expr(f"if(length({names}) = 0, {start}, substring({names}, length({names}) - {NAME - 1}, {NAME}))")


def pieces_of(rows: DataFrame, convs: DataFrame, bits: int) -> DataFrame:
    """(conv, before, seq, end): the sequence of each conversation in pieces of 2**bits turns. before: the chain of the cuts before the piece; end: where the whole conversation ends, with its last piece only. Conversations without turns have no piece."""
    size = 1 << bits
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda t: t.tok), ""))
    own = stash(rows.groupBy("conv", F.shiftright("pos", bits).cast("int").alias("j")).agg(joined.alias("seq")), "pieces")  # at most 2**bits turns
    # digests of whole pieces, 20 bytes for each, make sequences of their own, in which the cuts between pieces are named
    whole = own.where(F.octet_length("seq") == TOKEN * size)
    digest = F.concat(F.md5("seq"), F.lit("00000000"))
    outer = whole.groupBy("conv").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", digest.alias("d")))), lambda t: t.d), "")).alias("outer"))
    own = own.join(outer, "conv", "left").withColumn("outer", F.coalesce("outer", F.expr("X''")))
    own = own.withColumn("before", chain(ROOT, "outer", "j", 30 - bits)).withColumn("start", end_of("before", ROOT))
    is_whole = F.octet_length("seq") == TOKEN * size
    own = own.withColumn("n", F.floor(F.octet_length("seq") / TOKEN).cast("int")).withColumn("next", F.expr("j + 1"))
    cut = own.withColumn("after", chain(ROOT, "outer", "next", 30 - bits))
    last = cut.withColumn("own", chain("start", "seq", "n", bits - 1))
    top = F.when(is_whole, end_of("after", ROOT))
    return last.select("conv", "j", "before", "seq", "n", top.alias("top"), F.coalesce(top, end_of("own", "start")).alias("end"))


def cut_once(pieces: DataFrame, k: int) -> DataFrame:
    """One round: pieces of at most 2**(k+1) turns become pieces of at most 2**k, equal ones counted together."""
    half = TOKEN << k
    own = pieces.withColumn("size", F.octet_length("seq"))
    start = f"if(length(chain) = 0, {ROOT}, substring(chain, length(chain) - {NAME - 1}, {NAME}))"
    own = own.withColumn("name", F.expr(f"if(size >= {half}, unhex(md5(concat({start}, substring(seq, 1, {half})))), null)"))
    upper = F.expr(f"named_struct('chain', chain, 'seq', if(size > {half}, substring(seq, 1, {half}), seq), 'top', name, 'at', at)")
    lower = F.expr(f"if(size > {half}, named_struct('chain', concat(chain, name), 'seq', substring(seq, {half + 1}), 'top', top, 'at', at + {1 << k}L), null)")
    both = own.select(F.explode(F.array_compact(F.array(upper, lower))).alias("p"), "n_convs", "conv_id").select("p.*", "n_convs", "conv_id")
    return both.groupBy("chain", "seq", "top", "at").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


def named(pieces: DataFrame, bits: int) -> DataFrame:
    """(node, parent, chain, depth, bytes, n_convs, conv_id): all nodes but the root."""
    own = pieces.groupBy(F.col("before").alias("chain"), "seq", "top", (F.shiftleft(F.col("j").cast("long"), bits)).alias("at")).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"))
    for k in range(bits - 1, -1, -1):
        own = cut_once(own, k)
    size = F.conv(F.hex(F.expr(f"substring(seq, {NAME + 1}, 4)")), 16, 10).cast("long")
    return own.select(F.col("top").alias("node"), end_of("chain", ROOT).alias("parent"), "chain", (F.col("at") + 1).alias("depth"), size.alias("bytes"), "n_convs", "conv_id")


SUMS = ["n_leaves", "saved_tokens"]


def below(nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens): sums of nodes' own values over all that is strictly below each node that isn't a leaf. nodes: node, chain, depth and the values."""
    place = f"substring(chain, {NAME} * i + 1, {NAME})"
    cuts = F.expr(f"transform(sequence(0, cast(length(chain) / {NAME} as int) - 1), i -> {place})")
    within = nodes.where("length(chain) > 0").select(F.explode(cuts).alias("node"), *SUMS).groupBy("node").agg(*[F.sum(c).alias(c) for c in SUMS])
    level = F.bit_count(F.col("depth").bitwiseAND(-F.col("depth")) - 1)
    held = stash(within.join(nodes.select("node", "chain", level.alias("level")), "node"), "cuts")
    top = held.agg(F.max("level")).first()[0]
    done: list[DataFrame] = []
    for k in range(top if top is not None else -1, -1, -1):
        own = held.where(F.col("level") == k).select("node", "chain", *SUMS)
        if done:  # a lower trie of this level ends at cuts of higher levels: the entry of a cut's chain for level k is that many before its last
            at = F.expr(f"substring(chain, length(chain) - {NAME * (k + 1) - 1}, {NAME})")
            ends = reduce(DataFrame.unionByName, [d.select(at.alias("of"), *SUMS) for d in done]).groupBy("of").agg(*[F.sum(c).alias(f"more_{c}") for c in SUMS])
            own = own.join(ends, own.node == ends.of, "left").select("node", "chain", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in SUMS])
        done.append(stash(own, "grafted"))
    return reduce(DataFrame.unionByName, done).drop("chain") if done else within


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(node, sha): SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are joined in blocks of bounded size, the blocks of a node then fed to its hash in order, one held at a time.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("node", F.shiftright("conv", ID_BITS).alias("block")).agg(ids.alias("ids"))
    blocks = blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            nodes, out = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node == at:
                    state.update(b"," + text.encode())
                    continue
                if at is not None:
                    nodes.append(at)
                    out.append(state.hexdigest())
                at, state = node, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.string())], ["node", "sha"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["node", "sha"])

    return blocks.mapInArrow(digest, "node binary, sha string")


def trie(rows: DataFrame, convs: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """The trie of sequences. rows: (conv, pos, tok), pos from 0 without gaps, tok as of `token`; convs: (conv), every conversation, also those without rows."""
    rows = stash(rows, "rows")
    longest = rows.agg(F.max("pos")).first()[0]
    bits = min(piece_bits, (longest + 1 if longest is not None else 0).bit_length())
    pieces = stash(pieces_of(rows, convs, bits), "sequences")
    nodes = stash(named(pieces, bits), "nodes")
    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children"))
    own = nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = stash(own.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}), "weighed")
    # the last piece of a conversation tells where it ends
    last = pieces.groupBy("conv").agg(F.max_by("end", "j").alias("node"))
    ends = convs.join(last, "conv", "left").select("conv", F.coalesce("node", F.expr(ROOT)).alias("node"))
    shas = hashed_ends(ends)
    more = below(own.select("node", "chain", "depth", *SUMS)).select("node", *[F.col(c).alias(f"more_{c}") for c in SUMS])
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    first = own.where("depth = 1").agg(F.count("*").alias("n_children"))
    total = own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])
    root = root.join(F.broadcast(first)).join(F.broadcast(total))  # one row each
    root = root.select(F.expr(ROOT).alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")
    out = own.join(more, "node", "left").select("node", "conv_id", "depth", "parent", "n_convs", "n_children", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in SUMS])
    out = stash(out.unionByName(root), "totals")
    above = out.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    of_root = out.where("depth = 0").select(F.col("conv_id").alias("root_conv_id"))  # one row
    out = out.join(above.where(f"parent <> {ROOT}"), "parent", "left").join(F.broadcast(of_root))
    out = out.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_conv_id")).otherwise(F.col("parent_conv_id")))
    return out.join(shas, "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "node", "parent")


def build(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_bits: int = PIECE_BITS) -> DataFrame:
    """The trie of conversations as they stand, with the names of each node and its parent.

    Turns stand in order of turn, null first, equal ones by a digest of role and text; repeated rows are turns each;
    null roles and texts are empty. Rows without a conversation id are left out, other columns ignored. Without any
    conversation there is no node, not even the root.
    """
    own = turns(df, key, turn, role, text)
    return trie(own, df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv")).distinct(), piece_bits)


#: The rebuilding: conversations of a group of five begin with the same first turns, at most this many.
GROUP, MOST_SHARED = 5, 8


def rebuilt(own: DataFrame, convs: DataFrame) -> DataFrame:
    """Every conversation c anew: the first h turns of c - c % 5, then its own after the first h; h is crc32 of c modulo 9. own: (conv, pos, tok)."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    heads = stash(own.where((F.col("conv") % GROUP == 0) & (F.col("pos") < MOST_SHARED)), "heads")
    group = convs.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("head"))
    n = heads.groupBy(F.col("conv").alias("head")).agg(F.count("*").alias("n"))
    group = stash(group.join(n, "head", "left").withColumn("have", F.least("h", F.coalesce("n", F.lit(0)))), "groups")
    begin = group.join(heads.select(F.col("conv").alias("head"), "pos", "tok"), "head").where("pos < h").select("conv", "pos", "tok")
    rest = own.where(F.col("pos") >= h).join(group.select("conv", "h", "have"), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("have")).alias("pos"), "tok")
    return begin.unionByName(rest)


def op11(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = stash(turns(df, "conv_id", "turn", "role", "text"), "turns")
    convs = stash(own.select("conv").distinct(), "conversations")
    return trie(rebuilt(own, convs), convs).drop("node", "parent")


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) - 1 AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), h AS (  -- crc32, bit by bit
  SELECT c, c - c % 5 AS head, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(c::VARCHAR)), lambda i: ascii((c::VARCHAR)[i + 1])::BIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM t)
), b AS (
  SELECT h.c, 0 AS part, p, role, text FROM h JOIN t ON t.c = h.head AND p < h UNION ALL SELECT h.c, 1, p, role, text FROM h JOIN t ON t.c = h.c AND p >= h
), s AS (
  SELECT c, row_number() OVER w AS d, text, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY part, p ROWS UNBOUNDED PRECEDING) AS k FROM b WINDOW w AS (PARTITION BY c ORDER BY part, p)
  UNION ALL SELECT c, 0, '', [] FROM h
), n AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n, any_value(text) AS text FROM s GROUP BY k, d
), f AS (
  SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n - 1) * strlen(text) AS saved FROM n LEFT JOIN f ON n.k = f.k
), a AS (
  SELECT s.k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM w JOIN s ON s.c = w.conv_id AND s.d <= w.d GROUP BY s.k
), e AS (
  SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, max_by(k, d) AS k FROM s GROUP BY c) GROUP BY k
)
SELECT w.conv_id, w.d::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM w JOIN a ON w.k = a.k LEFT JOIN e ON e.k = w.k LEFT JOIN n p ON w.d > 0 AND p.k = w.k[1:w.d - 1] AND p.d = w.d - 1
"""
