"""Conversation prefix trie, built as a Patricia tree: sort, create branch, end and leaf points only, aggregate on
the compressed tree, then expand the unary nodes of each edge from suffix sums.

A turn becomes a digest (16 bytes of SHA-256 of its role and text) before anything is shuffled, and a conversation the
string of its digests, so sorting by that string sorts conversations by their turns, prefixes first. Equal
conversations are one sequence with a count, its smallest id and the hash of its ids (ids meet in sorted chunks, so that no
list of ids is held). Distinct sequences are dealt by ranges; each task walks its sorted range once with a stack of open
points, as a sequence closes all points deeper than its common prefix with the one before. A node that reaches into
another range is a prefix of the first or the last sequence of its range: those two paths are emitted uncompressed, so such
nodes meet by key and their parts are summed; what two neighbouring ranges both counted (a shared node's own text, a
child, a leaf that the next range extends) is taken off once per border, from the common prefix of the border's two
sequences. A point of one range is complete as it is. Every point then finds its parent and expands its edge.

Turns are ordered by ``turn`` (null first), equal turns by digest; null role or text is empty. Rows whose conv_id is null or no
whole number are in no conversation. Repeated rows are repeated turns. Empty table: no node. Other columns, whatever
their names, are not read. One task holds the digests of one conversation (20 bytes a turn), never its texts.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialize, small, whole_id

#: Bytes of a digest; ids that meet in one chunk; conversations of a family; turns that a family can share.
WIDE, CHUNK_IDS, FAMILY, SHARED = 16, 10_000, 100, 6
NO_ENDS = hashlib.sha256(b"").hexdigest()
_SEQUENCE = "key binary, lens array<int>, n long, least long, ends string"
_POINT = "point binary, depth int, up binary, n long, least long, children long, leaves long, saved long, spine boolean, ends string, edge array<bigint>, first binary, last binary, lens array<int>"


def _key(turns: Column) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), ""))


def paths(conversations: DataFrame) -> DataFrame:
    """(lead, conv_id, turns): each conversation's turns in order, dealt by family (``lead``: its first id)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, WIDE)
    turns = conversations.select(whole_id("conv_id"), "turn", digest.alias("digest"), F.char_length(text).alias("len")).where("conv_id IS NOT NULL")
    dealt = turns.withColumn("lead", F.col("conv_id") - F.col("conv_id") % FAMILY).repartition("lead")
    return dealt.groupBy("lead", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "len"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, lens): the first h turns of the family's lead, then the own turns after the first h (h from the id)."""
    own = paths(conversations)
    lead = F.max(F.when(F.col("conv_id") == F.col("lead"), F.slice("turns", 1, SHARED))).over(W.partitionBy("lead"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    own = own.withColumns({"__lead": lead, "__h": h})
    given = F.coalesce(F.slice("__lead", F.lit(1), F.col("__h")), F.slice("turns", F.lit(1), F.lit(0)))
    turns = F.concat(given, F.slice("turns", F.col("__h") + 1, F.size("turns")))
    return own.select("conv_id", turns.alias("turns")).select("conv_id", _key(F.col("turns")).alias("key"), F.transform("turns", lambda t: t["len"]).alias("lens"))


def plain(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, lens) of the conversations as they are."""
    return paths(conversations).select("conv_id", _key(F.col("turns")).alias("key"), F.transform("turns", lambda t: t["len"]).alias("lens"))


def _rows(batches):
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))


def _hash_ends(batches):
    """Rows sorted by key and chunk of ids -> one row a key."""
    schema = pa.schema([("key", pa.binary()), ("lens", pa.list_(pa.int32())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
    out = []
    for key, rows in itertools.groupby(_rows(batches), lambda r: r[0]):
        state, n, least, lens = hashlib.sha256(), 0, None, None
        for _, _, here, count, low, ids in rows:
            state.update((b"," if n else b"") + ids.encode())
            n, least, lens = n + count, low if least is None else min(least, low), here
        out.append((key, lens, n, least, state.hexdigest()))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct sequences of (conv_id, key, lens) with their count, smallest id and the hash of their ids."""
    chunk = F.call_function("div", F.col("conv_id"), F.lit(CHUNK_IDS))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    met = convs.groupBy("key", chunk.alias("chunk")).agg(F.any_value("lens").alias("lens"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    return met.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_hash_ends, _SEQUENCE)


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common from the start."""
    n = min(len(a), len(b)) // WIDE
    if a[: n * WIDE] == b[: n * WIDE]:
        return n
    x, y = (np.frombuffer(k, np.uint64, 2 * n) for k in (a, b))
    return int(np.argmax(x != y)) // 2


def _ident(prefix: bytes) -> bytes:
    return hashlib.blake2b(prefix, digest_size=16).digest()


def _idents(key: bytes) -> list[bytes]:
    """The name of every prefix, in one pass."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for i in range(0, len(key), WIDE):
        h.update(key[i : i + WIDE])
        out.append(h.copy().digest())
    return out


class _Open:
    """A point whose subtree isn't closed yet."""

    __slots__ = ("depth", "n", "least", "children", "leaves", "saved", "ends", "spine")

    def __init__(self, depth, n=0, least=None, ends=None, spine=False):
        self.depth, self.n, self.least, self.ends, self.spine = depth, n, least, ends, spine
        self.children = self.leaves = self.saved = 0


def _walk(rows):
    """Points of a sorted range of distinct sequences, bottom up, and last the border row."""
    stack, key, lens, first, names = [], None, None, None, []

    def close(x: _Open, up: _Open | None, path: list[bytes] | None = None):
        if not x.children:
            x.leaves = 1
        x.saved += (x.n - 1) * lens[x.depth - 1] if x.depth else 0
        edge = list(itertools.accumulate(reversed(lens[up.depth : x.depth - 1])))[::-1] if up else []
        name = lambda d: path[d] if path else _ident(key[: WIDE * d])
        if up:
            up.n, up.children, up.leaves = up.n + x.n, up.children + 1, up.leaves + x.leaves
            up.least = x.least if up.least is None else min(up.least, x.least)
            up.saved += x.saved + (x.n - 1) * (edge[0] if edge else 0)
        return (name(x.depth), x.depth, name(up.depth) if up else None, x.n, x.least, x.children, x.leaves, x.saved, x.spine, x.ends, edge, None, None, None)

    for now, now_lens, n, least, ends in rows:
        depth = len(now) // WIDE
        if first is None:
            first, names = (now, now_lens), _idents(now)
            stack = [_Open(d, spine=True) for d in range(depth + 1)]
            stack[-1].n, stack[-1].least, stack[-1].ends = n, least, ends
        else:
            common = _common(key, now)
            while stack[-1].depth > common:
                x = stack.pop()
                if stack[-1].depth < common:
                    stack.append(_Open(common))
                yield close(x, stack[-1], names if x.spine else None)
            stack.append(_Open(depth, n, least, ends))
        key, lens = now, now_lens
    if first is None:
        return
    path = _idents(key)
    while stack:  # the last path: every node is a point
        x = stack.pop()
        x.spine = True
        while stack and x.depth > stack[-1].depth + 1:
            up = _Open(x.depth - 1, spine=True)
            yield close(x, up, path)
            x = up
        yield close(x, stack[-1] if stack else None, path)
    yield (None,) * 11 + (first[0], key, first[1])


_ARROW = pa.schema([
    ("point", pa.binary()), ("depth", pa.int32()), ("up", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
    ("spine", pa.bool_()), ("ends", pa.string()), ("edge", pa.list_(pa.int64())), ("first", pa.binary()), ("last", pa.binary()), ("lens", pa.list_(pa.int32())),
])


def _batched(rows):
    rows = iter(rows)
    while part := list(itertools.islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), _ARROW)], schema=_ARROW)


def _tree(batches):
    yield from _batched(_walk(_rows(batches)))


def _borders(batches):
    """What two neighbouring ranges both counted, for every node on the common path of their border."""

    def corrections():
        for first, lens, before in _rows(batches):
            common = _common(before, first)
            names, twice = _idents(first[: WIDE * common]), list(itertools.accumulate(reversed(lens[:common]), initial=0))
            extended = len(before) // WIDE == common
            for d in range(common + 1):
                yield (names[d], d, names[d - 1] if d else None, 0, None, -int(d < common), -int(extended), twice[common - max(d - 1, 0)], True, None, [], None, None, None)

    yield from _batched(corrections())


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, key, lens), as from ``plain`` or ``rebuilt``."""
    parts = materialize(sequences(convs).repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_tree, _POINT))
    # a row a range, whatever the number of sequences
    borders = parts.where("first IS NOT NULL").select("first", "lens", F.lag("last").over(W.orderBy("first")).alias("before")).where("before IS NOT NULL")
    points = parts.where("point IS NOT NULL").drop("first", "last", "lens")
    shared = points.where("spine").unionByName(borders.repartition("first").mapInArrow(_borders, _POINT).drop("first", "last", "lens"))
    spine = shared.groupBy("point", "depth").agg(F.max("up").alias("up"), F.min("least").alias("least"), F.max("ends").alias("ends"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    spine, inner = materialize(spine.withColumn("edge", F.array().cast("array<bigint>"))), points.where("NOT spine").drop("spine")
    # parents: those on a border's path may have any number of children, and are few; the others lie within one range
    found = inner.unionByName(spine).join(small(spine).select(F.col("point").alias("up"), F.col("least").alias("up_least")), "up", "left")
    known, rest = found.where("up IS NULL OR up_least IS NOT NULL"), found.where("up IS NOT NULL AND up_least IS NULL").drop("up_least")
    rest = rest.join(inner.select(F.col("point").alias("up"), F.col("least").alias("up_least")), "up", "left")
    nodes = known.unionByName(rest).select("*", F.size("edge").alias("unary"), F.posexplode(F.concat("edge", F.array(F.lit(0).cast("long")))).alias("i", "below"))
    last = F.col("i") == F.col("unary")
    return nodes.select(
        F.col("least").alias("conv_id"), (F.col("depth") - F.col("unary") + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("up_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("below")).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends")), F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir):
    return trie(materialize(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP13_SQL = """
WITH steps AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS r
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS len, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns), steps),
parts AS (
  SELECT c, 0 AS own, r, digest, len FROM convs JOIN turns ON conv_id = c - c % 100 WHERE r <= h
  UNION ALL SELECT c, 1, r, digest, len FROM convs JOIN turns ON conv_id = c WHERE r > h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, r) AS depth FROM parts),
prefixes AS (
  SELECT c, depth, len, string_agg(digest, '') OVER (PARTITION BY c ORDER BY depth) AS key FROM numbered
  UNION ALL SELECT c, 0, 0, '' FROM convs),
linked AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY depth) AS up, max(depth) OVER (PARTITION BY c) AS deepest FROM prefixes),
nodes AS (
  SELECT key, depth, any_value(len) AS len, any_value(up) AS up, count(*) AS n, min(c) AS least,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = deepest), '')) AS ends FROM linked GROUP BY key, depth),
children AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (key)),
below AS (SELECT p.key, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n - 1) * v.len) AS saved FROM full_nodes v JOIN prefixes p ON p.c = v.least AND p.depth <= v.depth GROUP BY p.key)
SELECT v.least AS conv_id, v.depth::BIGINT AS depth, u.least AS parent_conv_id, v.n AS n_convs, v.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM full_nodes v JOIN below USING (key) LEFT JOIN nodes u ON u.key = v.up"""
