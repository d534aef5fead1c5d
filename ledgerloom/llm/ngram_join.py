"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents are sets of hashed word n-grams; equal sets are one node. Pairs of nodes with
``100 * |A & B| >= 75 * |A | B|`` are links; the result is the connected component of each document. No link
between different components is missed:

* *First links.* Nodes that share a bucket of minima (a locality-sensitive sketch) are compared with one hub of
  their bucket. This is linear in the nodes and joins groups of near copies before any pair is formed. It
  decides nothing alone: it only gives provisional labels.
* *Blocked product.* Under one global order of n-grams (rare before frequent, then by hash) two linked nodes
  share an n-gram among the first ``n - ceil(0.75 n) + 1`` of each. These prefixes are the columns of the
  product, cut into blocks by hash. A first product only tells which documents share a list with another label;
  of these, the n-grams that any of them shares are counted on their whole sets, and documents that share too few
  for any link are left out (edited copies that drifted too far, pages around a common passage). The second
  product accumulates overlap counts in each block, for pairs of different label whose sizes and shared sizes
  allow a link. Counts are added over blocks, and pairs whose count plus the largest possible rest stays below
  the bound derived from their sizes are discarded.
* *Frequent n-grams* (known from a counting pass; at most ``MAX_HOT`` of them, the threshold rises until they
  fit) come last in the order, so that they are used only by documents made of them. Their lists are never
  gathered in one task: they stay rows; lists under one label are dropped, and in the others the rows outside
  the most common label are joined with all rows.
* *Exact check* of the remaining pairs on their whole sets.

Order and labels change the work only, never the result. Sets are compared by 64-bit hashes of n-grams, nodes
are known by a 64-bit hash of their set.

Ids are whole numbers; others read as null. Null text and text without words: 0 n-grams, linked with nothing. Fewer words than ``n``: the whole sequence is
the one n-gram. Rows with equal text and id are equal rows. A null doc_id never is the smallest id; a component
of null ids only has a null id. Empty tables give empty results; other columns are ignored here and kept by
``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components, roots
from .kernels import FOLDED, U, chunks, mix, packed, unpacked, window_hashes
from .store import BROADCAST_ROWS, bounded, materialize, whole_id
from .substrings import _by_bucket, buckets_for, repeated_spots

N, PERCENT = 5, 75
BANDS, BINS_PER_BAND = 12, 3
#: An n-gram in more nodes than this is frequent; at most MAX_HOT frequent ones are told to every task.
HOT, MAX_HOT = 64, 1 << 18
#: An n-gram that more nodes of one center have, and the center lacks, is taken into the center.
USUAL = 32
#: Postings that a task holds before it sends them on.
HOLD = 400_000
SALT = U(0x632BE59BD9B4E019)


def sets(chunk, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of each document of a chunk, sorted: (hashes, document index, number per document)."""
    h, count = chunk.hashes(FOLDED), chunk.counts()
    grams = window_hashes(h, n) if len(h) >= n else np.empty(0, np.uint64)
    out, size = [], np.zeros(len(count), np.int64)
    for k in range(len(count)):
        a, c = chunk.first[k], count[k]
        if c >= n:
            g = np.sort(grams[a : a + c - n + 1])
            if len(g) > 1:
                g = g[np.concatenate(([True], g[1:] != g[:-1]))]
        elif c:
            g = window_hashes(h[a : a + c], int(c))
        else:
            continue
        out.append(g)
        size[k] = len(g)
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.repeat(np.arange(len(count)), size), size


def set_keys(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ SALT), dtype=np.uint64)))
    b = np.concatenate(([0], np.cumsum(size)))
    return mix((c[b[1:]] - c[b[:-1]]) + size.astype(np.uint64) * U(0xD6E8FEB86659FD93)).view(np.int64)


def _bands(tokens: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """One hash per band of minima (one-permutation sketch); 0 where a band has no n-gram."""
    bins = BANDS * BINS_PER_BAND
    m = mix(tokens + SALT)
    low = np.full(docs * bins, ~U(0))
    np.minimum.at(low, doc * bins + (m % U(bins)).astype(np.int64), m)
    low = low.reshape(docs, BANDS, BINS_PER_BAND)
    out = np.zeros((docs, BANDS), np.uint64)
    for k in range(BINS_PER_BAND):
        out = mix(out ^ low[:, :, k]) + U(k)
    out = mix(out ^ np.arange(1, BANDS + 1, dtype=np.uint64) * SALT)
    out[(low == ~U(0)).all(2)] = 0
    return out.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(whole_id(), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for b in batches:
            size, key, bands = [], [], []
            for c in chunks(b.column(2)):
                tokens, doc, s = sets(c, n)
                size.append(s)
                key.append(set_keys(tokens, s))
                bands.append(_bands(tokens, doc, len(s)))
            size, key = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (size, key))
            flat = np.concatenate(bands).ravel() if bands else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(key), lists], ["doc_id", "t", "n", "k", "bands"])

    return materialize(docs.mapInArrow(run, "doc_id long, t long, n long, k long, bands array<long>"))


def _pick(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents by (id, text hash); the wanted rows are broadcast when counted to be few, else both sides shuffle."""
    wanted = wanted.select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__d"]) & (docs["t"] == wanted["__t"]), "left_semi")


def compared(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int, rest: bool = False) -> DataFrame:
    """Pairs (x, y) of nodes with their exact overlap: (x, y, nx, ny, both, ok, rest: n-grams of x that y lacks)."""
    ends = materialize(pairs.select(F.col("x").alias("k")).unionByName(pairs.select(F.col("y").alias("k"))).distinct().join(nodes, "k").select("doc_id", "t", "k"))

    def run(batches):
        for b in batches:
            for c in chunks(b.column(2)):
                tokens, _, size = sets(c, n)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(tokens, size)), packed(tokens, np.concatenate(([0], np.cumsum(size))))], ["k", "s"])

    whole = materialize(_pick(docs, ends).mapInArrow(run, "k long, s binary").groupBy("k").agg(F.first("s").alias("s")))

    def check(batches):
        for b in batches:
            a, ab = unpacked(b.column("sx"), np.uint64)
            c, cb = unpacked(b.column("sy"), np.uint64)
            both, left = np.zeros(b.num_rows, np.int64), []
            for i in range(b.num_rows):
                p, q = a[ab[i] : ab[i + 1]], c[cb[i] : cb[i + 1]]
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                hit = q[at] == p
                both[i] = hit.sum()
                if rest:
                    left.append(p[~hit])
            nx, ny = np.diff(ab), np.diff(cb)
            ok = 100 * both >= percent * (nx + ny - both)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(nx - both if rest else 0 * nx))).astype(np.int32)), pa.array((np.concatenate(left) if left else np.empty(0, np.uint64)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(nx), pa.array(ny), pa.array(both), pa.array(ok), lists], ["x", "y", "nx", "ny", "both", "ok", "rest"])

    joined = pairs.join(whole.select(F.col("k").alias("x"), F.col("s").alias("sx")), "x").join(whole.select(F.col("k").alias("y"), F.col("s").alias("sy")), "y")
    return materialize(joined.select("x", "y", "sx", "sy").mapInArrow(check, "x long, y long, nx long, ny long, both long, ok boolean, rest array<long>"))


def first_links(nodes: DataFrame) -> DataFrame:
    """One candidate per node: the hub it shares most bands with. A bucket's hub is its most central node, the one
    whose buckets hold most nodes: in a group of edited copies that is the text they were made from."""
    banded = materialize(nodes.select("k", "n", F.explode("bands").alias("band")).where("band != 0"))
    held = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    banded = banded.join(held, "band")
    central = banded.groupBy("k").agg(F.sum("c").alias("w"))
    banded = materialize(banded.join(central, "k").select("band", "k", "n", "w"))
    hubs = banded.groupBy("band").agg(F.max(F.struct("w", "k", "n")).alias("hub")).select("band", F.col("hub.k").alias("y"), F.col("hub.n").alias("ny"), F.col("hub.w").alias("wy"))
    near = banded.join(hubs, "band").where("k != y")
    votes = near.groupBy("k", "y", "wy").agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy("k").agg(F.max(F.struct("v", "wy", "y")).alias("best")).select(F.col("k").alias("x"), F.col("best.y").alias("y"))


def _prefix_sizes(size: np.ndarray, percent: int) -> np.ndarray:
    return np.where(size > 0, size - -(-percent * size // 100) + 1, 0)


def frequent(docs: DataFrame, n: int, percent: int, n_buckets: int) -> np.ndarray:
    """Hashes of frequent n-grams, counted over the first (by hash) n-grams of each document, a quarter more than a prefix."""
    shift = U(64 - n_buckets.bit_length() + 1)

    def emit(parts):
        t, c = np.unique(np.concatenate(parts), return_counts=True)
        b = (t >> shift).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        bounds = np.append(edge, len(b))
        return pa.RecordBatch.from_arrays([pa.array(b[edge].astype(np.int32)), packed(t, bounds), packed(np.minimum(c, 255).astype(np.uint8), bounds)], ["bucket", "tokens", "counts"])

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for c in chunks(batch.column(2)):
                tokens, doc, size = sets(c, n)
                rank = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
                t = tokens[rank < np.repeat(_prefix_sizes(size, percent) * 5 // 4, size)]
                if len(t):
                    parts.append(t)
                    held += len(t)
            if held >= HOLD:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    def total(batches):
        for _, pieces in _by_bucket(batches):
            t = np.concatenate([unpacked(p.column("tokens"), np.uint64)[0] for p in pieces])
            c = np.concatenate([unpacked(p.column("counts"), np.uint8)[0] for p in pieces]).astype(np.int64)
            o = np.argsort(t)
            t, c = t[o], c[o]
            edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            s = np.add.reduceat(c, edge)
            hot = s > HOT
            yield pa.RecordBatch.from_arrays([pa.array(t[edge][hot].view(np.int64)), pa.array(s[hot])], ["token", "df"])

    sent = docs.mapInArrow(count, "bucket int, tokens binary, counts binary").repartition("bucket").sortWithinPartitions("bucket")
    hot = materialize(sent.mapInArrow(total, "token long, df long"))
    steps = sorted(((r["e"], r["c"]) for r in hot.groupBy(F.floor(F.log2("df")).alias("e")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    least, room = 1 << 62, MAX_HOT
    for e, c in steps:  # from the most frequent down, as long as they fit
        if c > room:
            break
        least, room = 1 << e, room - c
    return np.sort(np.array([r[0] for r in hot.where(F.col("df") >= least).select("token").collect()], np.int64).view(np.uint64))


_ROW = "kind int, x long, y long, label long"


def mixed_lists(docs: DataFrame, hot: np.ndarray, n: int, percent: int, n_buckets: int) -> DataFrame:
    """One pass over the blocks. Rows of kind 2: nodes x that share a list with a node of another label; of kind 1:
    a posting (n-gram x, node y, label) of a frequent n-gram. ``docs``: doc_id, t, text, label (null: own key)."""
    shift = U(64 - n_buckets.bit_length() + 1)
    told = docs.sparkSession.sparkContext.broadcast(hot)
    names = ["bucket", "tokens", "nodes", "labels"]

    def rows(b, t, k, lab):
        o = np.argsort(b, kind="stable")
        b, t, k = b[o], t[o], k[o]
        edge = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        bounds = np.append(edge, len(b))
        own = packed(lab[o], bounds) if lab is not None else pa.array([b""] * len(edge), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(b[edge].astype(np.int32)), packed(t, bounds), packed(k, bounds), own], names)

    def emit(parts):
        t, k, lab, is_hot = (np.concatenate(x) for x in zip(*parts))
        b = (t >> shift).astype(np.int64)
        b[is_hot] = n_buckets + (mix(k[is_hot].view(np.uint64)) >> shift).astype(np.int64)
        plain = lab == k  # most nodes: their label is not sent
        if plain.any():
            yield rows(b[plain], t[plain], k[plain], None)
        if not plain.all():
            yield rows(b[~plain], t[~plain], k[~plain], lab[~plain])

    def postings(batches):
        parts, held = [], 0
        for key, _, label, tokens, doc, hits in _prefixes(batches, told.value, n, percent):
            parts.append((tokens, key[doc], label[doc], hits))
            held += len(doc)
            if held >= HOLD:
                yield from emit(parts)
                parts, held = [], 0
        if parts:
            yield from emit(parts)

    def open_(pieces):
        out = []
        for p in pieces:
            t, _ = unpacked(p.column("tokens"), np.uint64)
            k, kb = unpacked(p.column("nodes"), np.int64)
            lab, lb = unpacked(p.column("labels"), np.int64)
            if len(lab) != len(k):  # rows without labels among rows with them
                full = k.copy()
                full[np.repeat(np.diff(lb) > 0, np.diff(kb))] = lab
                lab = full
            out.append((t, k, lab))
        return [np.concatenate(x) for x in zip(*out)]

    def row(kind, x, y, lab):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y), pa.array(lab)], ["kind", "x", "y", "label"])

    def block(batches):
        for bucket, pieces in _by_bucket(batches):
            t, k, lab = open_(pieces)
            if bucket >= n_buckets:
                yield row(1, t.view(np.int64), k, lab)
                continue
            o = np.argsort(t)
            t, k, lab = t[o], k[o], lab[o]
            edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            mixed = np.minimum.reduceat(lab, edge) != np.maximum.reduceat(lab, edge)
            x = np.unique(k[np.repeat(mixed, np.diff(np.append(edge, len(t))))])
            yield row(2, x, x, x)

    sent = docs.mapInArrow(postings, "bucket int, tokens binary, nodes binary, labels binary").repartition("bucket").sortWithinPartitions("bucket")
    return materialize(sent.mapInArrow(block, _ROW))


def _prefixes(batches, known: np.ndarray, n: int, percent: int):
    """Per chunk: node keys, sizes, labels of its documents; n-grams, document index and frequency flag of their prefixes."""
    for batch in batches:
        given = batch.column(3)
        has = np.asarray(given.is_valid())
        given = np.asarray(given.fill_null(0))
        for c in chunks(batch.column(2)):
            tokens, doc, size = sets(c, n)
            if not len(tokens):
                continue
            key = set_keys(tokens, size)
            label = np.where(has[c.lo : c.hi], given[c.lo : c.hi], key)
            hits = np.zeros(len(tokens), bool)
            if len(known):
                at = np.searchsorted(known, tokens)
                at[at == len(known)] = 0
                hits = known[at] == tokens
            p = _prefix_sizes(size, percent)
            start = np.cumsum(size) - size
            cold = np.concatenate(([0], np.cumsum(~hits)))
            rank_cold = cold[1:] - np.repeat(cold[start], size)
            n_cold = cold[start + size] - cold[start]
            rank_hot = np.arange(1, len(tokens) + 1) - np.repeat(start, size) - rank_cold
            take = np.where(hits, rank_hot <= np.repeat(p - n_cold, size), rank_cold <= np.repeat(p, size))
            yield key, size, label, tokens[take], doc[take], hits[take]


def prefix_rows(docs: DataFrame, hot: np.ndarray, n: int, percent: int) -> DataFrame:
    """(token, k, n, label) of the prefixes of few documents."""
    told = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for key, size, label, tokens, doc, _ in _prefixes(batches, told.value, n, percent):
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(key[doc]), pa.array(size[doc]), pa.array(label[doc])], ["token", "k", "n", "label"])

    return docs.mapInArrow(run, "token long, k long, n long, label long").distinct()


def _met(lists: DataFrame, keys: list[str], apart: str, allowed: str) -> DataFrame:
    """Pairs of rows of one list that differ in column ``apart``, and in label; ``allowed``: a condition on both, the
    other side's columns with a leading ``o``. Lists in which all are alike are dropped; in the others, only the
    rows outside the most common kind meet all rows, so that a list of one large group costs no pairs of its own."""
    alike = lists.groupBy(*keys).agg(F.min(apart).alias("a"), F.max(apart).alias("b")).where("a != b").select(*keys)
    lists = materialize(lists.join(alike, keys))
    by = lists.groupBy(*keys, apart).agg(F.count(F.lit(1)).alias("v"))
    most = by.groupBy(*keys).agg(F.max(F.struct("v", apart)).alias("m")).select(*keys, F.col(f"m.{apart}").alias("most"))
    lists = lists.join(most, keys)
    few = lists.where(f"{apart} != most").drop("most")
    few = few.select(*keys, *[F.col(c).alias(f"o{c}") for c in few.columns if c not in keys])
    met = few.join(lists, keys).where(f"olabel != label AND o{apart} != {apart} AND ({apart} = most OR ok < k) AND ({allowed})")
    return met.select(F.least("k", "ok").alias("x"), F.greatest("k", "ok").alias("y"), *[F.col(c) for c in met.columns if c not in ("most", "k", "ok", *keys)])


def around(centers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, hub, n, c, a) of nodes with a center: n-grams inside and outside of it; and (token, k) of those outside.

    Any set may serve as center: n-grams outside the hub that many of its nodes have are taken into it."""
    nodes = centers.where("rest IS NOT NULL")
    outside = materialize(nodes.select(F.explode("rest").alias("token"), "hub", "k"))
    usual = outside.groupBy("token", "hub").agg(F.count(F.lit(1)).alias("v")).where(f"v > {USUAL}").select("token", "hub", F.lit(1).alias("u"))
    outside = materialize(outside.join(usual, ["token", "hub"], "left"))
    more = outside.groupBy("k").agg(F.count("u").alias("more"))
    more = nodes.join(more, "k", "left").select("k", "hub", "n", (F.col("c") + F.coalesce("more", F.lit(0))).alias("c"), (F.size("rest") - F.coalesce("more", F.lit(0))).alias("a"))
    return materialize(more), outside.where("u IS NULL").select("token", "k")


def second_links(nodes: DataFrame, centers: DataFrame) -> DataFrame:
    """Each node of another label with the node nearest to its center."""
    best = nodes.groupBy("hub").agg(F.max(F.struct((F.col("c") - F.col("a")).alias("w"), "k")).alias("b")).select("hub", F.col("b.k").alias("y"))
    label = centers.select(F.col("k").alias("y"), F.col("label").alias("ylabel"))
    pairs = nodes.join(best, "hub").join(label, "y").join(centers.select("k", "label"), "k")
    return materialize(pairs.where("k != y AND label != ylabel").select(F.col("k").alias("x"), "y"))


def candidates(rows: DataFrame, centers: DataFrame, nodes: DataFrame, outside: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different label that may be links.

    Nodes of different centers meet by their prefixes; overlap counts are accumulated and held against the bound
    from their sizes. Of two nodes of one center, with ``c`` n-grams of it each, at most ``min(c)`` plus the
    n-grams that they share outside of the center can overlap: they meet by n-grams outside (all of them are
    posted), or, where ``min(c)`` alone may do, by the center."""
    both, sizes = 100 + percent, f"{percent} * (n + on)"
    rows = rows.drop("label").join(centers.select("k", "label", "hub", "c", "s"), "k")
    nodes = materialize(nodes.join(centers.select("k", "label"), "k"))
    outside = outside.join(nodes, "k")
    met = _met(rows, ["token"], "hub", f"{both} * least(s, os) >= {sizes}")
    rest = lambda c: f"(({percent} * {c} + 99) div 100 - 1)"  # noqa: E731  n-grams of a node behind its prefix
    apart = met.groupBy("x", "y").agg(F.first("n").alias("n"), F.first("on").alias("on"), F.count(F.lit(1)).alias("v"))
    apart = apart.where(f"(v + greatest({rest('n')}, {rest('on')})) * {both} >= {sizes}").select("x", "y")
    met = _met(outside, ["token", "hub"], "label", f"{both} * (least(c, oc) + least(a, oa)) >= {sizes}")
    near = met.groupBy("x", "y").agg(F.first("n").alias("n"), F.first("on").alias("on"), F.first("c").alias("c"), F.first("oc").alias("oc"), F.count(F.lit(1)).alias("v"))
    near = near.where(f"{both} * (least(c, oc) + v) >= {sizes}").select("x", "y")
    inner = nodes.where(f"100 * c >= {percent} * n").select("hub", "k", "n", "label", "c")
    inner = _met(inner, ["hub"], "label", f"{both} * least(c, oc) >= {sizes}").select("x", "y")
    return materialize(apart.unionByName(near).unionByName(inner).distinct())


def shared_sizes(docs: DataFrame, n: int) -> DataFrame:
    """(t, s): for each text, how many of its n-grams another of these documents has. Others count for no overlap."""

    def spots(c):
        tokens, _, size = sets(c, n)
        return size, tokens

    def finish(doc, rank):
        edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        return np.diff(np.append(edge, len(doc))).astype(np.uint32), np.arange(len(edge) + 1), doc[edge]

    def sizes(batches):
        for b in batches:
            s, _ = unpacked(b.column(1), np.uint32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.astype(np.int64))], ["t", "s"])

    return repeated_spots(docs.select("text"), spots, finish).mapInArrow(sizes, "t long, s long")


def rivals(own: DataFrame, slim: DataFrame, hot: np.ndarray, n: int, percent: int, n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """Documents that may have a link to another label: they share a list with one, and enough of their n-grams are
    shared at all: (doc_id, t, text, label), and (k, n, s) of them."""
    made = mixed_lists(own, hot, n, percent, n_buckets)
    lists = made.where("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("k"), "label")
    mixed = lists.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("token")
    nodes = made.where("kind = 2").select(F.col("x").alias("k")).unionByName(lists.join(mixed, "token").select("k")).distinct().join(slim, "k")
    docs = _pick(own, materialize(nodes.select("doc_id", "t")))
    enough = materialize(shared_sizes(docs, n).join(slim, "t").where(f"100 * s >= {percent} * n").select("k", "n", "doc_id", "t", "s"))
    return _pick(own, enough), enough.groupBy("k").agg(F.first("n").alias("n"), F.max("s").alias("s"))


def grouped(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, t, n_shingles, label, component_id) per row; t: hash of the text, label: the component (null without n-grams)."""
    n_buckets = buckets_for(docs)
    texts = _texts(bounded(docs))
    sig = signatures(texts, n)
    nodes = materialize(sig.where("n > 0").groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands")).select("k", "r.doc_id", "r.t", "n", "bands"))
    slim = nodes.drop("bands")
    near = materialize(first_links(nodes))
    ends = roots(near)
    first = compared(materialize(near.unionByName(ends.select("x", F.col("root").alias("y"))).distinct()), slim, texts, n, percent, rest=True)
    edges = first.where("ok").select("x", "y")
    labels = components(edges)
    # what the product must know of a document: a copy of its node's document is left out; a label other than its own key
    about = sig.where("n > 0").select("doc_id", "t", "k").join(slim.select("k", F.col("doc_id").alias("d0"), F.col("t").alias("t0")), "k").join(labels.withColumnRenamed("node", "k"), "k", "left")
    about = about.withColumn("copy", ~(F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("t") == F.col("t0"))))
    about = materialize(about.where("copy OR label != k").select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), "copy", "label").distinct())
    about = F.broadcast(about) if about.count() <= BROADCAST_ROWS else about
    own = texts.join(about, texts["doc_id"].eqNullSafe(about["__d"]) & (texts["t"] == about["__t"]), "left").where("copy IS NULL OR NOT copy").select("doc_id", "t", "text", "label")
    hot = frequent(own.select("doc_id", "t", "text"), n, percent, n_buckets)
    docs2, known = rivals(own, slim, hot, n, percent, n_buckets)
    center = first.join(ends.select("x", F.col("root").alias("y")), ["x", "y"]).where("2 * both >= nx").select(F.col("x").alias("k"), F.col("y").alias("hub"), F.col("both").alias("c"), "rest")
    center = known.join(center, "k", "left").join(labels.withColumnRenamed("node", "k"), "k", "left")
    center = materialize(center.select("k", "n", "s", F.coalesce("label", "k").alias("label"), F.coalesce("hub", "k").alias("hub"), F.coalesce("c", "n").alias("c"), "rest"))
    inner, outside = around(center)
    again = compared(second_links(inner, center), slim, texts, n, percent).where("ok").select("x", "y")
    edges = materialize(edges.unionByName(again))
    labels = components(edges)
    center = materialize(center.drop("label").join(labels.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("label", "k")))
    likely = candidates(prefix_rows(docs2, hot, n, percent), center, inner, outside, percent)
    more = compared(likely, slim, texts, n, percent).where("ok").select("x", "y")
    every = edges.unionByName(more)
    labels = components(every) if more.limit(1).count() else labels
    linked = slim.select("k", "doc_id").join(labels.withColumnRenamed("node", "k"), "k", "left").select("k", "doc_id", F.coalesce("label", "k").alias("label"))
    least = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    placed = materialize(linked.join(least, "label").select("k", "label", "component_id"))
    placed = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed
    out = sig.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("k")).alias("k")).join(placed, "k", "left")
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), "label", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def cluster(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs`` (columns doc_id, text)."""
    return grouped(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the smallest id (then text hash), with all columns; rows without n-grams stay."""
    groups = materialize(grouped(docs, n, percent).where("n_shingles > 0").groupBy("label", "doc_id", "t").agg(F.count(F.lit(1)).alias("c")))
    best = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("b"))
    marked = groups.join(best, "label").withColumn("__stays", F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("t") == F.col("b.t")))
    marked = materialize(marked.where("NOT __stays OR c > 1").select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), "__stays"))
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
    keyed = docs.withColumns({"__i": whole_id(), "__x": F.xxhash64(F.col("text").cast("string"))})
    kept = keyed.join(marked, F.col("__i").eqNullSafe(F.col("__d")) & (F.col("__x") == F.col("__t")), "left").where("__stays IS NULL OR __stays")
    once = kept.where("__stays IS NULL")
    again = kept.where("__stays").withColumn("__k", F.row_number().over(W.partitionBy("__i", "__x").orderBy("__i"))).where("__k = 1")
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def op2_ngram_jaccard(spark, sf_dir):
    return cluster(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
