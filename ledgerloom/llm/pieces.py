"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice.

The lattice of a text has an edge for every piece of the vocabulary that matches and, for characters that have no
piece of their own (and for the literal space mark), one edge per byte. Pieces weigh ``1 / (rank + 1)`` when the
model is BPE (its scores are ranks, not log probabilities), else by their scores; ``alpha`` is the inverse
temperature. Forward filtering gives each position the weight of all segmentations of what lies before it; a
segmentation is drawn backward from the end in proportion. The draws are hashes of (row key, unit, step), so a
rerun gives the same pieces.

Where no piece of the vocabulary joins two bytes, the lattice falls apart exactly; these units are mostly words.
All units of a stretch of texts are filtered and sampled at once on arrays, and filtered units are kept in a
cache of bounded size.

Decoding joins the pieces' bytes and drops the one space that encoding puts in front: any text comes back
exactly, control characters and the space mark included.

Null text: null pieces, 0 of them. Empty text: no pieces. Null keys, and keys that are no whole numbers, share one stream. Equal (key, text) rows
get equal pieces. Empty tables give empty results; all columns pass through ``encode`` (``pieces n_pieces``
are replaced).
"""

from __future__ import annotations

import hashlib
import math
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U, hash_spans, mix
from .store import bounded, whole_id

MODEL = "piece_bpe_32k.model"
ALPHA = 0.5
MARK = "▁"
#: Cached units of a worker; bytes of text taken at once.
CACHE, STRETCH = 120_000, 1 << 18


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Lattice:
    """A model's vocabulary on bytes, and a cache of filtered units as arrays.

    Node ``b + j`` stands for the first j bytes of a unit whose nodes start at ``b``; its edges are
    ``first[node]`` to ``first[node + 1]``, the likeliest first.
    """

    def __init__(self, model: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.alpha, self.raw, ids = alpha, [b""] * n, {}
        scores = np.zeros(n)
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            piece = sp.id_to_piece(i)
            scores[i] = sp.get_score(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.raw[i], self.byte[value] = bytes([value]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = piece.replace(MARK, " ").encode()
                ids[self.raw[i]] = i
        own = np.array(sorted(ids.values()))
        self.log = np.full(n, -20.0)
        if np.all(np.mod(scores[own], 1) == 0):  # whole numbers: ranks of merges
            rank = np.empty(len(own))
            rank[np.argsort(-scores[own], kind="stable")] = np.arange(len(own))
            self.log[own] = -np.log(rank + 1) - math.log(math.log(len(own)) + 1)
        else:
            self.log[own] = scores[own]
        self.log *= alpha
        self.ids = ids
        self.joined = np.zeros((256, 256), bool)
        for p in ids:
            v = np.frombuffer(p, np.uint8)
            self.joined[v[:-1], v[1:]] = True
        flat = np.frombuffer(b"".join(ids), np.uint8)
        ends = np.cumsum([len(p) for p in ids])
        h = hash_spans(flat, ends - [len(p) for p in ids], ends)
        o = np.argsort(h)
        self.keys, self.key_ids = h[o], np.array(list(ids.values()))[o]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[h >> U(44)] = True
        self.lengths = sorted({len(p) for p in ids})
        self.size = np.array([len(r) for r in self.raw])
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.reset()

    def reset(self) -> None:
        self.known, self.base = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.first, self.cum, self.prev, self.own = np.zeros(1, np.int32), np.empty(0, np.float32), np.empty(0, np.int32), np.empty(0, np.int32)

    def _matches(self, buf: np.ndarray, unit: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ids of the pieces of one length that lie within a unit."""
        s = np.flatnonzero(unit[length - 1 :] == unit[: len(unit) - length + 1]) if len(unit) >= length else np.empty(0, np.int64)
        if not len(s):
            return s, s
        h = hash_spans(buf, s, s + length) if length > 1 else None
        if h is None:
            h = self._single[buf[s]]
        maybe = np.flatnonzero(self.seen[h >> U(44)])
        s, h = s[maybe], h[maybe]
        i = np.searchsorted(self.keys, h)
        i[i == len(self.keys)] = 0
        hit = self.keys[i] == h
        return s[hit], self.key_ids[i[hit]]

    @property
    def _single(self) -> np.ndarray:
        if not hasattr(self, "_single_"):
            every = np.arange(256, dtype=np.uint8)
            self._single_ = hash_spans(every, np.arange(256), np.arange(256) + 1)
        return self._single_

    def _uncovered(self, buf: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Bytes of characters without a piece of their own."""
        lead = (buf & 0xC0) != 0x80
        need = np.where(buf < 0x80, 1, np.where(buf < 0xE0, 2, np.where(buf < 0xF0, 3, 4)))
        bare = np.ones(len(buf), bool)
        for length in (1, 2, 3, 4):
            s, _ = self._matches(buf, unit, length)
            s = s[lead[s] & (need[s] == length)]
            for k in range(length):
                bare[s + k] = False
        return bare

    def add(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Filters the units ``buf[starts:ends]`` and puts them into the cache."""
        if len(self.known) + len(keys) > CACHE and len(self.known):
            self.reset()
        size = ends - starts
        order = np.argsort(-size, kind="stable")  # units that still go on at a position come first
        keys, starts, size = keys[order], starts[order], size[order]
        flat_at = np.cumsum(size) - size
        flat = buf[np.repeat(starts - flat_at, size) + np.arange(size.sum())]
        unit = np.repeat(np.arange(len(size)), size)
        bare = self._uncovered(flat, unit)
        s = [np.flatnonzero(bare)]
        e, k = [s[0] + 1], [self.byte[flat[s[0]]]]
        for length in self.lengths:
            a, own = self._matches(flat, unit, length)
            s.append(a)
            e.append(a + length)
            k.append(own)
        s, e, k = (np.concatenate(x) for x in (s, e, k))
        o = np.argsort(e, kind="stable")
        s, e, k = s[o], e[o], k[o]
        u = unit[s]
        place = e - flat_at[u]  # bytes of the unit in front of the edge's end
        node_at = np.cumsum(size + 1) - (size + 1)
        forward = np.full(len(flat) + len(size), -np.inf)
        forward[node_at] = 0.0
        src, dst = s - flat_at[u] + node_at[u], place + node_at[u]
        weight = self.log[k].copy()
        by = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by], np.arange(1, (int(size[0]) if len(size) else 0) + 2))
        whole = np.empty(len(by))
        for j in range(len(cuts) - 1):
            i = by[cuts[j] : cuts[j + 1]]
            if not len(i):
                continue
            x = forward[src[i]] + weight[i]
            edge = np.flatnonzero(np.concatenate(([True], dst[i[1:]] != dst[i[:-1]])))
            top = np.maximum.reduceat(x, edge)
            top[top == -np.inf] = 0.0
            runs = np.diff(np.append(edge, len(i)))
            w = np.exp(x - np.repeat(top, runs))
            total = np.add.reduceat(w, edge)
            with np.errstate(divide="ignore"):
                forward[dst[i[edge]]] = np.log(total) + top
            whole[i] = w / np.repeat(np.where(total > 0, total, 1), runs)
        live = whole > 0
        o = np.flatnonzero(live)[np.lexsort((-whole[live], dst[live]))]
        p, dst, src, k = whole[o], dst[o], src[o], k[o]
        nodes = len(forward)
        first = np.searchsorted(dst, np.arange(nodes + 1))
        at = first[:-1][np.diff(first) > 1] + 1  # sums within a node, one edge after the other: the same in any company
        last = first[1:][np.diff(first) > 1]
        while len(at):
            p[at] += p[at - 1]
            at, last = at[at + 1 < last] + 1, last[at + 1 < last]
        shift, edges = len(self.first) - 1, len(self.cum)
        self.first = np.concatenate((self.first, (first[1:] + edges).astype(np.int32)))
        self.cum, self.own = np.concatenate((self.cum, p.astype(np.float32))), np.concatenate((self.own, k.astype(np.int32)))
        self.prev = np.concatenate((self.prev, (src + shift).astype(np.int32)))
        known, base = np.concatenate((self.known, keys)), np.concatenate((self.base, node_at + shift))
        o = np.argsort(known)
        self.known, self.base = known[o], base[o]

    def encode(self, texts: list[bytes], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces of the texts, and the bounds of each text's own."""
        buf = np.frombuffer(b"".join(b" " + t if t else b"" for t in texts), np.uint8)
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        offs = np.concatenate(([0], np.cumsum(size)))
        if not len(buf):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cut = np.ones(len(buf), bool)
        cut[1:] = ~self.joined[buf[:-1], buf[1:]]
        cut[offs[:-1][size > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        h = hash_spans(buf, starts, ends)
        keys, at, inv = np.unique(h, return_index=True, return_inverse=True)
        i = np.searchsorted(self.known, keys)
        i[i == len(self.known)] = 0
        new = np.ones(len(keys), bool) if not len(self.known) else self.known[i] != keys
        if new.any():
            before = len(self.known)
            self.add(keys[new], buf, starts[at[new]], ends[at[new]])
            if len(self.known) != before + int(new.sum()):  # the cache was emptied
                rest = keys[~new]
                if len(rest):
                    self.add(rest, buf, starts[at[~new]], ends[at[~new]])
                i = np.searchsorted(self.known, keys)
                if (self.known[np.minimum(i, len(self.known) - 1)] != keys).any():
                    self.reset()
                    self.add(keys, buf, starts[at], ends[at])
        base = self.base[np.searchsorted(self.known, keys)][inv]
        doc = np.searchsorted(offs, starts, side="right") - 1
        stream = mix(seeds[doc] ^ mix((starts - offs[doc]).astype(np.uint64) + U(1)))
        node, live = base + (ends - starts), np.arange(len(starts), dtype=np.int32)
        steps, counts = [], np.zeros(len(starts), np.int64)
        step = 0
        while len(live):
            step += 1
            draw = (mix(stream[live] + U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(11)).astype(np.float64) * 2.0**-53
            e, last = self.first[node], self.first[node + 1] - 1
            more = np.flatnonzero((e < last) & (draw >= self.cum[e]))
            while len(more):
                e[more] += 1
                more = more[(e[more] < last[more]) & (draw[more] >= self.cum[e[more]])]
            steps.append((live, self.own[e]))
            counts[live] += 1
            node = self.prev[e]
            on = node != base[live]
            live, node = live[on], node[on]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(bounds[-1], np.int32)
        for back, (who, own) in enumerate(steps):
            out[bounds[who + 1] - 1 - back] = own
        return out, bounds[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of one text's pieces, without the space in front."""
        n = self.size[ids]
        end = np.cumsum(n)
        return self.bytes[np.repeat(self.at[ids] - (end - n), n) + np.arange(end[-1] if len(end) else 0)].tobytes()[1:]


@lru_cache(maxsize=2)
def lattice(model: str, alpha: float) -> Lattice:
    return Lattice(model, alpha)


def seeds(keys: pa.Array) -> np.ndarray:
    """A stream per row key; nulls share one."""
    v = np.asarray(keys.fill_null(0)).astype(np.int64).view(np.uint64)
    return mix(mix(v + U(1)) ^ np.where(np.asarray(keys.is_valid()), U(0), U(0xA5A5A5A5A5A5A5A5)))


def encoded(own: Lattice, keys: pa.Array, texts: pa.Array):
    """Stretches (from, to, raw texts, pieces, bounds) of a batch."""
    raw, held, lo = [], 0, 0
    stream = seeds(keys)
    for i, t in enumerate(texts):
        raw.append(t.as_py().encode("utf-8") if t.is_valid else b"")
        held += len(raw[-1])
        if held >= STRETCH:
            yield (lo, i + 1, raw, *own.encode(raw, stream[lo : i + 1]))
            raw, held, lo = [], 0, i + 1
    if raw:
        yield (lo, len(texts), raw, *own.encode(raw, stream[lo:]))


@contextmanager
def task(model: str, alpha: float):
    """The worker's lattice for one task; its cached units are let go at the end, as the worker lives on."""
    own = lattice(model, alpha)
    try:
        yield own
    finally:
        own.reset()


def encode(docs: DataFrame, key: str = "doc_id", model: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """Adds ``pieces`` (ids) and ``n_pieces`` to every row. ``model``: path of a model that all executors have."""
    docs = docs.drop("pieces", "n_pieces")
    model = model or default_model()
    names = docs.columns
    at = names.index("text")
    full = docs.withColumn("__key", whole_id(key))

    def run(batches):
        with task(model, alpha) as own:
            yield from encode_all(own, batches)

    def encode_all(own, batches):
        for b in batches:
            valid = np.asarray(b.column(at).is_valid())
            for lo, hi, _, ids, bounds in encoded(own, b.column(b.num_columns - 1), b.column(at)):
                offs = pa.array(bounds.astype(np.int32))
                lists = pa.ListArray.from_arrays(offs, pa.array(ids), mask=pa.array(~valid[lo:hi]))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:-1]), lists, pa.array(np.diff(bounds))], [*names, "pieces", "n_pieces"])

    return bounded(full).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())]))


def decode(df: DataFrame, pieces: str = "pieces", to: str = "decoded", model: str | None = None) -> DataFrame:
    """Adds the text of a column of ids (null: null; ids outside the vocabulary: an error)."""
    model = model or default_model()
    df = df.drop(to)
    names = df.columns
    at = names.index(pieces)

    def run(batches):
        own = lattice(model, ALPHA)
        for b in batches:
            texts = [own.decode(np.array(x, np.int64)).decode("utf-8") if x is not None else None for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, to])

    return bounded(df).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.StringType())]))


_DIGEST = "doc_id long, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean"


def digest(docs: DataFrame, model: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """For each document its pieces and what they decode to, as digests."""
    model = model or default_model()

    def run(batches):
        with task(model, alpha) as own:
            yield from digest_all(own, batches)

    def digest_all(own, batches):
        for b in batches:
            keys = b.column(0)
            for lo, hi, raw, ids, bounds in encoded(own, keys, b.column(1)):
                rows = []
                for i in range(hi - lo):
                    mine = ids[bounds[i] : bounds[i + 1]]
                    back = own.decode(mine)
                    rows.append((len(mine), hashlib.sha256(mine.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == raw[i]))
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(cols, kinds))], [x.split()[0] for x in _DIGEST.split(", ")])

    return bounded(docs).select(whole_id(), F.col("text").cast("string")).mapInArrow(run, _DIGEST)


def op4_sentencepiece(spark, sf_dir):
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
