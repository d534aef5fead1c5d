"""Substring dedup: Rabin-Karp hashes of every window of ``w`` words, counted in Spark; repeated windows merge
into maximal removal intervals.

A document is known by a 64-bit hash of its text, so equal rows, null ids and repeated ids need no care: equal
texts have equal intervals, and two copies count as two occurrences of each window. Windows travel packed:
one row holds all windows of a stretch of input that fall into one hash bucket, as arrays. A bucket holds a
bounded share of all windows; of a window that one stretch has many times, two occurrences go to its bucket
(which is what other stretches need to know), the rest is already known to be repeated and is dealt by document.
Buckets find the repeated hashes; their places go, packed, to buckets of documents, where neighbouring windows
merge into intervals of words. Texts are never shuffled unless the intervals are too many to broadcast.

``digest`` reads ids as whole numbers (others: null). Null and empty texts and texts below ``w`` words: nothing removed. Windows are judged on the input, not on what
is left. Empty tables give empty results; the other columns of ``docs`` pass through ``dedup``
(``n_words n_removed kept intervals`` of the input are replaced).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U, chunks, inside, packed, unpacked, window_hashes
from .store import BROADCAST_ROWS, bounded, materialize, whole_id

WINDOW = 35
#: Windows of one bucket, and the bound on buckets; windows held by a task before it sends them on.
BUCKET_WINDOWS, MAX_BUCKETS, HOLD = 200_000, 1 << 20, 1_000_000
#: kind 0: the windows of stretch ``src`` in ``bucket`` (hashes, indexes); 1: indexes of repeated windows; 2: its documents (keys, windows of each).
_PACKED = "bucket int, src long, kind int, hashes binary, places binary"
_NAMES = ["bucket", "src", "kind", "hashes", "places"]


def buckets_for(docs: DataFrame) -> int:
    """A power of two that follows the size of the tables read (an estimate: it decides sizes only, never results)."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(min(int(leaves.apply(i).stats().sizeInBytes()), 1 << 50) for i in range(leaves.size()))
    n = 1024
    while n < MAX_BUCKETS and n * BUCKET_WINDOWS < 0.3 * size:
        n *= 2
    return n


def _by_bucket(batches, column: str = "bucket"):
    """(value, slices) for each run of equal values in a column, across batches."""
    now, held = None, []
    for b in batches:
        ids = np.asarray(b.column(column))
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
        for i, j in zip(edges, edges[1:]):
            if ids[i] != now and held:
                yield now, held
                held = []
            now = ids[i]
            held.append(b.slice(i, j - i))
    if held:
        yield now, held


def _row(bucket, src, kind, hashes, hash_bounds, places, place_bounds) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(bucket, np.int32)), pa.array(np.full(n, src, np.int64)), pa.array(np.full(n, kind, np.int32)), packed(hashes, hash_bounds), packed(places.astype(np.uint32), place_bounds)], _NAMES)


def repeated_spots(docs: DataFrame, spots, finish) -> DataFrame:
    """(text_key, intervals) made by ``finish(doc, rank)`` from the spots whose hash occurs elsewhere, too.

    ``spots(chunk)``: (number of spots of each document, hashes in order). ``finish``: takes the document and the
    rank among the spots of its document of each repeated spot, in order; gives values (uint32), the bounds of the
    cells and the document of each cell.
    """
    n_buckets = buckets_for(docs)
    shift = U(64 - n_buckets.bit_length() + 1)
    hold = min(max(HOLD, 8 * n_buckets), 8 * HOLD)

    def emit(parts, src):
        h, keys, counts = (np.concatenate(x) for x in zip(*parts))
        home = int((np.array([src]).astype(np.uint64) * U(0x9E3779B97F4A7C15))[0] >> shift)
        yield _row([n_buckets + home], src, 2, keys, [0, len(keys)], counts, [0, len(counts)])
        order = np.argsort(h, kind="stable")
        s = h[order]
        third = np.zeros(len(h), bool)
        if len(h) > 2:
            third[order[2:]] = s[2:] == s[:-2]
        at = np.flatnonzero(~third)
        b = (h[at] >> shift).astype(np.uint32)
        at = at[np.argsort(b, kind="stable")]
        b = (h[at] >> shift).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        bounds = np.append(edge, len(b))
        yield _row(b[edge], src, 0, h[at], bounds, at, bounds)
        at = np.flatnonzero(third)
        if len(at):
            yield _row([n_buckets + home], src, 1, np.empty(0, np.uint64), [0, 0], at, [0, len(at)])

    def windows(batches):
        from pyspark import TaskContext

        src, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            keys = np.asarray(batch.column(0).fill_null(0))
            for c in chunks(batch.column(1)):
                counts, hashes = spots(c)
                if not len(hashes):
                    continue
                has = np.flatnonzero(counts)
                parts.append((hashes, keys[c.lo + has], counts[has]))
                held += len(hashes)
                if held >= hold:
                    yield from emit(parts, src)
                    src, parts, held = src + 1, [], 0
        if parts:
            yield from emit(parts, src)

    def repeated(batches):
        for bucket, pieces in _by_bucket(batches):
            if bucket >= n_buckets:
                yield from pieces
                continue
            piece = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
            h, bounds = unpacked(piece.column("hashes"), np.uint64)
            place, _ = unpacked(piece.column("places"), np.uint32)
            order = np.argsort(h)
            s = h[order]
            same = np.zeros(len(s) + 1, bool)
            same[1:-1] = s[1:] == s[:-1]
            hit = np.zeros(len(h), bool)
            hit[order[same[1:] | same[:-1]]] = True
            n = np.concatenate(([0], np.cumsum(hit)))[bounds]
            out = pa.RecordBatch.from_arrays([piece.column("bucket"), piece.column("src"), pa.array(np.ones(len(piece), np.int32)), packed(np.empty(0, np.uint64), np.zeros(len(piece) + 1, np.int64)), packed(place[hit], n)], _NAMES)
            yield out.filter(pa.array(np.diff(n) > 0))

    def merged(batches):
        for _, pieces in _by_bucket(batches, "src"):
            piece = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
            kind = np.asarray(piece.column("kind"))
            about = piece.filter(pa.array(kind == 2))
            keys, _ = unpacked(about.column("hashes"), np.int64)
            counts, _ = unpacked(about.column("places"), np.uint32)
            place = np.sort(unpacked(piece.filter(pa.array(kind == 1)).column("places"), np.uint32)[0]).astype(np.int64)
            if not len(place):
                continue
            ends = np.cumsum(counts.astype(np.int64))
            doc = np.searchsorted(ends, place, side="right")
            values, bounds, cells = finish(doc, place - (ends - counts)[doc])
            yield pa.RecordBatch.from_arrays([pa.array(keys[cells]), packed(values, bounds)], ["text_key", "intervals"])

    keyed = bounded(docs).select(F.xxhash64("text").alias("k"), F.col("text").cast("string"))
    sent = keyed.mapInArrow(windows, _PACKED).repartition("bucket").sortWithinPartitions("bucket")
    found = sent.mapInArrow(repeated, _PACKED).repartition("src").sortWithinPartitions("src")
    return materialize(found.mapInArrow(merged, "text_key long, intervals binary").groupBy("text_key").agg(F.first("intervals").alias("intervals")))


def intervals(docs: DataFrame, w: int = WINDOW) -> DataFrame:
    """(text_key, intervals): for each text with repeated windows, packed uint32 pairs [first word, end word)."""

    def spots(c):
        at = inside(c, w)
        return np.maximum(0, c.counts() - w + 1), window_hashes(c.hashes(), w)[at] if len(at) else at

    def finish(doc, p):
        start = np.concatenate(([True], (doc[1:] != doc[:-1]) | (p[1:] > p[:-1] + w)))
        end = np.append(start[1:], True)
        d = doc[start]
        edge = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        return np.stack((p[start], p[end] + w), 1).astype(np.uint32).ravel(), np.append(edge, len(d)) * 2, d[edge]

    return repeated_spots(docs, spots, finish)


_OUT = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()), ("intervals", T.ArrayType(T.ArrayType(T.LongType())))]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with column ``__spans`` last; the spans are broadcast when counted to be small, else both sides shuffle."""
    size = spans.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("intervals")).alias("b")).first()
    if size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= 64 << 20:
        spans = F.broadcast(spans)
    spans = spans.select(F.col("text_key").alias("__k"), F.col("intervals").alias("__spans"))
    return docs.withColumn("__key", F.xxhash64("text")).join(spans, F.col("__key") == F.col("__k"), "left").drop("__key", "__k")


def cut(raw: bytes, spans: np.ndarray) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by one space)."""
    words = raw.split()
    n, out, at = len(words), [], 0
    for a, b in spans.reshape(-1, 2).tolist():
        out += words[at:a]
        at = b
    out += words[at:]
    return n, n - len(out), b" ".join(out)


def dedup(docs: DataFrame, w: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_removed, kept (text without repeated windows) and intervals."""
    docs = docs.drop(*[x for x, _ in _OUT])
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for text, spans in zip(b.column(at), b.column(b.num_columns - 1).to_pylist()):
                spans = np.frombuffer(spans or b"", np.uint32)
                n, gone, kept = cut((text.as_py() or "").encode(), spans)
                for x, v in zip(out, (n, gone, kept.decode(), spans.reshape(-1, 2).tolist())):
                    x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v, k) for v, k in zip(out, kinds))], [*names, *(x for x, _ in _OUT)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in _OUT)])
    return with_spans(docs, intervals(docs, w)).mapInArrow(run, schema)


def digest(docs: DataFrame, w: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2).to_pylist()):
                n, gone, kept = cut((text.as_py() or "").encode(), np.frombuffer(spans or b"", np.uint32))
                out.append((n, gone, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select(whole_id(), F.col("text").cast("string"))
    return with_spans(docs, intervals(docs, w)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op8_substring_dedup(spark, sf_dir):
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
spots AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i FROM docs WHERE len(ws) >= 35),
hashed AS (SELECT a.r, a.i, md5(array_to_string(d.ws[a.i : a.i + 34], ' ')) AS h FROM spots a JOIN docs d USING (r)),
hit AS (SELECT r, i FROM hashed WHERE h IN (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT r, list_sort(list_distinct(flatten(list(range(i, i + 35))))) AS g FROM hit GROUP BY r),
dropped AS (SELECT r, unnest(g) AS j FROM gone),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM docs),
kept AS (SELECT w.r, string_agg(w.w, ' ' ORDER BY w.j) AS kept FROM words w ANTI JOIN dropped USING (r, j) GROUP BY w.r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(len(g.g), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN gone g USING (r) LEFT JOIN kept k USING (r)"""
