"""Suffix-array dedup on sparse suffixes.

Words are hashed; of each ``SPREAD`` neighbouring ``K``-word grams the one with the smallest hash is kept (a
minimiser), so any passage of ``SPREAD + K - 1`` words or more has the same kept positions wherever it stands.
Suffixes are kept at these positions only, and of them those whose first ``K`` words occur elsewhere, too. They
are sorted over the cluster, neighbours are compared, and each match is extended to the right and to the left, at
most ``REACH`` words and ``K`` more each way: a longer passage is covered by the matches of its further minimisers.
Matches of ``MIN_WORDS`` words or more are repeats.

One order isn't enough: the neighbour that agrees longest to the right may agree little to the left. So suffixes are
sorted three times, and only neighbours are ever compared (ranges are drawn from a sample and cut within equal suffixes,
too, so a hot suffix is no task of its own; the ends of ranges are compared in a step of their own):

* by the words ahead: a suffix's longest agreement to the right, R; without R + words in front >= ``MIN_WORDS`` it goes;
* by the words behind, read backward: its longest agreement to the left, L; without L + R >= ``MIN_WORDS`` it goes;
* where these two are not both repeats, and a pair could reach further to the left than the first and further to the right
  than the second, by (r words ahead, words behind) for each such length r: the neighbour there has the longest agreement to the left among all
  that agree in r words ahead, which covers every pair of exactly r. Rows of an anchor take part at the lengths between
  these two neighbours only. Suffixes with equal words on both sides cover each other in the first order and go on as one.

So every window of ``MIN_WORDS`` words that occurs twice is covered, at a cost that follows the number of suffixes, not
of pairs. The third sort holds a suffix once for each length that is open, at most ``MIN_WORDS - K + 1`` times.
Equal texts have equal spans; they are joined by a hash of the text.

Null and empty texts, and texts below ``MIN_WORDS`` words: no repeats. Repeated rows are repeats of each
other. Empty tables give empty results; all columns pass through ``mark`` (``n_words n_repeated repeats``
are replaced).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import chunks, inside, mix, packed, unpacked, window_hashes
from .store import materialize, small
from .substrings import repeated_spots, with_spans

MIN_WORDS, K, SPREAD, REACH = 50, 8, 32, 50


def minimisers(c, k: int = K, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """Words at which kept grams start, and the grams' hashes."""
    h = c.hashes()
    grams = inside(c, k)
    if len(grams) < spread:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = window_hashes(h, k)
    order = mix(g)
    full = inside(c, k + spread - 1)  # starts of whole windows of grams
    if not len(full):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = order.copy()
    span = 1
    while span < spread:  # smallest of each `spread` grams, by doubling
        step = min(span, spread - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    best = np.zeros(len(order), np.uint64)
    best[full] = low[full]
    high = best.copy()  # largest of the minima of the windows that a gram lies in
    span = 1
    while span < spread:
        step = min(span, spread - span)
        high[step:] = np.maximum(high[step:], high[:-step].copy())
        span += step
    at = grams[(high[grams] == order[grams])]
    return at, g[at]


def _spread(words: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate(([0], np.cumsum(size)))
    i = np.repeat(begin - step * bounds[:-1], size) + step * np.arange(bounds[-1])
    return words[i], bounds


def _matrix(cells) -> tuple[np.ndarray, np.ndarray]:
    values, bounds = unpacked(cells, ">u4")
    size = np.diff(bounds)
    out = np.zeros((len(size), REACH + K), np.uint32)
    out[np.repeat(np.arange(len(size)), size), np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)] = values
    return out, size


def _common(a, na, b, nb) -> np.ndarray:
    eq = (a == b) & (np.arange(a.shape[1]) < np.minimum(na, nb)[:, None])
    return np.where(eq.all(1), a.shape[1], np.argmin(eq, 1))


_SUFFIX = "anchor long, ahead binary, behind binary, text_key long, at int"
_NAMES = ["anchor", "ahead", "behind", "text_key", "at"]


def suffixes(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The kept suffixes: words from the position on, and in front of it backward, as big-endian 32-bit hashes (which sort as bytes)."""

    def run(batches):
        for b in batches:
            keys, ranks = np.asarray(b.column(0).fill_null(0)), b.column(2)
            for c in chunks(b.column(1)):
                mine = ranks.slice(c.lo, c.hi - c.lo)
                r, rb = unpacked(mine, np.uint32)
                if not len(r):
                    continue
                at, h = minimisers(c)
                doc = np.repeat(np.arange(c.hi - c.lo), np.diff(rb))
                pick = np.searchsorted(at, c.first)[doc] + r
                p, anchor = at[pick], h[pick]
                words = (c.hashes() >> np.uint64(32)).astype(">u4")
                ahead, ab = _spread(words, p, np.minimum(REACH + K, c.first[doc + 1] - p), 1)
                behind, bb = _spread(words, p - 1, np.minimum(REACH, p - c.first[doc]), -1)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), packed(ahead, ab), packed(behind, bb), pa.array(keys[c.lo + doc]), pa.array((p - c.first[doc]).astype(np.int32))], _NAMES)

    keyed = with_spans(docs.select(F.xxhash64("text").alias("k"), F.col("text").cast("string")), places)
    return keyed.mapInArrow(run, _SUFFIX)


def _met(batches, by_left: bool):
    """Rows of a sorted stream with ``l`` and ``r``, the words in front and ahead in which they agree with the better neighbour (zeros
    without one of the same anchor and level), ``edge`` for the first and the last row, of which one neighbour is elsewhere, and
    ``twin`` for a row whose words in front and ahead are those of the row before."""

    def paired(t):
        anchor, level = np.asarray(t.column("anchor")), np.asarray(t.column("level"))
        left, right = np.zeros(max(0, len(anchor) - 1), np.int32), np.zeros(max(0, len(anchor) - 1), np.int32)
        twin = np.zeros(len(left), bool)
        i = np.flatnonzero((anchor[1:] == anchor[:-1]) & (level[1:] == level[:-1]))
        if len(i):
            a, na = _matrix(t.column("ahead"))
            z, nz = _matrix(t.column("behind"))
            right[i], left[i] = _common(a[i], na[i], a[i + 1], na[i + 1]), _common(z[i], nz[i], z[i + 1], nz[i + 1])
            twin[i] = (right[i] == na[i]) & (na[i] == na[i + 1]) & (left[i] == nz[i]) & (nz[i] == nz[i + 1])
            apart = right < level[:-1]
            left[apart], right[apart] = 0, 0
        return left, right, twin

    def done(t, lo: int, hi: int, first: bool, last: bool):
        left, right, twin = (np.concatenate(([0], x, [0])).astype(np.int32) for x in paired(t))
        score = left * 64 + right if by_left else right * 64 + left
        after = score[1:] > score[:-1]
        l, r = (np.where(after, x[1:], x[:-1])[lo:hi] for x in (left, right))
        edge = np.zeros(hi - lo, bool)
        if hi > lo:
            edge[0] |= first
            edge[-1] |= last
        part = t.slice(lo, hi - lo)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(l), pa.array(r), pa.array(edge), pa.array(twin[lo:hi] > 0)], [*part.schema.names, "l", "r", "edge", "twin"])

    held, given = None, 0  # the last rows seen, and how many of them were given out
    for b in batches:
        if not b.num_rows:
            continue
        t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if t.num_rows - 1 > given:
            yield done(t, given, t.num_rows - 1, not given, False)
            given = 1
            held = t.slice(t.num_rows - 2)
        else:
            held = t
    if held is not None:
        yield done(held, given, held.num_rows, not given, True)


def _neighbours(df: DataFrame, by_left: bool, *order: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with what each row has in common with its better neighbour in ``order``; the ends of all ranges among themselves."""
    schema = T.StructType([*df.schema.fields, T.StructField("l", T.IntegerType()), T.StructField("r", T.IntegerType()), T.StructField("edge", T.BooleanType()), T.StructField("twin", T.BooleanType())])

    def compare(batches):
        yield from _met(batches, by_left)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(compare, schema))
    ends = met.where("edge").drop("l", "r", "edge", "twin").coalesce(1).sortWithinPartitions(*order)  # two rows a range
    return met, ends.mapInArrow(compare, schema)


def _spans(df: DataFrame, l: str = "l", r: str = "r") -> DataFrame:
    return df.where(F.col(l) + F.col(r) >= MIN_WORDS).select("text_key", (F.col("at") - F.col(l)).alias("start"), (F.col("at") + F.col(r)).alias("end"))


def matches(kept: DataFrame) -> DataFrame:
    """(text_key, start, end) of suffixes that agree with another in ``MIN_WORDS`` words or more around their anchor."""
    words, most = F.length("behind") / 4, REACH + K
    ahead, ends_a = _neighbours(kept.withColumn("level", F.lit(0)), False, "anchor", "ahead", "behind", "text_key", "at")
    ahead = ahead.where(F.col("edge") | (F.col("r") + words >= MIN_WORDS)).withColumnsRenamed({"l": "la", "r": "ra", "edge": "ea"})
    once = ahead.where("NOT twin").drop("twin")  # a twin has all that it can have in common with any other
    both, ends_b = _neighbours(once, True, "anchor", "behind", "ahead", "text_key", "at")
    # bounds of what any other suffix has in common; at the end of a range the other neighbour isn't known
    both = both.withColumns({"most_r": F.when(F.col("ea"), F.lit(most)).otherwise(F.col("ra")), "most_l": F.when(F.col("edge"), F.lit(REACH)).otherwise(F.greatest("l", "la"))}).where(F.col("most_l") + F.col("most_r") >= MIN_WORDS)
    both = both.withColumns({"lo": F.greatest(F.lit(K), MIN_WORDS - F.col("most_l")), "hi": F.least(F.lit(MIN_WORDS), "most_r")})
    both = both.withColumn("open_lo", F.greatest("lo", F.when(F.col("edge"), F.lit(0)).otherwise(F.col("r") + 1)))
    # two repeats, one as far to the right as any and one as far to the left as any, leave nothing to cover
    whole = ~F.col("ea") & ~F.col("edge") & (F.col("la") + F.col("ra") >= MIN_WORDS) & (F.col("l") + F.col("r") >= MIN_WORDS)
    open_ = both.where((F.col("open_lo") <= F.col("hi")) & (F.col("ea") | (F.col("la") < F.col("most_l"))) & ~whole)
    open_ = materialize(open_.groupBy("anchor").agg(F.min("open_lo").alias("from"), F.max("hi").alias("to")))
    again = both.drop("level").join(small(open_), "anchor").withColumns({"lo": F.greatest("lo", "from"), "hi": F.least("hi", "to")}).where("lo <= hi")
    again = again.select("*", F.explode(F.sequence("lo", "hi")).alias("level")).where(F.length("ahead") >= 4 * F.col("level"))
    again = again.select("anchor", "level", F.expr("substring(ahead, 1, 4 * level)").alias("head"), "ahead", "behind", "text_key", "at")
    levels, ends_c = _neighbours(again, True, "anchor", "level", "head", "behind", "text_key", "at")
    parts = [_spans(ahead, "la", "ra"), *map(_spans, (both, levels, ends_a, ends_b, ends_c))]
    return reduce(DataFrame.unionByName, parts).distinct()


def _places(docs: DataFrame) -> DataFrame:
    """(text_key, intervals): the ranks of the minimisers of a text that occur elsewhere, too."""

    def finish(doc, rank):
        edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        return rank.astype(np.uint32), np.append(edge, len(doc)), doc[edge]

    def spots(c):
        at, h = minimisers(c)
        return np.diff(np.searchsorted(at, c.first)), h

    return repeated_spots(docs, spots, finish)


def repeats(docs: DataFrame) -> DataFrame:
    """(text_key, intervals): for each text with repeats, packed uint32 pairs [first word, end word)."""
    kept = suffixes(docs, _places(docs))
    spans = matches(kept).groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))

    def merged(batches):
        for b in batches:
            cells = []
            for s in b.column(1).to_pylist():
                out: list[list[int]] = []
                for x in s:
                    if out and x["start"] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], x["end"])
                    else:
                        out.append([x["start"], x["end"]])
                cells.append(np.array(out, np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.binary())], ["text_key", "intervals"])

    return materialize(spans.mapInArrow(merged, "text_key long, intervals binary"))


def mark(docs: DataFrame) -> DataFrame:
    """All rows and columns with n_words, n_repeated and repeats (word intervals)."""
    docs = docs.drop("n_words", "n_repeated", "repeats")
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            spans = [np.frombuffer(x or b"", np.uint32).reshape(-1, 2) for x in b.column(b.num_columns - 1).to_pylist()]
            n = np.concatenate([c.counts() for c in chunks(b.column(at))]) if b.num_rows else np.empty(0, np.int64)
            out = [pa.array(n), pa.array([int((x[:, 1] - x[:, 0]).sum()) for x in spans], pa.int64()), pa.array([x.tolist() for x in spans], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], [*names, "n_words", "n_repeated", "repeats"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_repeated", T.LongType()), T.StructField("repeats", T.ArrayType(T.ArrayType(T.LongType())))])
    return with_spans(docs, repeats(docs)).mapInArrow(run, schema)


def op7_suffix_array(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mark(docs).select("doc_id", "n_words", "n_repeated", "repeats")
