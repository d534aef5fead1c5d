"""Source divergence audit: how the word counts of each source of a language differ from the other sources' and from the language's.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps the terms that occur in at
least ``min_docs`` of its documents. A group (language, source) gives term t, seen c times in it, the share
p = 1 + floor(SCALE * (c + 1) / (N + V)): N its occurrences of kept terms, V the number of kept terms. A term's
divergence of p from q is f = floor((p - q)^2 / q). All arithmetic is exact.

Tasks count terms of their documents in bounded tables, Spark sums them by (lang, term), and each kept term becomes a
sparse column: its sorted (source, count) pairs. Terms with identical columns are one column with a multiplicity, so
each pair of sources is evaluated once for each distinct column. Of a column only the sources that have the term are
visited: with f0 for two sources without it, the sum over all terms is

    V f0 + sum over columns with the one (f - f0) + with the other (f - f0) + with both (f - f(p, q0) - f(p0, q) + f0)

where the middle parts depend on one source's count only and are summed by distinct count. Ranks of terms are kept by
salted groups first, so that no task ranks a whole vocabulary.

Null text, lang and source read as ''. Empty texts and texts without terms count nowhere, but their group is there.
Repeated rows are documents of their own. Ties in value are ranked by the item's bytes. Long texts are split in pieces of
1 MB between words. Empty tables give an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import CHUNK
from .store import bounded, materialize, small

SCALE = 1_000_000_000
MIN_DOCS, TOP, SALTS = 3, 200, 64
#: Terms that a task counts before it sends them on.
HOLD = 200_000
#: Bytes of UTF-8: letters lower-cased, what separates terms as a blank.
_FOLD = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if c < 0x5B else c for c in range(256))


def pieces(text: bytes, limit: int = CHUNK):
    """Lists of terms; together they are all terms of the text."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = at + limit
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut if cut > at else text.find(b" ", end)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _send(held: dict):
    for (lang, source), (n, docs) in held.items():
        terms = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).view(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
            ["lang", "source", "term", "n", "docs"],
        )


def _count(batches):
    held, size = {}, 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).view(pa.binary()).to_pylist()):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), None
            for words in pieces(text):
                n.update(words)
                seen = set(words) if seen is None else seen.union(words)
            docs.update(seen or ())
            size += len(n) - before
            if size >= HOLD:
                yield from _send(held)
                held, size = {}, 0
    yield from _send(held)


def term_columns(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, column): kept terms, their occurrences in the language, and sorted (source, n)."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = bounded(text).mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    by = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by = by.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("column"))
    return by.where(F.col("docs") >= min_docs).drop("docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), for counts of any size."""
    wide = lambda c, p: c.cast(f"decimal({p},0)")
    return F.lit(1) + F.call_function("div", wide(F.lit(SCALE), 10) * wide(n + 1, 19), wide(total + terms, 20))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _sums(value: Column, times: Column) -> list[Column]:
    """Exact sums of value * times: billions and the rest apart."""
    return [F.sum(F.call_function("div", value, F.lit(SCALE)) * times).alias("hi"), F.sum(value % SCALE * times).alias("lo")]


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(gid, lang, source, size, terms, in_lang, p0) of each group that occurs."""
    there = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("in_lang"))
    own = kept.select("lang", F.inline("column")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    rows = there.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "in_lang"])
    return materialize(rows.withColumns({"gid": F.monotonically_increasing_id(), "p0": F.when(F.col("terms") > 0, share(F.lit(0), F.col("size"), F.col("terms")))}))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    near = small(groups)
    columns = materialize(kept.groupBy("lang", "column").agg(F.count(F.lit(1)).alias("times")).withColumn("cid", F.monotonically_increasing_id()))
    cells = columns.select("lang", "cid", "times", F.inline("column")).join(near.select("lang", "source", "gid", "size", "terms", "p0"), ["lang", "source"])
    cells = materialize(cells.select("lang", "cid", "times", "gid", "p0", share(F.col("n"), F.col("size"), F.col("terms")).alias("p")))
    # both sources have the term
    sets = cells.groupBy("cid", "times").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("set")).where(F.size("set") > 1)
    both = sets.select("times", "set", F.explode("set").alias("a")).select("times", "a", F.explode("set").alias("b")).where("a.gid != b.gid")
    a, b, a0, b0 = (F.col(x) for x in ("a.p", "b.p", "a.p0", "b.p0"))
    both = both.groupBy(F.col("a.gid").alias("gid"), F.col("b.gid").alias("other")).agg(*_sums(gap(a, b) - gap(a, b0) - gap(a0, b) + gap(a0, b0), F.col("times")))
    # one source has it: by distinct share, against every other source of the language
    shares = cells.groupBy("lang", "gid", "p0", "p").agg(F.sum("times").alias("times"))
    others = near.select("lang", F.col("gid").alias("other"), F.col("p0").alias("q0"))
    one = shares.join(others, "lang").where("gid != other")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    given = one.groupBy("gid", "other").agg(*_sums(gap(p, q0) - gap(p0, q0), F.col("times")))
    taken = one.groupBy(F.col("other").alias("gid"), F.col("gid").alias("other")).agg(*_sums(gap(q0, p) - gap(q0, p0), F.col("times")))
    # neither has it: all terms, what the others say is the difference
    every = groups.select("lang", "source", "gid", "p0", "terms").join(near.select("lang", F.col("source").alias("item"), F.col("gid").alias("other"), F.col("p0").alias("q0")), "lang").where("gid != other")
    parts = both.unionByName(given).unionByName(taken).groupBy("gid", "other").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,0)")
    value = zero(gap(p0, q0)) * F.col("terms") + zero(F.col("hi")) * SCALE + zero(F.col("lo"))
    return every.join(parts, ["gid", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    rows = kept.select("lang", "term", "total", F.inline("column")).join(small(groups).select("lang", "source", "size", "terms", "in_lang"), ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share(F.col("total"), F.col("in_lang"), F.col("terms")).alias("q"))
    rows = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value"))
    salted = W.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: other sources (``pair``, all) and overused terms (``term``, the first ``top``) by divergence."""
    kept = materialize(term_columns(docs, min_docs))
    groups = _groups(docs, kept)
    rows = _pairs(kept, groups).unionByName(_terms(kept, groups, top))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir):
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3),
vocabulary AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
seen AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sources AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM sources LEFT JOIN seen USING (lang, source) GROUP BY ALL),
shares AS (SELECT lang, t.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
           FROM totals t JOIN kept k USING (lang) JOIN vocabulary USING (lang) LEFT JOIN seen s USING (lang, source, term)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(t.total) + any_value(v)) AS q
          FROM seen JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM totals GROUP BY lang) t USING (lang) JOIN vocabulary USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM rows
QUALIFY part = 'pair' OR rank <= 200"""
