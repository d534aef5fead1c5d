"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source has a target of words: its share of ``budget`` by weight, but at most ``max_copies`` times its
size, the excess being shared again by weight until no source is above (a water level found on the sorted
ratios of limit and weight). A document's expected copies are target / source size. Within a source the
documents are ranked by (size, doc_id), so the expected copies summed up to a document are rank x rate; one
offset per source, drawn from a hash of its name, is added, and a document is emitted once for each integer
that the sum crosses. Ranking by size spreads the copies over all sizes, which keeps the words close to the
target.

Ranks need no task per source: rows are grouped into (source, size level, salt) with at most about
``group_rows`` rows each (salts are hashes of id and size, so only rows that repeat both share one); group counts are summed over levels, then over salts, and rows are numbered inside
their group only.

Null text: size 0. Null source: a source of its own, last in order. Sources of size 0 have target 0. Equal rows
share their copies in any order (equal rows, so the result is the same); rows with a null doc_id come first.
Empty input: empty result. Other columns pass through; ``size source_size target copies taken`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
GROUP_ROWS = 250


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the source's name."""
    name = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _level(size: Column) -> Column:
    return F.floor(F.log2(size + F.lit(1)) * F.lit(32) + F.lit(1e-9)).cast("int")


def _salt(salts: Column) -> Column:
    """A group of a row's level by a hash of its id and size: even for repeated, null and strided ids alike."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("size").cast("string"))), 1, 8), 16, 10).cast("long"), salts)


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, max_copies: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size): a row per source, so a table of the number of sources."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = by.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (((rank - 1) % len(weights)) + 1).cast("int")).cast("double"))
    w = w.withColumn("__cap", (F.col("source_size") * max_copies).cast("double"))
    order = W.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.withColumns({
        "__level": (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        / F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    # sources up to the first whose own limit is above the level are at their limit; the others share that level
    w = w.withColumn("__open", F.col("__level") * F.col("__w") <= F.col("__cap"))
    level = F.min(F.when(F.col("__open"), F.struct(F.col("__cap") / F.col("__w"), F.col("source").isNull(), "source", F.col("__level").alias("l")))).over(everything)["l"]
    return w.withColumn("__l", level).select("source", "source_size", F.least(F.coalesce(F.col("__l") * F.col("__w"), F.col("__cap")), F.col("__cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, max_copies: int = 2, group_rows: int = GROUP_ROWS, size: Column | None = None) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies and taken (= copies x size)."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = docs.withColumn("size", words(F.col("text")) if size is None else size).withColumn("__level", _level(F.col("size")))
    levels = materialize(sized.groupBy("source", "__level").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    goal = targets(levels.select("source", "size"), weights, budget, max_copies)
    # (source, level) -> rows before it in the source, and how many salts its rows are dealt to
    plan = levels.select("source", "__level", (F.floor((F.col("n") - 1) / group_rows) + 1).alias("__salts"), F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("__level").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    plan = materialize(_same(plan, goal, ["source"]))
    rows = _same(sized, F.broadcast(plan) if plan.count() <= 100_000 else plan, ["source", "__level"])
    rows = rows.withColumn("__salt", _salt(F.col("__salts")))
    crowded = W.partitionBy("source", "__level").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    counts = _same(sized.select("source", "__level", "doc_id", "size"), F.broadcast(plan) if plan.count() <= 100_000 else plan, ["source", "__level"])
    counts = counts.withColumn("__salt", _salt(F.col("__salts"))).groupBy("source", "__level", "__salt").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("source", "__level", "__salt", F.coalesce(F.sum("n").over(crowded), F.lit(0)).alias("__start"))
    rows = _same(rows, starts, ["source", "__level", "__salt"])
    inside = W.partitionBy("source", "__level", "__salt").orderBy("size", F.col("doc_id").asc_nulls_first())
    rank = F.col("__before") + F.col("__start") + F.row_number().over(inside)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"__rank": rank, "__rate": rate, "__u": offset(F.col("source"))})
    crossed = lambda k: F.floor(k * F.col("__rate") + F.col("__u"))
    rows = rows.withColumn("copies", (crossed(F.col("__rank")) - crossed(F.col("__rank") - 1)).cast("long"))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select(*docs.columns, "size", "source_size", "target", "copies", "taken")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys are equal; the left's columns stay."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        cond = left[k].eqNullSafe(renamed[f"__r_{k}"])
        on = cond if on is None else on & cond
    return left.join(renamed, on).drop(*[f"__r_{k}" for k in keys])


def op3_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("n_words")))
    return mix(sized, size=F.col("n_words")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sized AS (SELECT *, floor(log2(size + 1) * 32 + 1e-9)::INT AS lvl FROM docs),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap FROM sources),
leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM weighed),
water AS (SELECT arg_min(l, cap / w) AS l FROM leveled WHERE l * w <= cap),
goal AS (SELECT source, source_size, least(coalesce(water.l * w, cap), cap) AS target,
         ('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
         FROM leveled, water),
salts AS (SELECT source, lvl, (count(*) - 1) // 250 + 1 AS salts FROM sized GROUP BY source, lvl),
ranked AS (
  SELECT s.doc_id, s.source, s.size,
         row_number() OVER (PARTITION BY s.source ORDER BY s.lvl, ('0x' || substr(md5(concat_ws('|', s.doc_id::VARCHAR, s.size::VARCHAR)), 1, 8))::BIGINT % t.salts, s.size, s.doc_id NULLS FIRST) AS k
  FROM sized s JOIN salts t ON s.source IS NOT DISTINCT FROM t.source AND s.lvl = t.lvl),
rated AS (SELECT k.*, g.source_size, g.target, g.u, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
          FROM ranked k JOIN goal g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ((floor(k * rate + u) - floor((k - 1) * rate + u)) * size)::BIGINT AS taken FROM rated"""
