"""Relational patterns that SQL writes with QUALIFY, history windows and hand-made roll-ups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def org_key(column: str = "source_org_id") -> Column:
    return F.coalesce(F.col(column), F.lit("legacy"))


def qualify(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. Catalyst turns the filter into a limit before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def latest(df: DataFrame, extra_keys: list | None = None) -> DataFrame:
    """Latest load of each (organisation, record); ``run_id`` breaks ties."""
    keys = extra_keys or [org_key(), F.col("source_record_id")]
    return qualify(df, keys, [F.col("loaded_at").desc(), F.col("run_id").desc()])


def drop_legacy(df: DataFrame) -> DataFrame:
    """Rows without an organisation go when the same record exists with one; records without an id are never gathered."""
    scoped = df.where("source_org_id IS NOT NULL AND source_record_id IS NOT NULL").select(F.col("source_record_id").alias("__id")).distinct()
    legacy = df.where("source_org_id IS NULL")
    return df.where("source_org_id IS NOT NULL").unionByName(legacy.join(scoped, legacy["source_record_id"] == scoped["__id"], "left_anti"))


def latest_scoped(df: DataFrame) -> DataFrame:
    """``drop_legacy`` of ``latest`` in one shuffle by record and one sort, which both windows share. Records without an id give way to
    nobody: they are ranked apart, where the limit before the shuffle leaves one an organisation and task."""
    known = latest(df.where("source_record_id IS NOT NULL").repartition("source_record_id"), [F.col("source_record_id"), org_key()])
    scoped = F.max(F.col("source_org_id").isNotNull()).over(W.partitionBy("source_record_id"))
    kept = known.withColumn("__scoped", scoped).where("source_org_id IS NOT NULL OR NOT __scoped").drop("__scoped")
    return kept.unionByName(latest(df.where("source_record_id IS NULL")))


def scd2(df: DataFrame, change: Column) -> DataFrame:
    """History of a dimension: loads whose attributes changed, with validity, ascending version and current flag."""
    by = W.partitionBy(org_key(), "source_record_id").orderBy("loaded_at", "run_id")
    back = W.partitionBy(org_key(), "source_record_id").orderBy(F.col("loaded_at").desc(), F.col("run_id").desc())
    hashed = df.withColumn("change_hash", F.sha2(change, 256))
    before = F.lag("change_hash").over(by)
    kept = hashed.withColumn("__changed", before.isNull() | (before != F.col("change_hash"))).where("__changed").drop("__changed")
    return kept.withColumns({
        "valid_from": F.col("loaded_at"),
        "valid_to": F.lead("loaded_at").over(by) - F.expr("INTERVAL 1 MICROSECOND"),
        "version_number": F.row_number().over(by).cast("long"),
        "is_current": F.row_number().over(back) == 1,
    })


def current(history: DataFrame) -> DataFrame:
    return history.where("is_current").drop("valid_from", "valid_to", "version_number", "is_current", "change_hash")


def fact_versions(df: DataFrame) -> DataFrame:
    """All loads of a fact; version 1 is the newest (the reverse of a dimension's numbering)."""
    back = W.partitionBy(org_key(), "source_record_id").orderBy(F.col("loaded_at").desc(), F.col("run_id").desc())
    return df.withColumn("version_number", F.row_number().over(back).cast("long")).withColumn("is_current", F.col("version_number") == 1)


def dedupe_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return qualify(df, keys, order)


def group_first(df: DataFrame, keys: list[str], order: str, ids: dict[str, str], raw: str | None = None) -> DataFrame:
    """Groups (null keys are one group): the first row by ``order``, ``duplicate_count``, distinct ids joined by ``; `` and raw rows by lines."""
    rest = [c for c in df.columns if c not in keys]
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).cast("string").alias("v")))), lambda x: x["v"])
    aggs = [F.min_by(F.struct(*rest), F.col(order)).alias("__first"), F.count(F.lit(1)).alias("duplicate_count")]
    aggs += [F.concat_ws("; ", F.array_distinct(F.filter(ordered(c), lambda x: F.trim(x) != ""))).alias(name) for c, name in ids.items()]
    if raw:
        aggs.append(F.concat_ws("\n", ordered(raw)).alias("raw_group"))
    return df.groupBy(*keys).agg(*aggs).select(*keys, "__first.*", "duplicate_count", *ids.values(), *(["raw_group"] if raw else []))


def roll_up(df: DataFrame, sums: list[str], labels: dict[str, str], by: list[str] = ()) -> DataFrame:
    """``df`` with the rows of all organisations together in front."""
    total = df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums]) if by else df.agg(*[F.sum(c).alias(c) for c in sums])
    for name, value in labels.items():
        total = total.withColumn(name, F.lit(value))
    return total.select(*df.columns).unionByName(df)


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def present(df: DataFrame, name: str, *others: str, kind: str = "string") -> Column:
    """The first of the columns that ``df`` has, else a typed NULL."""
    found = next((x for x in (name, *others) if x in df.columns), None)
    return (F.col(found) if found else F.lit(None)).cast(kind)


def reindex(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Columns under display labels, missing ones as NULL."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(label) for c, label in labels.items()])


#: Spellings of organisation filters (fixed values); anything else is all organisations.
ORGANISATIONS = {"india": "india", "in": "india", "us": "us", "u.s.": "us", "usa": "us", "u.s.a": "us"}


def organisation(name: str | None) -> str:
    return ORGANISATIONS.get((name or "").strip().lower(), "all")


def only(df: DataFrame, column: str, values: list[str] | None) -> DataFrame:
    """Rows whose value is one of these, in any case; no values: all rows."""
    return df if not values else df.where(F.lower(F.trim(column)).isin(*[v.strip().lower() for v in values]))


def where_given(df: DataFrame, **tests: Column | None) -> DataFrame:
    """Filters for the arguments that were given; Catalyst pushes them down."""
    for test in tests.values():
        if test is not None:
            df = df.where(test)
    return df


def search(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows in which the columns, joined, contain the text (no pattern, any case)."""
    if not needle.strip():
        return df
    return df.where(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).contains(needle.strip().lower()))


def min_amount(df: DataFrame, columns: list[str], least: float) -> DataFrame:
    amounts = [F.abs(F.col(c)) for c in columns]
    return df.where((F.greatest(*amounts) if len(amounts) > 1 else amounts[0]) >= least)


def value_counts(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)


def blank_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return df.agg(*[F.count_if(blank(c)).alias(f"{c}_blank") for c in columns], *[F.count_if(~blank(c)).alias(f"{c}_present") for c in columns])


def status_counts(df: DataFrame, statuses: list[str], column: str = "match_status") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records"), *[F.count_if(F.col(column) == s).alias(s) for s in statuses])


def as_of(df: DataFrame, date: str, day) -> DataFrame:
    """All rows of the latest date up to ``day`` (ties kept)."""
    known = df.where(F.col(date) <= F.lit(day))
    last = known.agg(F.max(date).alias("__last"))  # one row
    return known.join(F.broadcast(last), known[date] == last["__last"]).drop("__last")


def clamp_limit(df: DataFrame, n: int, low: int = 1, high: int = 100) -> DataFrame:
    return df.limit(max(low, min(int(n), high)))
