"""The catalog: views over bronze records, bucketed tables, legacy tables as a source, and queries with named parameters.

``views`` puts the whole stack under names, so that plain SQL reads silver and gold. ``save`` stores a relation bucketed by
its keys: joins and groups on these keys need no exchange, whatever the number of readers. ``legacy`` reads the tables of
single entities that older loads wrote, without an organisation, as bronze rows; ``drop_legacy`` then lets them give way to
rows of the same record that have one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators.store import shared_dir

from . import gold, silver

FACTS = ("invoices", "bills", "expenses", "journals", "customer_payments", "transactions")


def legacy(tables: dict[str, DataFrame]) -> DataFrame:
    """Bronze rows of legacy tables by entity; columns that they don't have are null, their load time counts as it is."""
    def one(entity: str, df: DataFrame) -> DataFrame:
        have = {c.lower(): c for c in df.columns}
        known = {"source_system": F.lit("books"), "entity_name": F.lit(entity), "run_id": F.lit("legacy")}
        cells = [F.col(have[f.name]) if f.name in have and f.name != "entity_name" else known.get(f.name, F.lit(None)) for f in schemas.BRONZE]
        return df.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(cells, schemas.BRONZE)])

    if not tables:
        raise ValueError("no legacy tables")
    return reduce(DataFrame.unionByName, [one(k, v) for k, v in tables.items()])


def views(raw: DataFrame, prefix: str = "") -> list[str]:
    """Creates or replaces the views of the stack over bronze rows in this session; their names."""
    made = {f"{prefix}silver_fact_{e}": silver.fact(raw, e) for e in FACTS}
    made |= {f"{prefix}silver_fact_{e}_history": silver.fact_history(raw, e) for e in ("invoices", "bills", "journals")}
    made |= {f"{prefix}gold_monthly_pl": gold.monthly_pl(raw), f"{prefix}gold_bank_reconciliation_input": gold.bank_ledger(raw), f"{prefix}gold_gst_reconciliation_input": gold.gst_ledger(raw)}
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)


def ask(spark: SparkSession, sql: str, **values) -> DataFrame:
    """A query with named parameters (``:name``), never spliced into its text."""
    return spark.sql(sql, args=values)


def save(df: DataFrame, name: str, keys: list[str], buckets: int = 64, by: list[str] | None = None) -> DataFrame:
    """Stores ``df`` as table ``name`` below the shared folder, bucketed and sorted by ``keys``, partitioned by ``by``; the stored table.

    Rows are dealt by the keys first, so each bucket is one file of one task."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom-tables/{spark.sparkContext.applicationId}/{name}"
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)
    return spark.table(name)


def create(spark: SparkSession, name: str, schema, by: list[str] | None = None, keys: list[str] | None = None, buckets: int = 64) -> bool:
    """Creates an empty table unless there is one; whether it was created."""
    if spark.catalog.tableExists(name):
        return False
    tick = lambda c: f"`{c}`"
    columns = ", ".join(f"{tick(f.name)} {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in schema)
    path = f"{shared_dir(spark)}/ledgerloom-tables/{spark.sparkContext.applicationId}/{name}"
    parts = [f"CREATE TABLE IF NOT EXISTS {tick(name)} ({columns}) USING parquet", f"PARTITIONED BY ({', '.join(map(tick, by))})" if by else "", f"CLUSTERED BY ({', '.join(map(tick, keys))}) INTO {int(buckets)} BUCKETS" if keys else "", f"LOCATION '{path}'"]
    spark.sql(" ".join(p for p in parts if p))
    return True
