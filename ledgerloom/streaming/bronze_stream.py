"""Incremental bronze to silver, and windowed event counts, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators.relational import latest


def read_bronze_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.BRONZE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Buckets of records of a table that a stream keeps: a batch rewrites those that it touches.
BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_latest(spark: SparkSession, target: str, before: int | None = None, schema=schemas.BRONZE, only: list[int] | None = None) -> DataFrame:
    """The table that ``upsert_latest`` keeps (``before``: as it was before that batch; ``only``: these buckets): of each bucket its newest version."""
    if not _exists(spark, target):
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(target)
    if before is not None:
        rows = rows.where(F.col("v") < before)
    if only is not None:
        rows = rows.where(F.col("bucket").isin(only))
    newest = rows.select("bucket", "v").distinct().groupBy("bucket").agg(F.max("v").alias("v"))
    return rows.join(F.broadcast(newest), ["bucket", "v"]).select(*schema.fieldNames())  # a row a bucket


def upsert_latest(stream: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS):
    """Keeps ``target`` at the latest version of each record; late, older versions never win. ``read_latest`` reads it.

    A batch merges with and rewrites only the buckets of its own records, as the next version of each; a repeated batch
    writes the same version again, so a restart changes nothing.
    """
    keys = [F.col("entity_name"), F.coalesce("source_org_id", F.lit("legacy")), F.col("source_record_id")]
    bucket = F.pmod(F.xxhash64("entity_name", "source_record_id"), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, epoch: int) -> None:
        spark, names = batch.sparkSession, batch.columns
        rows = batch.withColumn("bucket", bucket)
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        known = read_latest(spark, target, epoch, batch.schema, touched).withColumn("bucket", bucket)
        merged = latest(known.unionByName(rows), keys)
        merged.repartition("bucket").select(*names, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
