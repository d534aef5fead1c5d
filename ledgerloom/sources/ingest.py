"""Bronze appends, run log, upload registry, saves and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions.money import to_money
from ledgerloom.functions.text import cell_guard, shown_count, shown_duration, title_label
from ledgerloom.operators.relational import clamp_limit, qualify


#: Bronze rows of one file.
ROWS_PER_FILE = 1_000_000


def raw_records(records: DataFrame, entity: str, run_id: str, org: dict, loaded_at: Column | None = None, id_field: str | None = None) -> DataFrame:
    """Bronze rows of source records: the whole record as JSON, its id as text ('' if there is none)."""
    key = id_field or schemas.ENTITY_IDS.get(entity, f"{entity[:-1]}_id")
    rid = F.coalesce(F.col(key).cast("string"), F.lit("")) if key in records.columns else F.lit("")
    text = lambda k: F.lit(org.get(k)).cast("string")
    return records.select(
        F.lit(run_id).alias("run_id"), F.lit(org.get("source_system", "books")).alias("source_system"), F.lit(entity).alias("entity_name"), rid.alias("source_record_id"),
        text("source_org_key").alias("source_org_key"), text("source_org_id").alias("source_org_id"), text("source_org_name").alias("source_org_name"), text("source_country").alias("source_country"), text("source_currency").alias("source_currency"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("raw_json"), text("uri").alias("gcs_uri"), (F.current_timestamp() if loaded_at is None else loaded_at).alias("loaded_at"),
    )


def append_bronze(rows: DataFrame, path: str) -> int:
    """Appends bronze rows, stored by entity and load day; nothing is written for no rows. Returns the count.

    Rows are dealt by entity and record, so a large entity is written by many tasks."""
    n = rows.count()
    if n:
        out = rows.withColumns({"load_date": F.to_date("loaded_at"), "__part": F.pmod(F.xxhash64("source_record_id"), F.lit(max(1, n // ROWS_PER_FILE)))})
        out.repartition("entity_name", "__part").drop("__part").sortWithinPartitions("entity_name", "source_org_key", "source_record_id").write.mode("append").partitionBy("entity_name", "load_date").parquet(path)
    return n


def read_bronze(spark: SparkSession, path: str, *entities: str) -> DataFrame:
    df = spark.read.parquet(path)
    return (df.where(F.col("entity_name").isin(*entities)) if entities else df).select(*schemas.BRONZE.fieldNames())


def write_json_store(records: DataFrame, path: str, org: str, entity: str, run_id: str, day) -> None:
    """Records as JSON files under org/entity/year/month/day/run_id."""
    cols = {"org": F.lit(org), "entity": F.lit(entity), "year": F.lit(day.year), "month": F.lit(day.month), "day": F.lit(day.day), "run_id": F.lit(run_id)}
    records.withColumns(cols).write.mode("append").partitionBy(*cols).json(path)


# ---- run log

STATUSES = ("running", "success", "failed")


def run_event(spark: SparkSession, run_id: str, status: str, started_at: str, **values) -> DataFrame:
    """One row for the append-only run log; the last event of a run is its state."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    row = {"run_id": run_id, "source_system": "books", "status": status, "started_at": started_at, "created_at": started_at, "updated_at": values.get("completed_at") or started_at} | values
    return spark.createDataFrame([tuple(str(row[f]) if row.get(f) is not None else None for f in schemas.RUNS.fieldNames())], ", ".join(f"{f} string" for f in schemas.RUNS.fieldNames())).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.RUNS])


def log_run(spark: SparkSession, path: str, run_id: str, status: str, started_at: str, **values) -> None:
    """Appends one event to the run log."""
    run_event(spark, run_id, status, started_at, **values).write.mode("append").parquet(path)


def run_history(log: DataFrame, limit: int = 25, status: str | None = None) -> DataFrame:
    """Latest event of each run, newest first, with duration in whole seconds (not below 0)."""
    last = qualify(log, ["run_id"], [F.col("updated_at").desc(), F.col("completed_at").desc_nulls_last(), F.col("created_at").desc(), F.col("status").desc()])
    if status:
        last = last.where(F.col("status") == status)
    seconds = F.greatest(F.unix_timestamp("completed_at") - F.unix_timestamp("started_at"), F.lit(0).cast("long"))
    last = last.withColumn("duration_seconds", F.when(F.col("completed_at").isNotNull(), seconds))
    return clamp_limit(last.orderBy(F.coalesce("completed_at", "started_at").desc(), F.col("created_at").desc(), "run_id"), limit)


def sync_summary(log: DataFrame, limit: int = 25, status: str | None = None) -> DataFrame:
    """The run history as it is shown: status, records, duration and who started it."""
    h = run_history(log, limit, status)
    return h.select("run_id", title_label(F.col("status")).alias("status"), "started_at", "completed_at", shown_count(F.col("records_loaded")).alias("records"), shown_duration(F.col("duration_seconds")).alias("duration"), title_label(F.coalesce(F.nullif(F.trim("triggered_by"), F.lit("")), F.lit("-"))).alias("triggered_by"), F.coalesce("error_message", F.lit("")).alias("error_message"))


def record_counts(raw: DataFrame) -> DataFrame:
    """(source_org_key, counts: entity -> rows)."""
    by = raw.groupBy("source_org_key", "entity_name").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("source_org_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_name", "n")))).alias("counts"))


def metadata(c: Column) -> Column:
    """JSON object as a map; anything else is an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


# ---- uploads


def _require(df: DataFrame, names: list[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def snake_case(df: DataFrame) -> DataFrame:
    """Column names in lower case with one underscore between words."""
    import re

    return df.toDF(*[re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") for c in df.columns])


def _line_ids(df: DataFrame, upload_id: str, name: str) -> DataFrame:
    """Ids that a repeated save gives again: rows are known by their number, or (without numbers) by content and copy."""
    from pyspark.sql import Window as W

    if "raw_row_number" in df.columns:
        row = F.col("raw_row_number").cast("string")
    else:
        content = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        df = df.withColumn("__row", content)
        df = df.withColumns({"__copy": F.row_number().over(W.partitionBy("__row").orderBy("__row")), "raw_row_number": F.lit(None).cast("long")})
        row = F.concat_ws("#", "__row", "__copy")
    return df.withColumns({"upload_id": F.lit(upload_id), name: F.sha2(F.concat_ws(":", F.lit(upload_id), row), 256)}).drop("__row", "__copy")


def bank_upload(df: DataFrame, upload_id: str, created_at: Column | None = None) -> DataFrame:
    """Bank lines as they are stored: exact money, dates, ids."""
    _require(df, ["transaction_date", "narration"])
    df = _line_ids(df, upload_id, "bank_line_id")
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    made = {"transaction_date": parse_day(F.col("transaction_date")), "value_date": parse_day(have("value_date")), "created_at": F.current_timestamp() if created_at is None else created_at}
    made |= {c: to_money(have(c)) for c in ("debit_amount", "credit_amount", "balance_amount")}
    return df.select(*[made.get(f.name, have(f.name)).cast(f.dataType).alias(f.name) for f in schemas.BANK_LINES])


def gstr_upload(df: DataFrame, upload_id: str, created_at: Column | None = None) -> DataFrame:
    """Return lines as they are stored: total tax and invoice value are recalculated; the day falls back to the period's first."""
    _require(df, ["supplier_gstin", "invoice_number", "taxable_value"])
    df = _line_ids(df, upload_id, "gstr_line_id")
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    money = {c: to_money(have(c)) for c in ("taxable_value", "igst_amount", "cgst_amount", "sgst_amount", "cess_amount")}
    tax = money["igst_amount"] + money["cgst_amount"] + money["sgst_amount"] + money["cess_amount"]
    made = money | {"total_tax": tax, "invoice_value": money["taxable_value"] + tax, "invoice_date": F.coalesce(parse_day(have("invoice_date")), parse_day(F.concat(period_month(have("period")), F.lit("-01")))), "created_at": F.current_timestamp() if created_at is None else created_at}
    return df.select(*[made.get(f.name, have(f.name)).cast(f.dataType).alias(f.name) for f in schemas.GSTR_LINES])


def parse_day(c: Column) -> Column:
    """ISO, day-first, month names and spreadsheet serials."""
    x = F.trim(c.cast("string"))
    serial = F.when(x.rlike(r"^\d{5}(\.0+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), x.try_cast("double").cast("int")))
    forms = [F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.regexp_extract(x, r"^(\d{4}-\d{1,2}-\d{1,2})", 1).try_cast("date"))]
    for pattern, form in ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "d-MMM-yy")):
        forms.append(F.when(x.rlike(pattern), F.to_date(F.try_to_timestamp(x, F.lit(form)))))
    return F.coalesce(*forms, serial)


def period_month(c: Column) -> Column:
    """yyyy-MM of ``2025-04``, ``042025``, ``Apr-25``, ``April 2025`` or a date."""
    x = F.trim(c.cast("string"))
    name = F.coalesce(F.when(x.rlike(r"^[A-Za-z]{3}-\d{2}$"), F.try_to_timestamp(x, F.lit("MMM-yy"))), F.when(x.rlike(r"^[A-Za-z]{3} \d{4}$"), F.try_to_timestamp(x, F.lit("MMM yyyy"))), F.when(x.rlike(r"^[A-Za-z]{4,} \d{4}$"), F.try_to_timestamp(x, F.lit("MMMM yyyy"))))
    return F.coalesce(F.when(x.rlike(r"^\d{4}-\d{2}"), F.substring(x, 1, 7)), F.when(x.rlike(r"^(0[1-9]|1[0-2])\d{4}$"), F.concat(F.substring(x, 3, 4), F.lit("-"), F.substring(x, 1, 2))), F.date_format(name, "yyyy-MM"), F.date_format(parse_day(x), "yyyy-MM"))


def latest_upload(registry: DataFrame, file_type: str, upload_id: str | None = None) -> DataFrame:
    rows = registry.where(F.col("file_type") == file_type)
    if upload_id:
        rows = rows.where(F.col("upload_id") == upload_id)
    return qualify(rows, ["upload_id"], [F.col("uploaded_at").desc(), F.col("parse_status").desc()]).orderBy(F.col("uploaded_at").desc(), "upload_id").limit(1)


def register(spark: SparkSession, registry: str, upload_id: str, file_type: str, file_name: str, status: str, uploaded_at: str, records: int | None = None, **values) -> None:
    """Appends a row to the upload registry; the last row of an upload is its state."""
    row = {"upload_id": upload_id, "file_type": file_type, "original_file_name": file_name, "uploaded_at": uploaded_at, "parse_status": status, "records_parsed": records} | values
    cells = tuple(str(row[f]) if row.get(f) is not None else None for f in schemas.UPLOADS.fieldNames())
    text = spark.createDataFrame([cells], ", ".join(f"{f} string" for f in schemas.UPLOADS.fieldNames()))
    text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.UPLOADS]).write.mode("append").parquet(registry)


def save_upload(lines: DataFrame, path: str, registry: str, upload_id: str, file_type: str, file_name: str, uploaded_at: str) -> int:
    """Replaces the stored lines of an upload and registers it, as failed if they can't be stored. Lines are stored by upload."""
    spark = lines.sparkSession
    try:
        n = lines.count()
        lines.drop("upload_id").write.mode("overwrite").parquet(f"{path}/upload_id={upload_id}")
    except Exception as e:
        register(spark, registry, upload_id, file_type, file_name, "failed", uploaded_at, error_message=str(e)[:500])
        raise
    register(spark, registry, upload_id, file_type, file_name, "parsed", uploaded_at, n)
    return n


def read_uploads(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def delete_upload(spark: SparkSession, path: str, registry: str, upload_id: str, file_type: str, file_name: str, deleted_at: str) -> bool:
    """Deletes the stored lines of one upload, no others, and registers that; whether there were any."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/upload_id={upload_id}")
    gone = folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    register(spark, registry, upload_id, file_type, file_name, "deleted", deleted_at)
    return gone


def without_upload(lines: DataFrame, upload_id: str) -> tuple[DataFrame, int]:
    """The rows of all other uploads, and how many rows go."""
    return lines.where(~F.col("upload_id").eqNullSafe(F.lit(upload_id))), lines.where(F.col("upload_id") == upload_id).count()


def output_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder, newest first, with their group by name."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length").dropDuplicates(["path"])
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    group = F.when(name.contains("bank"), F.lit("bank")).when(name.contains("gst"), F.lit("gst")).when(name.contains("vendor"), F.lit("vendor")).when(name.rlike("mis|pl"), F.lit("mis")).otherwise(F.lit("other"))
    return f.withColumn("file_group", group).orderBy(F.col("modificationTime").desc(), "path")


def save_report(sheets: dict[str, DataFrame], path: str) -> list[str]:
    """A report's sheets, each as a Parquet table; texts that a spreadsheet would run as formulas are guarded."""
    for name, df in sheets.items():
        guarded = [cell_guard(F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes]
        df.select(*guarded).write.mode("overwrite").parquet(f"{path}/{name.lower().replace(' ', '_')}")
    return list(sheets)
