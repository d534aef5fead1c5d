"""The catalog, run metadata, workbook frames, advice and what is shown of runs."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import text
from ledgerloom.operators import advice, bank_matching, relational, tax_matching
from ledgerloom.plans import catalog
from ledgerloom.sources import bridge, ingest

from .test_linkage import BOOK, GSTR, TAXBOOK, bank, book, line


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- catalog


def test_bucketed_tables_join_without_an_exchange(spark, data):
    a = catalog.save(bridge.table(spark, data, "orders"), "t_orders", ["o_orderkey"], 4)
    b = catalog.save(bridge.table(spark, data, "lineitem"), "t_lines", ["l_orderkey"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = a.join(b, a["o_orderkey"] == b["l_orderkey"])
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
        by_key = b.groupBy("l_orderkey").count()
        assert "Exchange" not in plan(by_key)
        assert joined.count() == bridge.table(spark, data, "lineitem").count() and by_key.count() == bridge.table(spark, data, "lineitem").select("l_orderkey").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    again = catalog.save(a.limit(3), "t_few", ["o_orderkey"], 2, by=["o_orderstatus"])
    assert again.count() == 3 and "o_orderstatus" in again.columns
    assert catalog.save(bridge.table(spark, data, "orders").limit(5), "t_few", ["o_orderkey"], 2).count() == 5


def test_tables_are_created_once(spark):
    spark.sql("DROP TABLE IF EXISTS t_runs")
    assert catalog.create(spark, "t_runs", schemas.RUNS, by=["status"], keys=["run_id"], buckets=4)
    assert not catalog.create(spark, "t_runs", schemas.RUNS)
    assert set(spark.table("t_runs").columns) == set(schemas.RUNS.fieldNames()) and spark.table("t_runs").count() == 0


def test_views_and_named_parameters(spark, data):
    names = catalog.views(bridge.bronze(spark, data, "invoices", "bills", "journals", "expenses", "customer_payments", "transactions"), "t_")
    assert {"t_silver_fact_bills", "t_gold_monthly_pl", "t_gold_gst_reconciliation_input"} <= set(names)
    hostile = "x' OR '1'='1"
    assert catalog.ask(spark, "SELECT * FROM t_silver_fact_invoices WHERE status = :s", s=hostile).count() == 0
    assert catalog.ask(spark, "SELECT * FROM t_silver_fact_invoices WHERE status = :s", s="O").count() > 0
    assert spark.table("t_gold_monthly_pl").limit(1).count() == 1


def test_legacy_tables_are_bronze_rows(spark):
    old = spark.createDataFrame([("7", '{"total":"5"}', datetime(2023, 1, 1), "kept")], "Source_Record_Id string, raw_json string, loaded_at timestamp, entity_name string")
    out = catalog.legacy({"bills": old, "expenses": old})
    assert out.columns == schemas.BRONZE.fieldNames() and sorted(r["entity_name"] for r in out.collect()) == ["bills", "expenses"]
    assert out.where("source_org_id IS NULL AND run_id = 'legacy'").count() == 2
    with pytest.raises(ValueError):
        catalog.legacy({})


# ---- runs


@pytest.fixture(scope="module")
def run(spark):
    g = [line(0, "INV-1", "2026-05-01", 1000.0), line(1, "INV-2", "2026-05-02", 500.0), line(2, "INV-3", "2026-05-03", 700.0, name="Other", gstin="27PQRSX5678L1Z2"), line(3, "OLD", "2026-01-01", 9.0, upload="other")]
    b = [book(0, "INV-1", "2026-05-01", 1000.0), book(1, "INV-2", "2026-05-02", 900.0), book(2, "X-9", "2026-05-02", 50.0, name="Nobody", gstin="33AAAAA0000A1Z5"), book(3, "LATE", "2026-09-01", 1.0), book(4, "NODAY", None, 1.0)]
    lines, books = spark.createDataFrame(g, GSTR), spark.createDataFrame(b, TAXBOOK)
    res = tax_matching.reconcile(lines, books, upload={"upload_id": "gstr-upload-1", "file_name": "may.xlsx"}, at="2026-06-01T00:00:00")
    return lines, books, spark.createDataFrame(res.collect(), res.schema)


def test_run_metadata_is_on_every_row(run):
    got = run[2].select("selected_upload_id", "selected_file_name", "reconciliation_timestamp", "selected_upload_min_date", "selected_upload_max_date", tax_matching.BEFORE, tax_matching.AFTER).distinct().collect()
    assert [tuple(r) for r in got] == [("gstr-upload-1", "may.xlsx", "2026-06-01T00:00:00", "2026-05-01", "2026-05-03", 5, 3)]


def test_run_metadata_needs_no_matching(run):
    lines, books, results = run
    own = tax_matching.run_metadata(lines, books, upload={"upload_id": "gstr-upload-1", "file_name": "may.xlsx"}, at="2026-06-01T00:00:00")
    assert own.collect() == results.select(*own.columns).distinct().collect()
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()


def test_counts_come_from_the_pass_that_reads_the_books(spark, run):
    lines, books, _ = run
    df, seen = tax_matching.observed(books, *tax_matching.span(lines.where("upload_id = 'gstr-upload-1'")))
    assert plan(df).count("CollectMetrics") == 1 and plan(df).count("Scan") == 1
    assert len(df.collect()) == 3 and seen.get == {tax_matching.BEFORE: 5, tax_matching.AFTER: 3}
    df, seen = tax_matching.observed(books)
    assert len(df.collect()) == 5 and seen.get == {tax_matching.BEFORE: 5, tax_matching.AFTER: 5}
    with pytest.raises(ValueError, match="No rows found for the selected GSTR upload"):
        tax_matching.reconcile(lines, books, upload_id="none")


def test_workbook_frames(run):
    frames = tax_matching.workbook(run[2], 3)
    assert list(frames) == ["Summary", "Tax Type Mismatches", "Amount Mismatches", "Missing in Books", "Missing in GSTR", "Possible Matches", "Matched", "Technical Audit"]
    assert frames["Amount Mismatches"].columns == tax_matching.FINANCE_COLUMNS and frames["Possible Matches"].columns == tax_matching.POSSIBLE_COLUMNS and frames["Technical Audit"].columns == tax_matching.AUDIT_COLUMNS
    rows = {k: f.count() for k, f in frames.items()}
    assert rows["Technical Audit"] == run[2].count() == sum(rows[s] for s in tax_matching.SHEETS)
    assert [r["invoice_number"] for r in frames["Matched"].collect()] == ["INV-1"] and [r["invoice_number"] for r in frames["Missing in Books"].collect()] == ["INV-3"]
    said = {r["Metric"]: (r["Value"], r["Explanation"]) for r in frames["Summary"].collect()}
    assert said["Selected GSTR file"] == ("may.xlsx", "") and said["Reconciliation period"][0] == "2026-05-01 to 2026-05-03" and said["Uploaded GSTR rows"] == ("3", None)
    assert said["Exact matched"][0] == "1" and said["Missing in GSTR"] == ("1", "Books bill not found in uploaded GSTR")


def test_bank_workbook_frames(spark):
    res = bank_matching.reconcile(bank(spark, ("b", "u", "2026-01-28", "Rent", 50.0, 0.0, None, -50.0)), spark.createDataFrame([], BOOK))
    frames = bank_matching.workbook(res, {"upload_id": "u", "file_name": "b.csv", "row_count": 1}, "now")
    assert list(frames) == ["Bank Reconciliation", "Run Metadata"]
    (row,) = frames["Bank Reconciliation"].collect()
    assert (row["selected_upload_id"], row["selected_file_name"], row["reconciliation_timestamp"], row["match_status"]) == ("u", "b.csv", "now", "bank_not_in_books")
    assert frames["Run Metadata"].first().asDict() == {"selected_upload_id": "u", "selected_file_name": "b.csv", "selected_uploaded_at": "", "source_type": "bank_statement", "uploaded_row_count": "1", "reconciliation_timestamp": "now"}


# ---- advice

GOOD = {"gemini_suggestion": " Possible_Match ", "gemini_confidence": "HIGH", "gemini_reason": "same day ", "gemini_recommendation": "check", "gemini_candidate_id": "b1", "more": 1}


def test_suggestions_are_validated():
    assert advice.parse(json.dumps(GOOD)) == {"gemini_suggestion": "possible_match", "gemini_confidence": "high", "gemini_reason": "same day", "gemini_recommendation": "check", "gemini_candidate_id": "b1"}
    for bad in (None, "", "[]", "null", "{}", "no json", b"\xff", json.dumps(GOOD | {"gemini_suggestion": "matched"}), json.dumps(GOOD | {"gemini_confidence": 1}), json.dumps(GOOD | {"gemini_reason": " "}), "```" + json.dumps(GOOD)):
        assert advice.parse(bad) == advice.FALLBACK


def _answers(row, candidates):
    r, c = json.loads(row), json.loads(candidates)
    if r["invoice_number"] == "INV-2":
        return json.dumps(GOOD | {"gemini_suggestion": "review_match", "gemini_candidate_id": c[0]["candidate_id"], "gemini_reason": str(len(c))})
    if r["invoice_number"] == "INV-3":
        time.sleep(3)
    raise RuntimeError("no service")


def test_advice_fills_its_own_columns_only(spark, run):
    _, books, res = run
    prepared = tax_matching.prepare_books(books)
    out = {(r["invoice_number"], r["match_status"]): r for r in advice.advise_returns(res, prepared, _answers, timeout=0.5).collect()}
    assert {k for k in out} == {(r["invoice_number"], r["match_status"]) for r in res.collect()}
    first = out["INV-2", "amount_mismatch"]
    assert (first["gemini_suggestion"], first["gemini_candidate_id"], first["gemini_reason"]) == ("review_match", "b1", "5")
    assert all({c: out[k][c] for c in advice.FALLBACK} == advice.FALLBACK for k in out if k[1] in ("missing_in_books", "missing_in_gstr"))
    assert out["INV-1", "matched"]["gemini_suggestion"] == ""
    none = advice.advise_returns(res, prepared, limit=1).collect()
    assert sum(r["gemini_suggestion"] == "needs_manual_review" for r in none) == 1 and sum(r["gemini_suggestion"] == "" for r in none) == len(none) - 1
    assert {r["gemini_reason"] for r in advice.with_advice(res, None, []).collect()} == {""}


def test_candidates_of_a_row_are_its_best_books(spark, run):
    _, books, res = run
    rows = advice.review_rows(res, 20)
    got = {}
    for r in advice.top_books(rows, tax_matching.prepare_books(books), 2).orderBy(F.col("own").desc(), F.col("score").desc(), "book_ord").collect():
        got.setdefault((r["gstr_row_ord"], r["books_row_ord"]), []).append((r["record_id"], r["own"]))
    by = {(r["gstr_row_ord"], r["books_row_ord"]): r for r in rows.collect()}
    for k, v in got.items():
        if by[k]["match_status"] == "missing_in_gstr":
            assert v == [(by[k]["books_record_id"], True)]
        else:
            assert len(v) == 2
    assert [v for k, v in got.items() if by[k]["match_status"] == "amount_mismatch"][0][0] == ("b1", True)


# ---- what is shown


def test_differences_read_from_reasons(spark):
    rows = [("amount differs by 1,234.50; date differs by 7 day(s)", 1234.5, 7), ("Amount Differs By  3", 3.0, None), ("date within 2 day(s)", None, None), (None, None, None), ("amount differs by ,", None, None)]
    df = spark.createDataFrame(rows, "r string, a double, d int")
    assert [(r[0], r[1]) for r in df.select(text.amount_difference(F.col("r")), text.day_difference(F.col("r"))).collect()] == [(a, d) for _, a, d in rows]


def test_runs_as_they_are_shown(spark):
    df = spark.createDataFrame([(59,), (60,), (3599,), (3600,), (90061,), (0,), (None,)], "s long")
    assert [r[0] for r in df.select(text.shown_duration(F.col("s"))).collect()] == ["59 sec", "1 min 0 sec", "59 min 59 sec", "1 hr 0 min", "25 hr 1 min", "0 sec", "-"]
    assert [r[0] for r in df.select(text.shown_count(F.col("s") * 1000)).collect()] == ["59,000", "60,000", "3,599,000", "3,600,000", "90,061,000", "0", "-"]
    log = ingest.run_event(spark, "r1", "success", "2026-01-01 00:00:00", completed_at="2026-01-01 00:01:05", records_loaded=12345, triggered_by="data_sync").unionByName(ingest.run_event(spark, "r2", "failed", "2026-01-02 00:00:00", error_message="no"))
    out = [tuple(r[c] for c in ("run_id", "status", "records", "duration", "triggered_by", "error_message")) for r in ingest.sync_summary(log).collect()]
    assert out == [("r2", "Failed", "-", "-", "-", "no"), ("r1", "Success", "12,345", "1 min 5 sec", "Data Sync", "")]


def test_as_of_takes_the_last_day(spark):
    df = spark.createDataFrame([("2026-01-01", 1), ("2026-01-03", 2), ("2026-01-03", 3), ("2026-01-05", 4), (None, 5)], "d string, x int").withColumn("d", F.col("d").cast("date"))
    assert sorted(r["x"] for r in relational.as_of(df, "d", "2026-01-04").collect()) == [2, 3]
    assert relational.as_of(df, "d", "2025-01-01").count() == 0


def test_bills_rank_and_give_way_in_one_shuffle(spark):
    """The latest load of each record, and no row without an organisation beside one with; as ``drop_legacy`` of ``latest``."""
    from pyspark.sql import functions as F

    from ledgerloom.operators import relational

    rows = [(None, "1", 1, "a"), ("x", "1", 1, "a"), ("x", "1", 2, "b"), ("y", "1", 1, "a"), (None, "2", 1, "a"), (None, "2", 3, "b"), ("legacy", "3", 1, "a"), (None, "3", 2, "a"), (None, None, 1, "a"), (None, None, 1, "b"), ("x", None, 2, "a"), ("x", "4", 1, "b"), ("x", "4", 1, "a")]
    df = spark.createDataFrame(rows, "source_org_id string, source_record_id string, load int, run_id string").withColumn("loaded_at", F.timestamp_seconds("load")).repartition(5)
    found = relational.latest_scoped(df)
    both = [sorted(x.select("source_org_id", "source_record_id", "load", "run_id").collect(), key=str) for x in (found, relational.drop_legacy(relational.latest(df)))]
    assert both[0] == both[1] and len(both[0]) == 7
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2  # records with an id, and those without


def test_bills_carry_lines_as_texts_not_structs(spark, data):
    """A line is JSON before its shuffle; the record reads as one JSON object with all of its lines in order."""
    import json

    from ledgerloom.sources import bridge

    bills = bridge.bills(spark, data)
    shuffled = [x for x in bills._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in x]
    assert len(shuffled) == 1
    lines = {}
    for r in spark.read.parquet(f"{data}/lineitem.parquet").collect():
        lines.setdefault(r["l_orderkey"], []).append((r["l_linenumber"], r["l_partkey"], f"{r['l_extendedprice']:.2f}", f"{r['l_quantity']:.2f}"))
    got = bills.where("run_id = 'run-1'").collect()
    assert len(got) == len(lines)
    for r in got:
        k, record = int(r["source_record_id"]), json.loads(r["raw_json"])
        own = sorted(lines[k], key=lambda x: (x[0], x[1]))
        assert sorted((x["name"], x["item_total"]) for x in record["line_items"]) == sorted((f"Part {p}", a) for _, p, a, _ in own)
        assert [x["name"] for x in record["line_items"]] == [f"Part {p}" for _, p, _, _ in own]
        assert all(("line_item_taxes" in x) == (k % 3 == 0) for x in record["line_items"])
