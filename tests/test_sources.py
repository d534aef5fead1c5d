"""Uploads, run log, statements, periods, rules and streams."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import money, text
from ledgerloom.plans import consolidated, mis, periods, rules
from ledgerloom.sources import bridge, ingest, paged, sheets, statements
from ledgerloom.streaming import bronze_stream


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("141.98999999999998", "141.99"), ("₹1,234.995", "1235.00"), (None, "0.00"), ("5.555", "5.56"), ("(1,000.50)", "-1000.50"), ("junk", "0.00")])
def test_money_text(spark, raw, want):
    assert one(spark, money.to_money, raw) == Decimal(want)


@pytest.mark.parametrize("raw, want", [("31/12/2025", "2025-12-31"), ("2025-04-01", "2025-04-01"), ("45748", "2025-04-01"), ("05-Apr-2025", "2025-04-05"), ("2026", None), ("x", None)])
def test_days(spark, raw, want):
    got = one(spark, ingest.parse_day, raw)
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize("raw, want", [("2025-04", "2025-04"), ("042025", "2025-04"), ("Apr-25", "2025-04"), ("April 2025", "2025-04"), ("15/04/2025", "2025-04")])
def test_period_month(spark, raw, want):
    assert one(spark, ingest.period_month, raw) == want


def test_invoice_texts(spark):
    assert one(spark, text.numeric_token, "STPL/037/2025-26") == "037"
    assert one(spark, text.without_hash, "#20702") == "20702"
    assert one(spark, text.gstin_key, " 29abc​de ") == "29ABCDE"
    assert one(spark, text.cell_guard, "=1+1") == "'=1+1"
    assert one(spark, text.redact_secrets, "Authorization: Bearer abc.def token=xyz") == "Authorization: Bearer [REDACTED] token=[REDACTED]"


def test_bank_sheets(spark):
    rows = {"info": [["Some bank"], ["x"]], "data": [["Account", "123"], ["Txn Date", "Transaction Details", "Transaction Amount", "Running Balance"], ["01/04/2025", "Salary", "12,500.00", "20,000.00"], ["02/04/2025", "ATM", "-4500", "15,500.00"], ["", "", "", ""], ["total", "", "", ""]]}
    out = sheets.bank_statement(sheets.from_rows(spark, rows)).orderBy("raw_row_number").collect()
    assert [(r["debit_amount"], r["credit_amount"]) for r in out] == [(Decimal("0.00"), Decimal("12500.00")), (Decimal("4500.00"), Decimal("0.00"))]
    saved = ingest.bank_upload(sheets.bank_statement(sheets.from_rows(spark, rows)), "u1")
    assert saved.columns == schemas.BANK_LINES.fieldNames() and saved.select("bank_line_id").distinct().count() == 2


def test_bank_text_file(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('Transaction Date,Description,Withdrawal,Deposit,Closing Balance\n2025-04-01,"Rent, April",1000,,9000\n2025-04-02,Interest,,12.50,9012.50\n')
    out = sheets.bank_statement(sheets.text_sheet(spark, str(p))).orderBy("raw_row_number").collect()
    assert [(r["narration"], r["debit_amount"], r["credit_amount"]) for r in out] == [("Rent, April", Decimal("1000.00"), Decimal("0.00")), ("Interest", Decimal("0.00"), Decimal("12.50"))]


def test_no_header_is_an_error(spark):
    with pytest.raises(ValueError):
        sheets.bank_statement(sheets.from_rows(spark, {"a": [["x", "y"]]}))


def test_return_sheet_with_titles(spark):
    rows = {"b2b": [["Goods and services tax"], [""], ["Return"], ["GSTIN of supplier", "Trade/Legal name", "Invoice number", "Invoice Date", "Taxable Value", "Integrated Tax", "Invoice Value"], ["29ABCDE1234F1Z7", "Alpha", "INV-1", "01/04/2025", "₹1,000.00", "180", ""]]}
    (r,) = sheets.tax_return(sheets.from_rows(spark, rows)).collect()
    assert (r["period"], r["taxable_value"], r["total_tax"], r["invoice_value"]) == ("2025-04", Decimal("1000.00"), Decimal("180.00"), Decimal("1180.00"))


def test_return_json(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"x": {"invoices": [{"gst_number": "29A", "invoice_no": "7", "taxable_amount": 100, "integrated_tax": 18, "return_period": "2025-05"}]}}))
    (r,) = sheets.json_return(spark, str(p)).collect()
    assert (r["supplier_gstin"], r["invoice_number"], r["period"], r["invoice_value"]) == ("29A", "7", "2025-05", Decimal("118.00"))


def test_statement_lines(spark):
    w = lambda *p: [{"text": t, "x0": float(x)} for t, x in p]
    rows = [("d", 0, "Statement of account", []), ("d", 1, "01/04/2025 NEFT rent 1,000.00 9,000.00", w(("01/04/2025", 10), ("NEFT", 80), ("rent", 120), ("1,000.00", 361), ("9,000.00", 531))), ("d", 2, "to landlord", w(("to", 80), ("landlord", 100))), ("d", 3, "02/04/2025 Interest 12.50 9,012.50", w(("02/04/2025", 10), ("Interest", 80), ("12.50", 444), ("9,012.50", 531)))]
    df = spark.createDataFrame(rows, "doc_id string, line_no int, text string, words array<struct<text:string,x0:double>>")
    out = statements.transactions(df, {"debit": 360, "credit": 445, "balance": 530}).orderBy("seq").collect()
    assert [(r["narration"], r["debit_amount"], r["credit_amount"]) for r in out] == [("NEFT rent to landlord", Decimal("1000.00"), Decimal("0.00")), ("Interest", Decimal("0.00"), Decimal("12.50"))]


def test_bronze_append_and_read(spark, tmp_path):
    rec = spark.createDataFrame([("txn-1", 100)], "journal_id string, amount int")
    rows = ingest.raw_records(rec, "journals", "r1", {"source_org_key": "o", "source_org_id": "o"})
    assert rows.first()["source_record_id"] == "txn-1"
    assert ingest.append_bronze(rows, str(tmp_path / "b")) == 1
    assert ingest.append_bronze(rows.limit(0), str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()
    assert ingest.read_bronze(spark, str(tmp_path / "b"), "journals").columns == schemas.BRONZE.fieldNames()


def test_run_log(spark):
    log = ingest.run_event(spark, "r", "running", "2025-01-01 00:00:00").unionByName(ingest.run_event(spark, "r", "success", "2025-01-01 00:00:00", completed_at="2025-01-01 00:01:30", updated_at="2025-01-01 00:01:30", records_loaded=5))
    (r,) = ingest.run_history(log, 1000).collect()
    assert (r["status"], r["duration_seconds"], r["records_loaded"]) == ("success", 90, 5)
    with pytest.raises(ValueError):
        ingest.run_event(spark, "r", "odd", "2025-01-01")


def test_pages():
    seen = []

    def get(url):
        seen.append(url)
        return {"bills": [len(seen)], "page_context": {"has_more_page": len(seen) < 3}}

    assert list(paged.pages(get, "http://x/bills", "bills")) == [1, 2, 3]


def test_periods():
    assert periods.select("quarter", "FY 2025-26", 4).start == dt.date(2026, 1, 1)
    assert periods.select("half", "2025-2026", 2).end == dt.date(2026, 3, 31)
    assert periods.custom(dt.date(2025, 4, 10), dt.date(2025, 6, 2)).months == (dt.date(2025, 4, 1), dt.date(2025, 5, 1), dt.date(2025, 6, 1))
    with pytest.raises(ValueError):
        periods.custom(dt.date(2025, 4, 10), dt.date(2025, 4, 2))


def test_rules_in_order(spark):
    df = spark.createDataFrame([("journal", "bank charges", ["7"]), ("journal", "rebanked bank charges", ["7"]), ("bill", "other", ["9"])], "source_type string, all_text string, account_ids array<string>").withColumn("account_codes", F.array().cast("array<string>")).withColumn("line_text", F.col("all_text"))
    found = rules.with_accounts(rules.load(rules.EXAMPLE), [{"rule": "accruals", "account_id": "9", "is_active": True}])
    found[2].source_types = ["bill"]
    assert [r["category"] for r in rules.classify(df, found).collect()] == ["bank_costs", None, "accruals"]


def test_mapping_problems(spark):
    m = spark.createDataFrame([("in", "1", "a", "x", True), ("in", "1", "b", "y", True), ("in", None, None, "z", True), ("in", None, None, None, False)], "organization string, account_code string, account_name string, label string, is_active boolean")
    assert {(r["problem"], r["n"]) for r in rules.mapping_problems(m).collect()} == {("duplicate", 2), ("incomplete", 1)}


def test_line_costs(spark):
    p = periods.select("year", "FY 2025-26")
    d = lambda m: dt.date(2025, m, 1)
    m = spark.createDataFrame([("rev", d(4), 100000.0), ("journal", d(4), 5000.0), ("delivery", d(4), 40000.0), ("delivery", d(7), 50000.0), ("rev", d(7), 50000.0), ("rev", d(10), 1.0)], "category string, report_month date, amount double")
    rows = spark.createDataFrame([("bill", d(4), 40000.0, "team pay"), ("bill", d(7), 45000.0, "team pay"), ("journal", d(10), 20000.0, "lead pay"), ("invoice", d(10), 7.0, "lead pay")], "source_type string, report_month date, amount_inr double, all_text string")
    rows = rows.withColumns({"line_text": F.col("all_text"), "header_text": F.col("all_text"), "account_ids": F.array().cast("array<string>"), "account_codes": F.array().cast("array<string>")})
    detail = mis.cogs_detail(rows, [rules.Rule("team", ["bill", "journal"], ["team"]), rules.Rule("lead", ["bill", "journal"], ["lead"])], p)
    items = mis.line_items(m, detail, ["team"], ["lead"], ["delivery"], {"services_revenue": ["rev"], "other_income": ["journal"]})
    by = {r["report_month"]: r for r in items.collect()}
    assert (by[d(4)]["services_revenue"], by[d(4)]["other_income"], by[d(4)]["offshore_cogs"], by[d(7)]["offshore_cogs"]) == (100000, 5000, 40000, 45000)
    assert by[d(10)]["onshore_cogs"] == 582500 and all(r["technology_costs"] == 25800 for r in by.values())
    assert (by[d(4)]["consultant_sm"], by[d(10)]["consultant_sm"], by[d(4)]["other_ga"], by[d(7)]["other_ga"]) == (1125000, 562500, 0, 5000)
    sheet = mis.monthly_sheet(items, p)
    assert [r["Line Item"] for r in sheet.collect()] == list(mis.LABELS.values()) and sheet.columns[1:] == [x.strftime("%b-%y") for x in p.months]
    q = {(r["Line Item"], r["quarter"]): r["amount"] for r in mis.quarterly_sheet(items).collect()}
    assert q["Offshore COGS", "Q1"] == 40000 and q["Onshore COGS", "Q3"] == 582500
    assert {r["metric"]: r["shown"] for r in mis.metrics(items).collect()}["Revenue"] == "INR 1.55 L"


def test_organisation_names():
    from ledgerloom.operators.relational import organisation

    assert [organisation(x) for x in ("India", "U.S.", None, "mars", " usa ")] == ["india", "us", "all", "all", "us"]


def test_balance_sheet_takes_latest(spark):
    s = spark.createDataFrame([(dt.date(2025, 3, 31), 10.0, 5.0, None), (dt.date(2026, 3, 31), 99.0, 99.0, 1.0)], "as_of_date date, bank_cash double, payables_amount double, equity_amount double")
    out = {r["line"]: r["amount"] for r in consolidated.balance_sheet(s, dt.date(2025, 12, 31)).collect()}
    assert out == {"bank_cash": 10.0, "payables": 5.0, "receivables": None, "other_assets": None, "tax_liabilities": None, "equity_retained_earnings": None}
    long = spark.createDataFrame([("Accounts Receivable", 7.0), ("receivables", 1.0), ("Cash", 3.0), ("Goodwill", 9.0)], "line_item string, amount_inr double")
    out = {r["line"]: r["amount"] for r in consolidated.balance_sheet(long, dt.date(2025, 12, 31)).collect()}
    assert (out["receivables"], out["bank_cash"], out["payables"]) == (8.0, 3.0, None)


@pytest.mark.parametrize("kind, aliases", [("bank", sheets.BANK), ("gstr", sheets.GSTR)])
def test_every_spelling_of_a_column_is_known(spark, kind, aliases):
    known = {sheets.alias_key(a): n for n, names in aliases.items() for a in names}
    assert len(known) == len({(sheets.alias_key(a), n) for n, names in aliases.items() for a in names})  # no spelling means two columns
    base = {"bank": ["txn date", "details", "amount"], "gstr": ["invoice no", "gstin", "txval"]}[kind]
    for n, names in aliases.items():
        head = [a for a in base if known[sheets.alias_key(a)] != n] + [names[-1]]
        b = sheets.body(sheets.from_rows(spark, {"s": [head, ["x"] * len(base) + ["v"]]}), kind)
        assert b.first()[n] in ("v", "x")


def test_uploads_are_saved_registered_and_deleted(spark, tmp_path):
    lines, reg = str(tmp_path / "lines"), str(tmp_path / "registry")
    rows = ingest.bank_upload(spark.createDataFrame([("2025-04-01", "a"), ("2025-04-01", "a"), ("2025-04-02", "b")], "transaction_date string, narration string"), "u1")
    again = ingest.bank_upload(spark.createDataFrame([("2025-04-02", "b"), ("2025-04-01", "a"), ("2025-04-01", "a")], "transaction_date string, narration string").repartition(3), "u1")
    ids = lambda df: sorted(r[0] for r in df.select("bank_line_id").collect())
    assert ids(rows) == ids(again) and len(set(ids(rows))) == 3
    for u in ("u1", "u2"):
        assert ingest.save_upload(rows, lines, reg, u, "bank_statement", "f.csv", "2025-05-01 00:00:00") == 3
    ingest.save_upload(rows.limit(2), lines, reg, "u1", "bank_statement", "f.csv", "2025-05-02 00:00:00")
    stored = ingest.read_uploads(spark, lines, schemas.BANK_LINES)
    assert {r["upload_id"]: r["count"] for r in stored.groupBy("upload_id").count().collect()} == {"u1": 2, "u2": 3}
    assert ingest.delete_upload(spark, lines, reg, "u1", "bank_statement", "f.csv", "2025-05-03 00:00:00")
    assert not ingest.delete_upload(spark, lines, reg, "u1", "bank_statement", "f.csv", "2025-05-04 00:00:00")
    registry = spark.read.schema(schemas.UPLOADS).parquet(reg)
    assert ingest.read_uploads(spark, lines, schemas.BANK_LINES).count() == 3 and registry.count() == 5
    (last,) = ingest.latest_upload(registry, "bank_statement", "u1").collect()
    assert last["parse_status"] == "deleted"
    with pytest.raises(Exception):
        ingest.save_upload(spark.range(1).select(F.expr("raise_error('x')").alias("y")), lines, reg, "u3", "gstr", "g.csv", "2025-05-03 00:00:00")
    assert spark.read.schema(schemas.UPLOADS).parquet(reg).where("upload_id = 'u3' AND parse_status = 'failed'").count() == 1


def test_reports_guard_formulas(spark, tmp_path):
    ingest.save_report({"Run Metadata": spark.createDataFrame([("=1+1", 1)], "t string, n int")}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "run_metadata")).first()["t"] == "'=1+1"
    assert ingest.snake_case(spark.range(1).toDF(" Txn Date (x)")).columns == ["txn_date_x"]


def test_stream_keeps_latest(spark, data, tmp_path):
    rows = bridge.bronze(spark, data, "journals")
    for v in (1, 2, 0):
        rows.where(F.col("run_id") == f"run-{v}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = bronze_stream.upsert_latest(bronze_stream.read_bronze_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "chk"))
    q.awaitTermination()
    last = bronze_stream.read_latest(spark, str(tmp_path / "out"))
    from ledgerloom.operators.relational import latest

    assert last.count() == latest(rows).count()
    assert last.select("source_record_id", "run_id").exceptAll(latest(rows).select("source_record_id", "run_id")).count() == 0
