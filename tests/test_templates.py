"""Statements by template, versioned tables, account mappings and details of paged records."""

import http.server
import json
import threading
from decimal import Decimal

import pytest

from ledgerloom.plans import rules
from ledgerloom.sources import paged, templates
from ledgerloom.sources.versions import Conflict, VersionedTable

WORDS = "array<struct<text:string,x0:double>>"
LINES = f"doc_id string, page long, line_no int, text string, words {WORDS}, template_name string"
AT = {"debit": 360.0, "credit": 445.0, "balance": 530.0}


def placed(text, **places):
    """Words 32 apart, amounts in their columns."""
    x = {v: AT[k] for k, v in places.items()}
    return [(w, x.get(w.rstrip("+-"), 40.0 + 32 * i)) for i, w in enumerate((text or "").split())]


def lines(spark, *rows, doc="d", name=None):
    return spark.createDataFrame([(doc, page, i, text, placed(text, **where), name) for i, (page, text, where) in enumerate(rows)], LINES)


def read(df, *t):
    out = templates.transactions(df, *t).orderBy("doc_id", "seq").collect()
    return [(str(r["transaction_date"]), r["narration"], float(r["debit_amount"]), float(r["credit_amount"]), float(r["balance_amount"])) for r in out]


def test_dates_narrations_and_amounts_are_carried(spark):
    df = lines(
        spark,
        (1, "Account number 12", {}),
        (1, "no date yet 1.00 2.00", dict(debit="1.00", balance="2.00")),
        (1, "Jan 27 2025 BALANCE B/F 901,879.35", dict(balance="901,879.35")),
        (1, "Jan 28 2025 Balance Based Charges", {}),
        (1, "5,000.00 896,879.35", dict(debit="5,000.00", balance="896,879.35")),
        (1, "CGST 450.00 896,429.35", dict(debit="450.00", balance="896,429.35")),
        (1, "Feb 24 2025 CARD SETTLEMENT", {}),
        (1, "1,500.00", dict(debit="1,500.00")),
        (2, "DD History Page 2", {}),
        (2, "894,929.35", dict(balance="894,929.35")),
        (2, "NEFT RETURN 25-Feb-2025 VENDOR A 10,000.00 904,929.35-", dict(credit="10,000.00", balance="904,929.35")),
        (2, "dropped words", {}),
        (2, "01 Mar 2025 CREDIT INTEREST 79.35 905,008.70", dict(credit="79.35", balance="905,008.70")),
        (2, None, {}),
    )
    assert read(df) == [
        ("2025-01-27", "BALANCE B/F", 0.0, 0.0, 901879.35), ("2025-01-28", "Balance Based Charges", 5000.0, 0.0, 896879.35), ("2025-01-28", "CGST", 450.0, 0.0, 896429.35), ("2025-02-24", "CARD SETTLEMENT", 1500.0, 0.0, 894929.35),
        ("2025-02-25", "NEFT RETURN VENDOR A", 0.0, 10000.0, -904929.35), ("2025-03-01", "CREDIT INTEREST", 0.0, 79.35, 905008.70),
    ]


def test_lines_without_places_are_read_by_words(spark):
    df = lines(spark, (1, "Jan 02 2025 refund of fee 10.00 110.00", {}), (1, "fee 5.00 105.00", {}))
    bare = df.withColumn("words", templates.F.lit(None).cast(WORDS))
    assert read(bare) == [("2025-01-02", "refund of fee", 0.0, 10.0, 110.0), ("2025-01-02", "fee", 5.0, 0.0, 105.0)]


def test_places_come_from_the_page_head_where_the_template_has_none(spark):
    t = templates.Template(**{f"{c}_column_x_{m}": None for c in AT for m in ("min", "max")})
    head = ("Date", 1.0), ("Transaction", 2.0), ("Narrative", 3.0), ("Debit", 100.0), ("Credit", 200.0), ("Ledger", 300.0)
    rows = [("d", 1, 0, "Date Transaction Narrative Debit Credit Ledger", head, None), ("d", 1, 1, "Jan 02 2025 x 5.00 7.00", [("5.00", 199.0), ("7.00", 301.0)], None), ("d", 1, 2, "y 5.00 7.00", [("5.00", 101.0), ("7.00", 301.0)], None)]
    assert read(spark.createDataFrame(rows, LINES), t) == [("2025-01-02", "x", 0.0, 5.0, 7.0), ("2025-01-02", "y", 5.0, 0.0, 7.0)]


def test_each_document_by_its_template_and_empty_tables(spark):
    iso = templates.Template(template_name="Iso", date_patterns=[r"(\d{4}-\d{2}-\d{2}):"], amount_pattern=r"\d+\.\d{2}", opening_balance_keywords=["brought forward"], debit_column_x_min=10.0, debit_column_x_max=None)
    a = lines(spark, (1, "2025-04-01: brought forward 7.00", dict(balance="7.00")), (1, "2025-04-02: rent 2.00 5.00", dict(debit="2.00", balance="5.00")), doc="a", name="iso")
    b = lines(spark, (1, "Apr 03 2025 rent 2.00 5.00", dict(debit="2.00", balance="5.00")), doc="b", name="unknown")
    want = [("2025-04-01", "BALANCE B/F", 0.0, 0.0, 7.0), ("2025-04-02", "rent", 0.0, 2.0, 5.0), ("2025-04-03", "rent", 2.0, 0.0, 5.0)]
    assert read(a.unionByName(b), templates.Template(), iso) == want  # a debit column at 10 has its border far left of the amount
    assert read(a.limit(0)) == []


def test_long_documents_cross_batches(spark):
    n, size = 300, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, *x) for i in range(n) for x in (("Jan 02 2025 pay", {}), (f"{i}.00", dict(debit=f"{i}.00")), ("1.00", dict(balance="1.00")))]
        got = read(lines(spark, *[(p, t, w) for p, t, w in rows]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert [x[2] for x in got[2:]] == [float(i) for i in range(2, n)] and len(got) == n


def test_doubtful_readings(spark):
    df = lines(spark, *[(p, "Jan 02 2025 pay 1.00 2.00", dict(debit="1.00", balance="2.00")) for p in range(30)])
    (r,) = templates.doubtful(df, templates.transactions(df)).collect()
    assert (r["doc_id"], r["pages"], r["n_rows"]) == ("d", 30, 30)


FORM = {"Template Name": "Test", "Bank Name": "Bank", "Statement Type": "", "Date Patterns": r"\d{4}-\d{2}-\d{2}", "Amount Pattern": r"\d+\.\d{2}", "Opening Balance Keywords": "a\nb, c", "Ignore Line Keywords": "", "Debit Column X Min": "100", "Debit Column X Max": "160", "Active/Inactive": "Active"}


def test_templates_are_validated_stored_and_picked(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert templates.load(table) == [templates.Template()] and templates.pick([]).template_name == "HSBC Default"
    bad = templates.save(table, [FORM, {"Debit Column X Min": "left", "Date Patterns": "(", "Amount Pattern": "["}])
    assert bad["errors"] == ["Row 2: Template Name is required.", "Row 2: Bank Name is required.", "Row 2: Date Pattern is not a valid regular expression.", "Row 2: Amount Pattern is not a valid regular expression.", "Row 2: Debit Column X Min must be numeric when provided."]
    assert templates.problems([]) == ["At least one bank PDF template is required."] and table.version() == 0
    off = FORM | {"Template Name": "Off", "Active/Inactive": "Inactive"}
    assert templates.save(table, [off, FORM])["saved_count"] == 2
    stored = templates.load(table)
    t = templates.pick(stored, " TEST ")
    assert (t.opening_balance_keywords, t.place("debit"), t.place("credit"), t.ignore_line_keywords) == (["a", "b", "c"], 130.0, None, templates.IGNORED)
    assert templates.pick(stored, "Off") == t and templates.from_form(templates.to_form(t)) == t


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path, one = str(tmp_path / "v"), spark.range(1)
    table = VersionedTable(spark, path)
    assert table.load() is None and table.save(one) == 1
    done, base = [], table.version()

    def write(n):
        try:
            done.append(VersionedTable(spark, path).save(spark.range(n), base))
        except Conflict:
            done.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in (5, 6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(done, key=str) == [2, None] and table.version() == 2
    assert table.load().count() in (5, 6) and table.load(1).count() == 1
    with pytest.raises(Conflict):
        table.save(one, 1)
    assert not table._claim("000000002", "late")  # between the look and the move


def test_mapping_is_stored_unless_it_has_problems(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "m"))
    m = lambda *rows: spark.createDataFrame(rows, "organization string, account_code string, account_name string, label string, is_active boolean")
    twice = m(("", "7", None, "x", True), ("all", "7", None, "y", True), (None, None, None, "z", True))
    assert rules.save_mapping(table, twice, "me", "2025-01-01") == {"status": "error", "errors": {"duplicate": 1, "incomplete": 1}, "saved_count": 0} and table.version() == 0
    done = rules.save_mapping(table, m((None, "7", None, "x", True), (None, None, None, None, None)), "me", "2025-01-01", expected=0)
    assert (done["saved_count"], done["version"]) == (1, 1)
    r = table.load().first()
    assert (r["organization"], r["section"], r["sign_rule"], r["updated_by"], r["updated_at"]) == ("all", "expense", "positive", "me", "2025-01-01")


class Canned(http.server.BaseHTTPRequestHandler):
    """Bills 1 to 3: the first detail is busy once, the second fails once, the third is gone."""

    tries: dict = {}

    def do_GET(self):
        n = Canned.tries[self.path] = Canned.tries.get(self.path, 0) + 1
        code, body = 200, {}
        if self.path == "/bills/1":
            code, body = (429, {}) if n == 1 else (200, {"bill": {"bill_id": "1", "lines": [1]}})
        elif self.path == "/bills/2":
            code, body = (500, {}) if n == 1 else (200, {"bill": {"bill_id": "2", "lines": []}})
        elif self.path == "/expenses/a%2Fb":
            body = {"message": "no detail"}
        else:
            code = 404
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *a):
        pass


def test_details_replace_summaries(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Canned)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = [("o", "bills", json.dumps({"bill_id": str(i)} if i else {"x": 1})) for i in range(4)] + [("o", "expenses", '{"expense_id": "a/b"}'), ("p", "bills", '{"bill_id": "1"}'), ("o", "accounts", "{}"), ("o", "bills", None)]
    try:
        df = paged.with_details(spark.createDataFrame(rows, "source_org_key string, entity_name string, raw_json string"), {"o": f"http://127.0.0.1:{server.server_port}"}, 2)
        got = {(r["source_org_key"], r["entity_name"], r["raw_json"], r["detail"]) for r in df.collect()}
    finally:
        server.shutdown()
    assert got == {
        ("o", "bills", '{"x": 1}', "summary"), ("o", "bills", '{"bill_id": "1", "lines": [1]}', "full"), ("o", "bills", '{"bill_id": "2", "lines": []}', "full"), ("o", "bills", '{"bill_id": "3"}', "summary"),
        ("o", "expenses", '{"expense_id": "a/b"}', "summary"), ("p", "bills", '{"bill_id": "1"}', "summary"), ("o", "accounts", "{}", None), ("o", "bills", None, "summary"),
    }
    assert Canned.tries["/bills/1"] == Canned.tries["/bills/2"] == 2


def test_amounts(spark):
    cell = lambda x: spark.range(1).select(templates._amount(templates.F.lit(x))).first()[0]
    assert [cell(x) for x in ("1,234.50", "-2.00", "3.00-", "4.00 DR", "5.00CR", "+6.00", "x")] == [Decimal("1234.50"), Decimal("-2.00"), Decimal("-3.00"), Decimal("4.00"), Decimal("5.00"), Decimal("6.00"), None]
