"""Bronze records and uploads derived from the benchmark tables, by modular arithmetic only.

Both engines of the correctness gate can build them: Spark as JSON records, the SQL equivalents directly.
Each entity is a branch of its own, so a plan that needs one entity reads one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = ("accounts", "contacts", "invoices", "bills", "expenses", "customer_payments", "journals", "transactions")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)").cast("string")


def _versions(df: DataFrame, key: str, third: bool = False) -> DataFrame:
    """Loads of a record: v=1 always, v=2 where key % 7 = 0 (and a third load for dimensions); v=0 without organisation where key % 11 = 0."""
    k = F.col(key)
    loads = [F.when(k % 11 == 0, F.lit(0)), F.lit(1), F.when(k % 7 == 0, F.lit(2)) if not third else F.lit(2)]
    if third:
        loads.append(F.lit(3))
    return df.withColumn("v", F.explode(F.filter(F.array(*loads), lambda x: x.isNotNull())))


def _bronze(df: DataFrame, entity: str, key: str, *fields: Column, line_items: str | None = None) -> DataFrame:
    """``line_items``: a column of JSON objects, joined by commas, that the record holds as an array besides its ``fields``."""
    k, v, raw = F.col(key), F.col("v"), F.to_json(F.struct(*fields))
    if line_items:
        raw = F.concat(F.regexp_replace(raw, r"\}$", ""), F.lit(',"line_items":['), F.col(line_items), F.lit("]}"))
    org = lambda a, b: F.when(v == 0, F.lit(None).cast("string")).when(k % 2 == 0, F.lit(a)).otherwise(F.lit(b))
    return df.select(
        F.concat(F.lit("run-"), v.cast("string")).alias("run_id"), F.lit("books").alias("source_system"), F.lit(entity).alias("entity_name"), k.cast("string").alias("source_record_id"),
        org("in01", "us01").alias("source_org_key"), org("in01", "us01").alias("source_org_id"), org("India Org", "US Org").alias("source_org_name"), org("India", "USA").alias("source_country"), org("INR", "USD").alias("source_currency"),
        raw.alias("raw_json"), F.lit(None).cast("string").alias("gcs_uri"), F.make_timestamp(F.lit(2024), v + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("loaded_at"),
    )


def _s(c, name: str) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string").alias(name)


def _currency(k: Column) -> Column:
    return F.when(k % 5 == 0, F.lit("USD")).otherwise(F.lit("INR"))


def invoices(spark, sf_dir) -> DataFrame:
    o = _versions(table(spark, sf_dir, "orders"), "o_orderkey")
    k, v = F.col("o_orderkey"), F.col("v")
    total = F.round(F.col("o_totalprice"), 2).cast("decimal(18,2)") + F.when(v == 2, F.lit(100)).otherwise(F.lit(0))
    return _bronze(o, "invoices", "o_orderkey", _s(F.concat(F.lit("INV-"), k), "invoice_number"), _s("o_custkey", "customer_id"), _s(F.concat(F.lit("Customer "), F.col("o_custkey")), "customer_name"), _s(F.to_date("o_orderdate"), "date"), _s("o_orderstatus", "status"), _s(_currency(k), "currency_code"), _s(total, "total"), _s((total * F.lit(0.8).cast("decimal(2,1)")).cast("decimal(18,2)"), "sub_total"), _s(F.when(k % 3 != 0, F.lit("150.00")), "igst"), _s(F.when(k % 4 == 0, total).otherwise(F.lit(0).cast("decimal(18,2)")), "balance"), F.when(k % 6 == 0, F.lit("29ABCDE1234F1Z7")).alias("gst_no"))


def bills(spark, sf_dir) -> DataFrame:
    """Bills of all orders. A line becomes JSON once, before it is shuffled: gathering structs of texts, or writing them for each load of a
    bill, costs more than the shuffle."""
    money = lambda c: F.round(F.col(c), 2).cast("decimal(18,2)")
    k, total = F.col("l_orderkey"), F.col("total")
    tax = lambda *names: F.array(*[F.struct(F.lit(x).alias("tax_name"), money("l_quantity").cast("string").alias("tax_amount")) for x in names])
    taxes = F.when(k % 3 == 0, F.when(k % 2 == 0, tax("IGST 18")).otherwise(tax("CGST 9", "SGST 9")))
    item = F.to_json(F.struct(F.concat(F.lit("Part "), F.col("l_partkey")).alias("name"), money("l_extendedprice").cast("string").alias("item_total"), taxes.alias("line_item_taxes")))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", item.alias("item")).alias("line"), "l_suppkey", "l_shipdate", money("l_extendedprice").alias("amount")).repartition("l_orderkey")
    by = li.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("line"))["item"], ",").alias("lines"), F.min("l_suppkey").alias("supp"), F.min("l_shipdate").alias("ship"), F.sum("amount").alias("total"))
    header = F.when(k % 3 == 1, F.array(F.struct(F.lit("IGST").alias("tax_name"), F.lit("90.00").alias("tax_amount")), F.struct(F.lit("Cess").alias("tax_name"), F.lit("10.00").alias("tax_amount"))))
    return _bronze(_versions(by, "l_orderkey"), "bills", "l_orderkey", _s(F.concat(F.lit("BILL-"), k), "bill_number"), _s("supp", "vendor_id"), _s(F.concat(F.lit("Vendor "), F.col("supp")), "vendor_name"), _s(F.to_date("ship"), "date"), _s(F.when(k % 4 == 0, F.lit("open")).otherwise(F.lit("paid")), "status"), _s(_currency(k), "currency_code"), _s(total + F.when(F.col("v") == 2, F.lit(100)).otherwise(F.lit(0)), "total"), _s(F.when(k % 4 == 0, total).otherwise(F.lit(0).cast("decimal(18,2)")), "balance"), F.when(k % 3 == 2, F.lit("33.00")).alias("igst"), F.when(k % 6 == 0, F.lit("29ABCDE1234F1Z7")).alias("gst_no"), header.alias("taxes"), line_items="lines")


def _events(spark, sf_dir, kind: str) -> DataFrame:
    return _versions(table(spark, sf_dir, "events").where(F.col("event_type") == kind), "event_id")


def expenses(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return _bronze(_events(spark, sf_dir, "error"), "expenses", "event_id", _s(F.concat(F.lit("EXP-"), k), "expense_number"), _s("user_id", "vendor_id"), _s(F.concat(F.lit("Vendor "), F.col("user_id")), "vendor_name"), _s(F.to_date("ts"), "date"), F.lit("recorded").alias("status"), _s(_currency(k), "currency_code"), _s(_money(F.col("value")), "total"), _s(_money(F.col("value")), "sub_total"), F.when(k % 3 == 0, F.lit("5.00")).alias("tax_amount"), F.when(k % 4 == 0, F.lit("out_of_scope")).alias("gst_treatment"))


def customer_payments(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return _bronze(_events(spark, sf_dir, "purchase"), "customer_payments", "event_id", _s(F.concat(F.lit("PAY-"), k), "payment_number"), _s("user_id", "customer_id"), _s(F.concat(F.lit("Customer "), F.col("user_id")), "customer_name"), _s(F.to_date("ts"), "date"), F.when(k % 2 == 0, F.lit("bank_transfer")).otherwise(F.lit("cash")).alias("payment_mode"), _s(F.concat(F.lit("REF-"), k), "reference_number"), F.lit("paid").alias("status"), _s(_money(F.col("value")), "amount"), _s(_currency(k), "currency_code"))


def journals(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    note = F.when(k % 4 == 0, F.lit("NEFT transfer in")).when(k % 4 == 1, F.lit("accrual entry")).when(k % 4 == 2, F.lit("Bank charges")).otherwise(F.lit("Rebanked stock"))
    return _bronze(_events(spark, sf_dir, "click"), "journals", "event_id", _s(F.concat(F.lit("J/"), k), "journal_number"), F.when(k % 9 != 0, F.to_date("ts").cast("string")).alias("journal_date"), F.when(k % 9 == 3, F.col("ts").cast("string")).alias("created_time"), note.alias("notes"), _s(_money(F.when(k % 3 == 0, -F.col("value")).otherwise(F.col("value"))), "total"), _s(_currency(k), "currency_code"))


def transactions(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return _bronze(_events(spark, sf_dir, "view"), "transactions", "event_id", _s(F.concat(F.lit("T-"), k), "transaction_number"), _s(F.to_date("ts"), "date"), F.lit("posted").alias("status"), F.when(k % 2 == 0, F.lit("deposit")).otherwise(F.lit("withdrawal")).alias("transaction_type"), _s(_money(F.col("value")), "amount"), _s(_currency(k), "currency_code"))


def accounts(spark, sf_dir) -> DataFrame:
    p = _versions(table(spark, sf_dir, "part"), "p_partkey", third=True)
    k, v = F.col("p_partkey"), F.col("v")
    return _bronze(p, "accounts", "p_partkey", _s("p_name", "account_name"), _s(F.concat(F.lit("A"), k), "account_code"), F.when((v == 3) & (k % 3 == 0), F.lit("RECLASSIFIED")).otherwise(F.col("p_type")).alias("account_type"), F.when(k % 2 == 0, F.lit("true")).otherwise(F.lit("false")).alias("is_active"))


def contacts(spark, sf_dir) -> DataFrame:
    c = _versions(table(spark, sf_dir, "customer"), "c_custkey", third=True)
    k, v = F.col("c_custkey"), F.col("v")
    return _bronze(c, "contacts", "c_custkey", _s("c_name", "contact_name"), F.when((v == 2) & (k % 3 == 0), F.lit("MOVED")).otherwise(F.col("c_mktsegment")).alias("company_name"), F.lit("customer").alias("contact_type"), _s(_currency(k), "currency_code"), _s(F.round(F.col("c_acctbal"), 2).cast("decimal(18,2)") + v, "outstanding_receivable_amount"))


def bronze(spark: SparkSession, sf_dir: str, *entities: str) -> DataFrame:
    """The bronze relation of the named entities (default all)."""
    out = None
    for name in entities or ENTITIES:
        part = globals()[name](spark, sf_dir)
        out = part if out is None else out.unionByName(part)
    return out


def bank_lines(spark, sf_dir) -> DataFrame:
    """Bank lines of all orders: shifted days, noisy amounts, other wording."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    amount = F.round(F.col("o_totalprice"), 2) + F.when(k % 3 == 0, F.lit(0.5)).when(k % 3 == 1, F.lit(0.0)).otherwise(F.lit(250.0))
    return o.select(F.concat(F.lit("bank-"), k).alias("bank_line_id"), F.lit("up-1").alias("upload_id"), F.date_add(F.to_date("o_orderdate"), (k % 6).cast("int")).cast("string").alias("bank_date"), F.concat(F.lit("Receipt Customer "), F.col("o_custkey"), F.lit(" INV-"), k).alias("bank_narration"), F.lit(0.0).alias("debit_amount"), amount.alias("credit_amount"), F.lit(None).cast("double").alias("balance_amount"), amount.alias("bank_amount"), k.alias("row_ord"))


def accounting_lines(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("acct-"), k).alias("accounting_record_id"), F.to_date("o_orderdate").cast("string").alias("accounting_date"), F.concat(F.lit("Customer "), F.col("o_custkey")).alias("accounting_party_name"), F.lit("").alias("reference_number"), F.concat(F.lit("INV-"), k).alias("transaction_number"), F.lit("customer_payment").alias("transaction_type"), F.round("o_totalprice", 2).alias("accounting_amount"), F.lit("invoice").alias("source_type"), k.alias("row_ord"))


def _tax_side(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    gstin = F.concat(F.lit("29ABCDE"), F.lpad(F.col("o_custkey").cast("string"), 4, "0"), F.lit("F1Z7"))
    return o.select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice"), 2).alias("taxable"), F.concat(F.lit("Vendor "), F.col("o_custkey")).alias("name"), gstin.alias("gstin"))


def gstr_lines(spark, sf_dir) -> DataFrame:
    s, k = _tax_side(spark, sf_dir), F.col("k")
    number = F.when(k % 5 == 1, F.concat(F.lit("INV/"), k)).when(k % 5 == 2, F.concat(F.lit("25-26/"), k)).otherwise(F.concat(F.lit("INV-"), k))
    taxable = F.col("taxable") + F.when(k % 7 == 3, F.lit(50.0)).otherwise(F.lit(0.0))
    tax = F.round(taxable * 0.18, 2)
    return s.where(k % 11 != 5).select(F.concat(F.lit("g-"), k).alias("gstr_line_id"), F.lit("gu-1").alias("upload_id"), F.col("name").alias("supplier_name"), F.when(k % 13 == 4, F.translate("gstin", "1", "I")).otherwise(F.col("gstin")).alias("gstin"), number.alias("invoice_number"), F.date_add("day", F.when(k % 4 == 1, F.lit(3)).otherwise(F.lit(0))).cast("string").alias("invoice_date"), F.date_format("day", "yyyy-MM").alias("period"), taxable.alias("taxable_value"), tax.alias("igst_amount"), F.lit(0.0).alias("cgst_amount"), F.lit(0.0).alias("sgst_amount"), tax.alias("total_tax"), F.round(taxable + tax, 2).alias("invoice_value"), k.alias("row_ord"))


def books_lines(spark, sf_dir) -> DataFrame:
    s, k = _tax_side(spark, sf_dir), F.col("k")
    tax = F.round(F.col("taxable") * 0.18, 2)
    return s.where(k % 11 != 7).select(F.concat(F.lit("b-"), k).alias("books_record_id"), F.lit("bill").alias("books_source_type"), F.col("name").alias("party_name"), F.col("gstin"), F.concat(F.lit("INV-"), k).alias("invoice_number"), F.col("day").cast("string").alias("books_invoice_date"), F.col("taxable").alias("books_taxable_value"), tax.alias("books_igst_amount"), F.lit(0.0).alias("books_cgst_amount"), F.lit(0.0).alias("books_sgst_amount"), tax.alias("books_tax_amount"), F.round(F.col("taxable") + tax, 2).alias("books_invoice_value"), k.alias("row_ord"))


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the lines of bank statements, one statement a customer, in five layouts by order number; amounts of some go over to the
    next page, whose head stands between."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    sum_, left = F.format_number("o_totalprice", 2), F.format_number(F.col("o_totalprice") + 1000, 2)
    left = F.when(F.col("k") % 6 == 1, F.concat(left, F.lit("-"))).otherwise(left)
    money_x = F.when(F.col("o_orderstatus") == "F", F.lit(361.0)).otherwise(F.lit(446.0))
    first, second = F.date_format("o_orderdate", "MMM d yyyy"), F.date_format("o_orderdate", "dd-MMM-yyyy")

    def line(page: int, *words: tuple) -> Column:
        cells = F.array(*[F.struct(text.alias("text"), F.lit(x).cast("double").alias("x0") if isinstance(x, (int, float)) else x.alias("x0")) for text, x in words])
        return F.struct((F.col("k") * 2 + page).alias("page"), F.array_join(F.transform(cells, lambda w: w["text"]), " ").alias("text"), cells.alias("words"))

    t = lambda x: F.lit(x)
    who, what = F.concat(F.lit("ref"), F.col("k")), F.col("o_orderpriority")
    head = [line(1, (t("DD"), 40), (t("History"), 60), (t("Page"), 90)), line(1, (t("Date"), 40), (t("Transaction"), 70), (t("Narrative"), 120), (t("Debit"), 360), (t("Credit"), 445), (t("Ledger"), 530), (t("Balance"), 560), (t("Value"), 600))]
    layouts = [
        F.array(line(0, (first, 40), (what, 80), (who, 140), (sum_, money_x), (left, 531))),
        F.array(line(0, (second, 40), (what, 80)), *head, line(1, (who, 140), (sum_, money_x), (left, 531))),
        F.array(line(0, (what, 80), (second, 140), (who, 180), (sum_, money_x)), *head, line(1, (left, 531))),
        F.array(line(0, (first, 40), (t("Balance"), 80), (t("B/F"), 120), (left, 531))),
        F.array(line(0, (first, 40), (what, 80)), line(0, (who, 140)), line(0, (t(""), 0)), line(0, (sum_, money_x), (left, 531))),
    ]
    chosen = F.when(F.col("k") % 5 == 0, layouts[0])
    for i, x in enumerate(layouts[1:], 1):
        chosen = chosen.when(F.col("k") % 5 == i, x)
    d = o.select(F.col("o_custkey").cast("string").alias("doc_id"), F.posexplode(chosen).alias("line_no", "x"))
    return d.select("doc_id", "x.page", "line_no", "x.text", "x.words")
