"""Consolidated relations in INR over the latest silver facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.relational import roll_up, union_distinct
from ledgerloom.plans import silver

ALL = {"source_org_key": "all", "source_org_name": "All Organizations"}
_ORG = ["source_org_key", "source_org_name", "source_country", "source_currency"]


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def dashboard_summary(raw: DataFrame) -> DataFrame:
    """Counts and totals by organisation, all together first. (The caller adds ``generated_at`` if wanted.)"""
    acc, con = silver.accounts(raw), silver.contacts(raw)
    inv, bil, jou, pay = (silver.fact(raw, x) for x in ("invoices", "bills", "journals", "customer_payments"))
    spine = union_distinct([x.select(*_ORG) for x in (acc, con, inv, bil, jou, pay)])

    def by_org(df: DataFrame, count: str, **sums: str) -> DataFrame:
        return df.groupBy("source_org_key").agg(F.count(F.lit(1)).alias(count), *[F.sum(_known(c)).alias(k) for k, c in sums.items()])

    parts = [
        by_org(acc, "account_count"), by_org(con, "contact_count"),
        by_org(inv, "invoice_count", invoice_total_amount="amount_inr", invoice_outstanding_amount="balance_amount_inr"),
        by_org(bil, "bill_count", bill_total_amount="amount_inr", bill_outstanding_amount="balance_amount_inr"),
        by_org(jou, "journal_count", journal_total_amount="amount_inr"), by_org(pay, "customer_payment_count", customer_payment_total_amount="amount_inr"),
    ]
    out, sums = spine, []
    for p in parts:
        out = out.join(p, "source_org_key", "left")
        sums += p.columns[1:]
    out = out.select(*_ORG, F.lit("INR").alias("reporting_currency"), *[_known(c).alias(c) for c in sums])
    return roll_up(out, sums, ALL | {"source_country": "Consolidated", "source_currency": "Mixed", "reporting_currency": "INR"})


def monthly_pl(raw: DataFrame) -> DataFrame:
    """Revenue, expense, adjustment and profit by organisation and month. One union of the three facts and one aggregation
    replaces spine and joins; a null organisation name makes rows of its own, matched by no other source, so it is kept apart."""
    names = [("invoices", "invoice_date", "invoice_count", "revenue_amount"), ("bills", "bill_date", "bill_count", "expense_amount"), ("journals", "journal_date", "journal_count", "journal_adjustment_amount")]
    rows = None
    for entity, date, count, amount in names:
        f = silver.fact(raw, entity)
        own = f.select("source_org_key", "source_org_name", F.trunc(date, "MM").alias("report_month"), *[(F.lit(1 if c == count else 0)).cast("long").alias(c) for _, _, c, _ in names], *[(_known("amount_inr") if a == amount else F.lit(0)).cast("decimal(38,9)").alias(a) for _, _, _, a in names])
        rows = own if rows is None else rows.unionByName(own)
    keys, sums = ["source_org_key", "source_org_name", "report_month"], [c for _, _, c, _ in names] + [a for _, _, _, a in names]
    # records without a date form groups of their own, dropped here: a filter on the date would parse each record again
    org = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.count("report_month").alias("__dated")).where("__dated > 0").drop("__dated")
    # plain equality never joins null names: such rows show no amounts
    nameless = F.col("source_org_name").isNull()
    org = org.withColumns({c: F.when(nameless, F.lit(0)).otherwise(F.col(c)) for c in sums})
    org = org.withColumn("profit_amount", F.col("revenue_amount") - F.col("expense_amount") + F.col("journal_adjustment_amount")).withColumn("reporting_currency", F.lit("INR"))
    return roll_up(org, [*sums, "profit_amount"], ALL | {"reporting_currency": "INR"}, ["report_month"])


# fixed values: words of a journal that touches the bank
PAYMENT_WORDS = "BANK|HSBC|CASH|PAYMENT|PAID|RECEIPT|RECEIVED|TRANSFER|NEFT|RTGS|IMPS|UPI|ACH|SALARY|TDS|GST|TAX|CHARGES|DC|CR"
_TAIL = ["status", "source_org_key", "source_org_id", "source_org_name", "run_id", "source_record_id", "loaded_at"]


def touches_bank(*columns: str) -> Column:
    joined = F.upper(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    return joined.rlike(f"(^|[^A-Z0-9])({PAYMENT_WORDS})([^A-Z0-9]|$)")


def _ledger(df: DataFrame, source: str, kind: str, **cols: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    base = {"counterparty_id": none, "counterparty_name": none, "reference_number": none, "payment_mode": none} | cols
    money = "decimal(38,9)"
    return df.select(
        F.lit(source).alias("source_type"), F.lit(kind).alias("transaction_type"), base["id"].alias("transaction_id"), base["number"].alias("transaction_number"), base["date"].alias("transaction_date"),
        *[base[k].alias(k) for k in ("counterparty_id", "counterparty_name", "reference_number", "payment_mode")], "currency_code", "original_currency", F.col("original_amount").cast(money).alias("original_amount"),
        base["amount"].cast(money).alias("transaction_amount"), base["amount"].cast(money).alias("transaction_amount_inr"), base["outstanding"].cast(money).alias("outstanding_amount"), *_TAIL,
    )


def bank_ledger(raw: DataFrame) -> DataFrame:
    """All records that can meet a bank line: signed amounts, six sources."""
    c, none, zero = F.col, F.lit(None), F.lit(0)
    inv, bil, pay, jou, exp, tra = (silver.fact(raw, x) for x in ("invoices", "bills", "customer_payments", "journals", "expenses", "transactions"))
    owed, spent = -_known("amount_inr"), -F.abs(c("amount_inr"))
    jou = jou.where(c("journal_date").isNotNull() & c("amount_inr").isNotNull() & (c("amount_inr") != 0) & touches_bank("notes", "reference_number", "journal_number"))
    parts = [
        _ledger(inv, "invoice", "invoice_receivable", id=c("invoice_id"), number=c("invoice_number"), date=c("invoice_date"), counterparty_id=c("customer_id"), counterparty_name=c("customer_name"), reference_number=c("invoice_number"), amount=c("amount_inr"), outstanding=c("balance_amount_inr")),
        _ledger(bil, "bill", "bill_payable", id=c("bill_id"), number=c("bill_number"), date=c("bill_date"), counterparty_id=c("vendor_id"), counterparty_name=c("vendor_name"), reference_number=c("bill_number"), amount=owed, outstanding=c("balance_amount_inr")),
        _ledger(pay, "customer_payment", "customer_payment", id=c("payment_id"), number=c("payment_number"), date=c("payment_date"), counterparty_id=c("customer_id"), counterparty_name=c("customer_name"), reference_number=c("reference_number"), payment_mode=c("payment_mode"), amount=c("amount_inr"), outstanding=zero),
        _ledger(jou, "journal", "journal_adjustment", id=c("journal_id"), number=c("journal_number"), date=c("journal_date"), counterparty_name=c("notes"), reference_number=F.coalesce("reference_number", "journal_number", "notes"), amount=c("amount_inr"), outstanding=none),
        _ledger(exp, "expense", "expense_payment", id=c("expense_id"), number=c("expense_number"), date=c("expense_date"), counterparty_id=c("vendor_id"), counterparty_name=c("vendor_name"), reference_number=c("expense_number"), amount=spent, outstanding=zero),
        _ledger(tra, "transaction", "bank_transaction_or_journal", id=c("transaction_id"), number=c("transaction_number"), date=c("transaction_date"), reference_number=c("reference_number"), amount=c("total_amount"), outstanding=none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calculated_value(suffix: str = "") -> Column:
    """Taxable amount plus tax: the sum of the components unless it is zero, else the tax amount."""
    parts = _known(f"igst_amount{suffix}") + _known(f"cgst_amount{suffix}") + _known(f"sgst_amount{suffix}")
    return F.col(f"taxable_amount{suffix}") + F.coalesce(F.nullif(parts, F.lit(0)), F.col(f"tax_amount{suffix}"), F.lit(0))


def _recalculated(suffix: str = "") -> Column:
    calc, total = calculated_value(suffix), F.col(f"total_amount{suffix}")
    tax = F.coalesce("igst_amount", "cgst_amount", "sgst_amount", f"tax_amount{suffix}").isNotNull()
    return F.col(f"taxable_amount{suffix}").isNotNull() & tax & calc.isNotNull() & (total.isNull() | (F.abs(total - calc) > 1))


def corrected_value(suffix: str = "") -> Column:
    return F.when(_recalculated(suffix), calculated_value(suffix)).otherwise(F.col(f"total_amount{suffix}"))


def gst_relevant() -> Column:
    taxed = (_known("tax_amount") != 0) | (_known("igst_amount") != 0) | (_known("cgst_amount") != 0) | (_known("sgst_amount") != 0)
    treated = ~F.lower(F.coalesce("gst_treatment", F.lit(""))).isin("", "out_of_scope", "non_gst", "non-gst")
    return (F.trim(F.coalesce("gstin", F.lit(""))) != "") | taxed | treated


def gst_ledger(raw: DataFrame) -> DataFrame:
    """All documents that can meet a tax-return line, with the invoice value corrected where it contradicts its parts."""
    out = None
    for entity, one, party in (("invoices", "invoice", "customer"), ("bills", "bill", "vendor"), ("expenses", "expense", "vendor")):
        f = silver.fact(raw, entity)
        if one == "expense":
            f = f.where(gst_relevant())
        own = f.select(
            F.lit(one).alias("source_type"), F.col(f"{one}_id").alias("document_id"), F.col(f"{one}_number").alias("document_number"), F.col(f"{one}_date").alias("document_date"), F.col(f"{party}_id").alias("party_id"), F.col(f"{party}_name").alias("party_name"),
            "gstin", "gst_treatment", "place_of_supply", F.col("taxable_amount").alias("taxable_value"), F.col("taxable_amount_inr").alias("taxable_value_inr"), F.col("igst_amount").alias("igst"), F.col("cgst_amount").alias("cgst"), F.col("sgst_amount").alias("sgst"),
            F.col("tax_amount").alias("total_tax"), F.col("tax_amount_inr").alias("total_tax_inr"), F.col("total_amount").alias("raw_invoice_value"), calculated_value().alias("calculated_invoice_value"), corrected_value().alias("invoice_value"), corrected_value("_inr").alias("invoice_value_inr"),
            F.when(_recalculated(), F.lit("calculated_from_tax_components")).otherwise(F.lit("recorded_total")).alias("invoice_value_source"), "currency_code", "original_currency", *_TAIL,
        )
        out = own if out is None else out.unionByName(own)
    return out
