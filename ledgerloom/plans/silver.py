"""Typed silver relations over append-only bronze records: dimensions with history, latest facts, fact histories.

Every relation is declared as a projection of JSON fields; versions, suppression of legacy rows, line aggregates
and currency conversion are shared steps. A bronze scan is filtered by entity first, which prunes partitions when
bronze is stored by entity. Bills and expenses aggregate their line arrays inside the row (no explode, no join):
one document's lines are in one record, so the sums need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import json as J
from ledgerloom.functions.money import with_inr
from ledgerloom.operators.relational import current, drop_legacy, fact_versions, latest, latest_scoped, scd2

LINEAGE = ["run_id", "source_org_key", "source_org_id", "source_org_name", "source_country", "source_currency", "source_record_id", "loaded_at"]


def bronze(df: DataFrame, entity: str) -> DataFrame:
    return df.where(F.col("entity_name") == entity).withColumn("source_org_key", F.coalesce("source_org_key", F.lit("legacy")))


def parsed(df: DataFrame, scalars: list[str], arrays: list[str] = ()) -> DataFrame:
    return df.withColumn("r", J.record(F.col("raw_json"), scalars, list(arrays)))


def t(*names: str) -> Column:
    return J.text("r", *names)


def n(*names: str) -> Column:
    return J.first_number("r", *names)


def d(*names: str) -> Column:
    return F.coalesce(*(J.day(F.col(f"r.`{x}`")) for x in names))


def _currency() -> Column:
    return F.coalesce(t("currency_code"), F.col("source_currency"), F.lit("INR"))


# ---- dimensions

ACCOUNT_FIELDS = ["account_name", "account_code", "account_type", "description", "currency_id", "currency_code", "parent_account_id", "is_active"]
CONTACT_FIELDS = ["contact_name", "company_name", "contact_type", "email", "phone", "gst_no", "gst_treatment", "place_of_contact", "currency_code", "payment_terms", "status"]


def accounts_history(raw: DataFrame) -> DataFrame:
    p = parsed(bronze(raw, "accounts"), [*ACCOUNT_FIELDS, "account_id"]).select(*LINEAGE, F.col("source_record_id").alias("account_id"), *[(J.boolean(t(x)) if x == "is_active" else t(x)).alias(x) for x in ACCOUNT_FIELDS])
    return scd2(p, J.exact_json(*ACCOUNT_FIELDS))


def contacts_history(raw: DataFrame) -> DataFrame:
    """Balances are not part of the change hash: they stay as they were at the last change of an attribute."""
    money = ["outstanding_receivable_amount", "outstanding_payable_amount"]
    p = parsed(bronze(raw, "contacts"), [*CONTACT_FIELDS, *money]).select(*LINEAGE, F.col("source_record_id").alias("contact_id"), *[t(x).alias(x) for x in CONTACT_FIELDS], *[n(x).alias(x) for x in money])
    p = p.withColumn("original_currency", F.coalesce("currency_code", "source_currency", F.lit("INR")))
    return with_inr(scd2(p, J.exact_json(*CONTACT_FIELDS)), money)


def accounts(raw: DataFrame) -> DataFrame:
    return current(accounts_history(raw))


def contacts(raw: DataFrame) -> DataFrame:
    return current(contacts_history(raw))


# ---- facts

_TAX = {"tax_amount": ("tax_total", "tax_amount", "total_tax"), "igst_amount": ("igst", "igst_amount"), "cgst_amount": ("cgst", "cgst_amount"), "sgst_amount": ("sgst", "sgst_amount")}
_GST = {"gstin": ("gst_no", "gstin", "tax_identification_number"), "gst_treatment": ("gst_treatment",)}


def _fields(*groups) -> list[str]:
    out: list[str] = []
    for g in groups:
        for x in g.values() if isinstance(g, dict) else [g]:
            out += x
    return out


def invoices_all(raw: DataFrame) -> DataFrame:
    supply = ("place_of_supply", "place_of_supply_code")
    names = _fields(_TAX, _GST, supply, ("invoice_number", "customer_id", "customer_name", "date", "due_date", "status", "currency_code", "exchange_rate", "total", "sub_total", "taxable_amount", "balance", "reference_number", "notes"))
    p = parsed(bronze(raw, "invoices"), names)
    return p.select(
        *LINEAGE, F.col("source_record_id").alias("invoice_id"), t("invoice_number").alias("invoice_number"), t("customer_id").alias("customer_id"), t("customer_name").alias("customer_name"),
        d("date").alias("invoice_date"), d("due_date").alias("due_date"), t("status").alias("status"), _currency().alias("original_currency"), n("exchange_rate").alias("exchange_rate"),
        n("sub_total").alias("sub_total_amount"), n("taxable_amount", "sub_total").alias("taxable_amount"), *[n(*v).alias(k) for k, v in _TAX.items()],
        n("total").alias("total_amount"), n("balance").alias("balance_amount"), *[t(*v).alias(k) for k, v in _GST.items()], t(*supply).alias("place_of_supply"), t("reference_number").alias("reference_number"), t("notes").alias("notes"),
    )


_LINE = "item_total string, amount string, rate string, quantity string, line_item_taxes array<struct<tax_name:string,tax_amount:string>>"
_NAMED = "tax_name string, tax_amount string"
#: Tax names by kind, as whole words.
_KINDS = {"igst": "IGST|INTEGRATED", "cgst": "CGST|CENTRAL", "sgst": "SGST|STATE"}


def _word(names: str) -> str:
    return f"(^|[^A-Z])({names})([^A-Z]|$)"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("decimal(38,9)"), lambda a, x: (a + F.coalesce(x, F.lit(0).cast("decimal(29,9)"))).cast("decimal(38,9)"))


def with_lines(df: DataFrame) -> DataFrame:
    """``line_taxable``, ``line_tax`` and a tax of each kind from the arrays; NULL without lines (or taxes)."""
    lines = F.transform(F.col("r.line_items"), lambda x: F.from_json(x, _LINE))
    header = F.transform(F.col("r.taxes"), lambda x: F.from_json(x, _NAMED))
    df = df.withColumns({"__lines": lines, "__header": header})
    num = lambda c: J.number(c)
    each = F.transform("__lines", lambda x: F.coalesce(num(x["item_total"]), num(x["amount"]), (num(x["rate"]) * F.coalesce(num(x["quantity"]), F.lit(1).cast("decimal(8,2)"))).cast("decimal(29,9)"), F.lit(0).cast("decimal(29,9)")))
    own = F.flatten(F.transform("__lines", lambda x: F.coalesce(x["line_item_taxes"], F.array().cast("array<struct<tax_name:string,tax_amount:string>>"))))
    taxes = F.when(F.coalesce(F.size("__header"), F.lit(0)) > 0, F.col("__header")).otherwise(own)
    df = df.withColumn("__taxes", taxes)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    name = lambda x: F.upper(F.coalesce(x["tax_name"], F.lit("")))
    amount = lambda c: _sum(F.transform(c, lambda x: num(x["tax_amount"])))
    known = F.exists("__taxes", lambda x: name(x).rlike(_word("|".join(_KINDS.values()))))
    out = {"line_taxable": F.when(some("__lines"), _sum(each)), "line_tax": F.when(some("__taxes"), amount(F.col("__taxes")))}

    def named(words: str):
        return lambda x: name(x).rlike(_word(words))

    for kind, names in _KINDS.items():
        out[f"line_{kind}"] = F.when(some("__taxes") & known, amount(F.filter("__taxes", named(names))))
    return df.withColumns({k: v.cast("decimal(29,9)") for k, v in out.items()}).drop("__lines", "__header", "__taxes")


def _documents(raw: DataFrame, entity: str, prefix: str, numbers: tuple, dates: tuple, totals: tuple) -> DataFrame:
    supply = ("destination_of_supply", "source_of_supply", "place_of_supply", "place_of_supply_code")
    names = _fields(_TAX, _GST, supply, numbers, dates, totals, ("vendor_id", "vendor_name", "due_date", "status", "currency_code", "exchange_rate", "sub_total", "taxable_amount", "balance", "payment_made", "amount_paid", "notes", "description"))
    p = with_lines(parsed(bronze(raw, entity), names, ["line_items", "taxes"]))
    return p.select(
        *LINEAGE, F.col("source_record_id").alias(f"{prefix}_id"), t(*numbers).alias(f"{prefix}_number"), t("vendor_id").alias("vendor_id"), t("vendor_name").alias("vendor_name"),
        d(*dates).alias(f"{prefix}_date"), d("due_date").alias("due_date"), t("status").alias("status"), _currency().alias("original_currency"), n("exchange_rate").alias("exchange_rate"),
        F.coalesce("line_taxable", n("sub_total")).alias("sub_total_amount"), F.coalesce("line_taxable", n("taxable_amount", "sub_total")).alias("taxable_amount"), F.coalesce("line_tax", n(*_TAX["tax_amount"])).alias("tax_amount"),
        *[F.coalesce(f"line_{k}", n(*_TAX[f"{k}_amount"])).alias(f"{k}_amount") for k in _KINDS],
        n(*totals).alias("total_amount"), n("balance").alias("balance_amount"), n("payment_made", "amount_paid").alias("amount_paid"), *[t(*v).alias(k) for k, v in _GST.items()], t(*supply).alias("place_of_supply"), t("notes", "description").alias("notes"),
    )


def bills_all(raw: DataFrame) -> DataFrame:
    return _documents(raw, "bills", "bill", ("bill_number",), ("date",), ("total",))


def expenses_all(raw: DataFrame) -> DataFrame:
    return _documents(raw, "expenses", "expense", ("expense_number", "reference_number", "expense_id"), ("date", "expense_date"), ("total", "amount"))


def journals_all(raw: DataFrame) -> DataFrame:
    p = parsed(bronze(raw, "journals"), ["entry_number", "journal_number", "journal_date", "date", "created_time", "reference_number", "notes", "status", "total", "amount", "debit_total", "currency_code", "exchange_rate"])
    moment = F.coalesce(d("journal_date", "date"), J.day(F.substring(t("created_time"), 1, 10)))
    return p.select(*LINEAGE, F.col("source_record_id").alias("journal_id"), t("entry_number", "journal_number").alias("journal_number"), moment.alias("journal_date"), t("reference_number").alias("reference_number"), t("notes").alias("notes"), t("status").alias("status"), _currency().alias("original_currency"), n("total", "amount", "debit_total").alias("total_amount"))


def payments_all(raw: DataFrame) -> DataFrame:
    p = parsed(bronze(raw, "customer_payments"), ["payment_number", "customer_id", "customer_name", "date", "payment_mode", "reference_number", "status", "amount", "currency_code"])
    return p.select(*LINEAGE, F.col("source_record_id").alias("payment_id"), t("payment_number").alias("payment_number"), t("customer_id").alias("customer_id"), t("customer_name").alias("customer_name"), d("date").alias("payment_date"), t("payment_mode").alias("payment_mode"), t("reference_number").alias("reference_number"), t("status").alias("status"), _currency().alias("original_currency"), n("amount").alias("total_amount"))


def transactions_all(raw: DataFrame) -> DataFrame:
    p = parsed(bronze(raw, "transactions"), ["transaction_number", "entry_number", "journal_number", "date", "transaction_date", "created_time", "reference_number", "status", "amount", "total", "currency_code", "transaction_type", "notes"])
    moment = F.coalesce(d("date", "transaction_date"), J.day(F.substring(t("created_time"), 1, 10)))
    return p.select(*LINEAGE, F.col("source_record_id").alias("transaction_id"), t("transaction_number", "entry_number", "journal_number").alias("transaction_number"), moment.alias("transaction_date"), t("reference_number").alias("reference_number"), t("transaction_type").alias("transaction_type"), t("status").alias("status"), _currency().alias("original_currency"), n("amount", "total").alias("total_amount"), t("notes").alias("notes"))


_MONEY = {"invoices": ["sub_total_amount", "taxable_amount", *_TAX, "total_amount", "balance_amount"], "bills": ["sub_total_amount", "taxable_amount", *_TAX, "total_amount", "balance_amount", "amount_paid"]}
_MONEY["expenses"] = _MONEY["bills"]
#: Entities whose rows without an organisation give way to the same record with one.
_SCOPED = ("bills", "expenses")
_ALL = {"invoices": invoices_all, "bills": bills_all, "expenses": expenses_all, "journals": journals_all, "customer_payments": payments_all, "transactions": transactions_all}


def _money(df: DataFrame, entity: str) -> DataFrame:
    out = with_inr(df, _MONEY.get(entity, ["total_amount"]))
    return out.withColumns({"currency_code": F.col("original_currency"), "original_amount": F.col("total_amount"), "amount_inr": F.col("total_amount_inr")})


def fact(raw: DataFrame, entity: str) -> DataFrame:
    """Latest version of each record, amounts in both currencies. Versions are ranked before any JSON is parsed."""
    rows = raw.where(F.col("entity_name") == entity)
    return _money(_ALL[entity](latest_scoped(rows) if entity in _SCOPED else latest(rows)), entity)


def fact_history(raw: DataFrame, entity: str) -> DataFrame:
    """Every version of invoices, bills or journals; version 1 is the newest."""
    rows = raw.where(F.col("entity_name") == entity)
    return _money(fact_versions(_ALL[entity](drop_legacy(rows) if entity in _SCOPED else rows)), entity)
