"""Vendor extract: bills, transactions and contacts behind optional filters, and the option lists of those filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.relational import present, where_given

BILLS = {"bill_date": "Bill Date", "bill_number": "Bill Number", "vendor_name": "Vendor", "status": "Status", "currency_code": "Currency", "total_amount": "Total", "amount_inr": "Total INR", "balance_amount": "Balance", "source_org_name": "Organization"}
TRANSACTIONS = {"transaction_date": "Date", "transaction_number": "Number", "transaction_type": "Type", "status": "Status", "currency_code": "Currency", "transaction_amount": "Amount", "source_org_name": "Organization"}


def _filtered(df: DataFrame, date: str, start=None, end=None, organization=None, vendor=None, status=None) -> DataFrame:
    given = lambda c, v, test: test if v is not None and c in df.columns else None
    return where_given(
        df,
        start=given(date, start, F.col(date) >= F.lit(start)),
        end=given(date, end, F.col(date) <= F.lit(end)),
        organization=given("source_org_name", organization, F.col("source_org_name") == organization),
        vendor=given("vendor_name", vendor, F.col("vendor_name") == vendor) if "vendor_name" in df.columns else None,
        status=given("status", status, F.lower("status") == str(status).lower()),
    )


def report(bills: DataFrame, transactions: DataFrame, contacts: DataFrame, **filters) -> dict[str, DataFrame]:
    """Sheet name -> rows under display labels; columns that a source lacks are NULL."""
    show = lambda df, cols: df.select(*[present(df, c).alias(label) for c, label in cols.items()])
    b = _filtered(bills, "bill_date", **filters).orderBy(F.col("bill_date").desc(), "bill_number")
    t = _filtered(transactions, "transaction_date", **{k: v for k, v in filters.items() if k != "vendor"}).orderBy(F.col("transaction_date").desc(), "transaction_number")
    summary = b.groupBy("vendor_name", "source_org_name").agg(F.count(F.lit(1)).alias("bill_count"), F.sum("amount_inr").alias("total_inr"), F.sum("balance_amount_inr").alias("balance_inr"))
    names = contacts.select("contact_name", "contact_type", "source_org_name").distinct()
    return {"Summary": summary, "Bills": show(b, BILLS), "Transactions": show(t, TRANSACTIONS), "Contacts": names}


def filter_options(bills: DataFrame, transactions: DataFrame, contacts: DataFrame) -> DataFrame:
    """(option_type, options): sorted distinct values of organisation, vendor and status."""
    o = lambda df, kind, c: df.select(F.lit(kind).alias("option_type"), F.trim(F.col(c)).alias("value"))
    parts = [o(bills, "organization", "source_org_name"), o(transactions, "organization", "source_org_name"), o(contacts, "organization", "source_org_name"), o(bills, "vendor", "vendor_name"), o(bills, "status", "status"), o(transactions, "status", "status")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value IS NOT NULL AND value != ''").distinct().groupBy("option_type").agg(F.array_sort(F.collect_set("value")).alias("options"))
