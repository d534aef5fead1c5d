"""Consolidated P&L and balance sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.relational import as_of
from ledgerloom.plans import silver

# fixed values: spellings of the balance sheet's lines in long sheets (letters only), and columns of wide ones
LONG = {
    "bank_cash": ["bankcash", "cash", "bank"],
    "receivables": ["receivables", "accountsreceivable"],
    "other_assets": ["otherassets"],
    "payables": ["payables", "accountspayable"],
    "tax_liabilities": ["taxliabilities"],
    "equity_retained_earnings": ["equity", "retainedearnings", "equityretainedearnings"],
}
WIDE = {
    "bank_cash": ["bank_cash", "cash_amount", "bank_balance_amount"],
    "receivables": ["receivables", "receivables_amount", "invoice_outstanding_amount"],
    "other_assets": ["other_assets", "other_assets_amount"],
    "payables": ["payables", "payables_amount", "bill_outstanding_amount"],
    "tax_liabilities": ["tax_liabilities", "tax_liability_amount"],
    "equity_retained_earnings": ["equity_retained_earnings", "retained_earnings", "equity_amount"],
}


def profit_and_loss(monthly: DataFrame, org: str = "all") -> DataFrame:
    """One row: revenue, expense, other income and expense from the sign of adjustments, profit."""
    rows = monthly.where(F.col("source_org_key") == org)
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return rows.agg(
        F.coalesce(F.sum(z("revenue_amount")), F.lit(0.0)).alias("revenue"), F.coalesce(F.sum(z("expense_amount")), F.lit(0.0)).alias("expenses"),
        F.coalesce(F.sum(F.greatest(z("journal_adjustment_amount"), F.lit(0.0))), F.lit(0.0)).alias("other_income"), F.coalesce(F.abs(F.sum(F.least(z("journal_adjustment_amount"), F.lit(0.0)))), F.lit(0.0)).alias("other_expense"),
    ).withColumn("net_profit", F.round(F.col("revenue") + F.col("other_income") - F.col("expenses") - F.col("other_expense"), 2))


def operating(values: DataFrame, cogs: float) -> DataFrame:
    """Operating expenses are what remains of the expenses, not below 0."""
    return values.withColumn("cogs", F.lit(cogs)).withColumn("operating_expenses", F.greatest(F.col("expenses") - F.col("cogs") - F.col("other_expense"), F.lit(0.0)))


def open_items(raw: DataFrame, day) -> DataFrame:
    """(line, amount): receivables and payables up to a day, from the balances of invoices and bills."""
    out = None
    for entity, date, line in (("invoices", "invoice_date", "receivables"), ("bills", "bill_date", "payables")):
        part = silver.fact(raw, entity).where(F.col(date) <= F.lit(day)).agg(F.coalesce(F.sum("balance_amount_inr"), F.lit(0)).cast("double").alias("amount")).select(F.lit(line).alias("line"), "amount")
        out = part if out is None else out.unionByName(part)
    return out


def balance_sheet(snapshots: DataFrame, day, date: str = "as_of_date") -> DataFrame:
    """(line, amount) of the latest snapshot up to ``day``; lines without an amount are NULL.

    Long sheets have ``line_item`` and ``amount_inr`` (or ``amount``); lines that these lack are taken from wide
    columns, of which the first with an amount counts."""
    rows = as_of(snapshots, date, day) if date in snapshots.columns else snapshots
    number = lambda c: F.col(c).try_cast("double")
    wide = {line: [c for c in names if c in rows.columns] for line, names in WIDE.items()}
    aggs = [F.coalesce(*[F.sum(number(c)) for c in cols], F.lit(None).cast("double")).alias(line) for line, cols in wide.items()]
    known = rows.agg(*aggs).unpivot([], list(WIDE), "line", "amount")
    amount = next((c for c in ("amount_inr", "amount") if c in rows.columns), None)
    if "line_item" in rows.columns and amount:
        key = F.regexp_replace(F.lower(F.coalesce("line_item", F.lit(""))), "[^a-z]", "")
        case = reduce(lambda acc, kv: acc.when(key.isin(*kv[1]), F.lit(kv[0])), LONG.items(), F)
        long = rows.withColumn("line", case.otherwise(F.lit(None))).where("line IS NOT NULL").groupBy("line").agg(F.sum(number(amount)).alias("given"))
        known = known.join(F.broadcast(long), "line", "left").select("line", F.coalesce("given", "amount").alias("amount"))  # six lines at most
    return known


def balance_totals(lines: DataFrame) -> DataFrame:
    s = lambda *names: F.sum(F.when(F.col("line").isin(*names), F.col("amount")).otherwise(F.lit(0.0)))
    lines = lines.withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    out = lines.agg(s("bank_cash", "receivables", "other_assets").alias("total_assets"), s("payables", "tax_liabilities").alias("total_liabilities"), s("equity_retained_earnings").alias("equity"))
    return out.withColumn("difference", F.round(F.col("total_assets") - F.col("total_liabilities") - F.col("equity"), 2))
