"""Management P&L: detail candidates, rule classes, month matrix and derived lines."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import json as J
from ledgerloom.functions.money import REPORT_USD, report_inr, short_inr
from ledgerloom.operators.relational import latest
from ledgerloom.plans.periods import Period, month_spine
from ledgerloom.plans.rules import Rule, classify
from ledgerloom.plans.silver import bronze

_LINE = "name string, description string, account_name string, account_id string, account_code string, item_total string, total string, line_total string, amount string, net_amount string, total_amount string, rate string, quantity string"
_DATES = {"invoices": "date", "bills": "date", "journals": "journal_date"}
_SOURCE = {"invoices": "invoice", "bills": "bill", "journals": "journal"}


def _double(c: Column) -> Column:
    return c.try_cast("double")


def line_amount(x: Column) -> Column:
    """First non-zero of the amount fields, else rate x quantity (1 if not given)."""
    parts = [F.nullif(_double(x[c]), F.lit(0.0)) for c in ("item_total", "total", "line_total", "amount", "net_amount", "total_amount")]
    return F.coalesce(*parts, _double(x["rate"]) * F.coalesce(_double(x["quantity"]), F.lit(1.0)), F.lit(0.0))


def details(raw: DataFrame, entity: str, start: date, end: date, per_org: bool = True) -> DataFrame:
    """One row per amount that a rule can take: header amounts of invoices; lines of bills and journals if any has an
    amount, else the header. Rows: source_type, document, month, amount_inr, header_text, line_text, all_text, account ids and codes.

    ``per_org=False`` ranks versions by record alone and filters the day first, as the first form of this report did.
    """
    df = bronze(raw, entity)
    fields = [f"{_SOURCE[entity]}_number", "customer_name", "vendor_name", _DATES[entity], "currency_code", "exchange_rate", "total", "notes", "reference_number"]
    record, day = J.record(F.col("raw_json"), fields, ["line_items"]), J.day(F.col(f"r.`{_DATES[entity]}`"))
    parsed = lambda x: x.withColumn("r", record).withColumn("__day", day).where(F.col("__day").between(F.lit(start), F.lit(end)))
    df = parsed(latest(df)) if per_org else latest(parsed(df), [F.col("source_record_id")])
    total = F.coalesce(_double(J.text("r", "total")), F.lit(0.0))
    lines = F.transform(F.coalesce("r.line_items", F.array().cast("array<string>")), lambda x: F.from_json(x, _LINE))
    amounts = F.transform(lines, line_amount)
    single = (F.size(lines) == 1) & (F.element_at(amounts, 1) == 0)
    header = F.array(F.struct(total.alias("amount"), F.lit("").alias("line_text"), F.array().cast("array<string>").alias("account_ids"), F.array().cast("array<string>").alias("account_codes")))
    known = lambda c: F.filter(F.array(c), lambda y: y.isNotNull())
    own = F.transform(lines, lambda x: F.struct(line_amount(x).alias("amount"), F.lower(F.concat_ws(" ", x["name"], x["description"], x["account_name"])).alias("line_text"), known(x["account_id"]).alias("account_ids"), known(x["account_code"]).alias("account_codes")))
    use = (F.lit(entity) != "invoices") & F.exists(amounts, lambda a: a != 0) & ~single
    text = F.lower(F.concat_ws(" ", *[F.coalesce(J.text("r", c), F.lit("")) for c in fields if c not in (_DATES[entity], "currency_code", "exchange_rate", "total")]))
    out = df.select(F.lit(_SOURCE[entity]).alias("source_type"), "source_record_id", "source_org_key", F.trunc("__day", "MM").alias("report_month"), J.text("r", "currency_code").alias("currency"), _double(J.text("r", "exchange_rate")).alias("rate"), text.alias("header_text"), F.explode(F.when(use, own).otherwise(header)).alias("x"))
    amount = report_inr(F.col("x.amount"), F.col("currency"), F.col("rate"))
    return out.select("source_type", "source_record_id", "source_org_key", "report_month", amount.alias("amount_inr"), "header_text", F.col("x.line_text").alias("line_text"), F.concat_ws(" ", "header_text", "x.line_text").alias("all_text"), F.col("x.account_ids").alias("account_ids"), F.col("x.account_codes").alias("account_codes"))


def all_details(raw: DataFrame, period: Period, per_org: bool = True) -> DataFrame:
    out = None
    for entity in _SOURCE:
        part = details(raw, entity, period.start, period.end, per_org)
        out = part if out is None else out.unionByName(part)
    return out


def matrix(candidates: DataFrame, rules: list[Rule], period: Period) -> DataFrame:
    """(category, report_month, amount) with zeros for months without rows; unclassified amounts are left out."""
    sums = classify(candidates, rules).where("category IS NOT NULL").groupBy("category", "report_month").agg(F.round(F.sum("amount_inr"), 2).alias("amount"))
    spine = month_spine(candidates.sparkSession, period).select("report_month")
    names = candidates.sparkSession.createDataFrame([(r.name,) for r in rules], "category string")
    grid = F.broadcast(names.crossJoin(spine))  # rules x months of the report
    return grid.join(sums, ["category", "report_month"], "left").select("category", "report_month", F.coalesce("amount", F.lit(0.0)).alias("amount"))


def wide(m: DataFrame, period: Period) -> DataFrame:
    """A column per month, ready for display."""
    labels = [x.strftime("%b-%y") for x in period.months]
    return m.withColumn("label", F.date_format("report_month", "MMM-yy")).groupBy("category").pivot("label", labels).agg(F.round(F.sum("amount"), 2))


@dataclass(frozen=True)
class CostModel:
    """Fixed values of the cost model: the consultant's fee a month in USD and its share in COGS from ``split_from`` on, technology a month."""

    consultant_usd: float = 12_500.0
    technology: float = 25_800.0
    rate: float = REPORT_USD
    split: float = 0.5
    split_from: date = date(2025, 9, 1)

    def consultant(self) -> float:
        return round(self.consultant_usd * self.rate, 2)


#: Line item -> label of the monthly sheet, in order (fixed values).
LABELS = {
    "services_revenue": "Client Revenue - Professional Services", "product_revenue": "Client Revenue - Product", "other_income": "Other Income", "offshore_cogs": "Offshore COGS", "onshore_cogs": "Onshore COGS", "technology_costs": "Technology Costs", "cogs_total": "COGS Total",
    "consultant_sm": "Onshore Consultant Experience", "advertising_marketing": "Advertising & Marketing", "travel_expenses": "Travel Expenses", "meals_entertainment": "Meals & Entertainment", "rd_salaries": "R&D Salaries", "consultant_expense": "Consultant & Contractor Expense",
    "software_subscriptions": "Software Subs", "rent": "Office Rent", "it_internet": "IT & Internet", "legal": "Legal", "audit_non_operating": "Audit & Non-Op", "other_ga": "Other G&A",
}
REVENUE = ["services_revenue", "product_revenue", "other_income"]
DERIVED = ["offshore_cogs", "onshore_cogs", "technology_costs", "cogs_total", "consultant_sm", "other_ga"]
EXPENSES = [k for k in LABELS if k not in (*REVENUE, "offshore_cogs", "onshore_cogs", "technology_costs")]


def cogs_detail(candidates: DataFrame, rows: list[Rule], period: Period, model: CostModel = CostModel()) -> DataFrame:
    """(category, report_month, amount): the delivery rows that rules find in bills and journals, the consultant's share and the technology costs."""
    found = matrix(candidates.where(F.col("source_type").isin("bill", "journal")), rows, period)
    months = month_spine(candidates.sparkSession, period).select("report_month")
    share = F.when(F.col("report_month") >= F.lit(model.split_from), F.lit(round(model.consultant() * model.split, 2))).otherwise(F.lit(0.0))
    fixed = months.select(F.explode(F.array(F.struct(F.lit("consultant").alias("category"), share.alias("amount")), F.struct(F.lit("technology_costs").alias("category"), F.lit(round(model.technology, 2)).alias("amount")))).alias("x"), "report_month")
    return found.unionByName(fixed.select("x.category", "report_month", "x.amount"))


def line_items(m: DataFrame, detail: DataFrame, offshore: list[str], onshore: list[str], delivery: list[str], groups: dict[str, list[str]], model: CostModel = CostModel()) -> DataFrame:
    """One row a month: revenue and expense lines from the matrix (``groups``: line -> categories), cost of delivery from
    ``detail`` (categories ``offshore`` and ``onshore``), and what remains of the ``delivery`` categories as other G&A, not below 0."""
    total = lambda names: F.round(F.coalesce(F.sum(F.when(F.col("category").isin(*names), F.col("amount"))), F.lit(0.0)), 2) if names else F.lit(0.0)
    own = m.groupBy("report_month").agg(*[total(groups.get(k, [])).alias(k) for k in LABELS if k not in DERIVED], total(delivery).alias("delivery"))
    cost = detail.groupBy("report_month").agg(total(offshore).alias("offshore_cogs"), total([*onshore, "consultant"]).alias("onshore_cogs"), total(["technology_costs"]).alias("technology_costs"))
    d = own.join(F.broadcast(cost), "report_month")  # a row per month of the report
    fee = model.consultant()
    d = d.withColumns({
        "cogs_total": F.round(F.col("offshore_cogs") + F.col("onshore_cogs") + F.col("technology_costs"), 2),
        "consultant_sm": F.when(F.col("report_month") < F.lit(model.split_from), F.lit(fee)).otherwise(F.lit(round(fee * model.split, 2))),
        "other_ga": F.greatest(F.lit(0.0), F.round(F.col("delivery") - F.col("offshore_cogs"), 2)),
    })
    plus = lambda names: sum((F.col(c) for c in names), F.lit(0.0))
    d = d.withColumns({"total_revenue": F.round(plus(REVENUE), 2), "total_expenses": F.round(plus(EXPENSES), 2)})
    d = d.withColumns({"gross_profit": F.round(F.col("total_revenue") - F.col("cogs_total"), 2), "operating_profit": F.round(F.col("total_revenue") - F.col("total_expenses"), 2)})
    return d.select("report_month", *LABELS, "total_revenue", "total_expenses", "gross_profit", "operating_profit", F.try_divide("gross_profit", "total_revenue").alias("gross_margin"))


def _long(d: DataFrame) -> DataFrame:
    order = F.create_map(*[F.lit(x) for i, k in enumerate(LABELS) for x in (k, i)])
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return d.unpivot(["report_month"], list(LABELS), "item", "amount").withColumns({"row_ord": order[F.col("item")], "Line Item": label[F.col("item")]})


def monthly_sheet(d: DataFrame, period: Period) -> DataFrame:
    """The line items in order, a column per month."""
    labels = [x.strftime("%b-%y") for x in period.months]
    return _long(d).withColumn("m", F.date_format("report_month", "MMM-yy")).groupBy("row_ord", "Line Item").pivot("m", labels).agg(F.round(F.sum("amount"), 2)).orderBy("row_ord").drop("row_ord")


def quarterly_sheet(d: DataFrame) -> DataFrame:
    """(Line Item, quarter, amount, share of the quarter's revenue), quarters of the April-to-March year."""
    quarter = F.concat(F.lit("Q"), (F.floor(F.pmod(F.month("report_month") - 4, F.lit(12)) / 3) + 1).cast("string"))
    q = _long(d).withColumn("quarter", quarter).groupBy("row_ord", "item", "Line Item", "quarter").agg(F.round(F.sum("amount"), 2).alias("amount"))
    revenue = F.sum(F.when(F.col("item").isin(*REVENUE), F.col("amount"))).over(W.partitionBy("quarter"))  # nineteen rows a quarter
    return q.withColumn("revenue_share", F.try_divide("amount", revenue)).orderBy("row_ord", "quarter").select("Line Item", "quarter", "amount", "revenue_share")


def metrics(d: DataFrame) -> DataFrame:
    """(metric, value, shown): revenue, expenses, profit and gross profit of the report's months."""
    s = d.agg(*[F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2).alias(c) for c in ("total_revenue", "total_expenses", "operating_profit", "gross_profit")])
    return s.toDF("Revenue", "Expenses", "Profit", "Gross Profit").unpivot([], ["Revenue", "Expenses", "Profit", "Gross Profit"], "metric", "value").withColumn("shown", short_inr(F.col("value")))


def report(raw: DataFrame, rules: list[Rule], cogs_rules: list[Rule], period: Period, offshore: list[str], onshore: list[str], delivery: list[str], groups: dict[str, list[str]], model: CostModel = CostModel(), stage=None) -> dict[str, DataFrame]:
    """The sheets of the management report. ``stage``: called with a message at the start of each part."""
    say = stage or (lambda message: None)
    say("Reading documents")
    found = all_details(raw, period)
    say("Classifying amounts")
    m, detail = matrix(found, rules, period), cogs_detail(found, cogs_rules, period, model)
    say("Deriving line items")
    d = line_items(m, detail, offshore, onshore, delivery, groups, model)
    return {"Monthly P&L": monthly_sheet(d, period), "Quarterly P&L": quarterly_sheet(d), "COGS Detail": wide(detail, period), "Key Metrics": metrics(d)}


def run_rate(d: DataFrame, column: str) -> DataFrame:
    """Mean of the last three months of each month. One row per month: a single small partition."""
    w = W.orderBy("report_month").rowsBetween(-2, 0)
    return d.withColumn("run_rate", F.avg(column).over(w))


def peak_quarter(d: DataFrame) -> DataFrame:
    """(quarter, gross_margin) of the quarter with the highest gross margin; of equal ones the first."""
    q, item = quarterly_sheet(d), F.col("Line Item")
    total = lambda *keys: F.sum(F.when(item.isin(*[LABELS[k] for k in keys]), F.col("amount")))
    by = q.groupBy("quarter").agg(total(*REVENUE).alias("revenue"), total("cogs_total").alias("cogs"))
    by = by.withColumn("gross_margin", F.try_divide(F.col("revenue") - F.col("cogs"), F.col("revenue"))).where("gross_margin IS NOT NULL")
    return by.agg(F.min_by("quarter", F.struct(-F.col("gross_margin"), "quarter")).alias("quarter"), F.max("gross_margin").alias("gross_margin")).where("quarter IS NOT NULL")
