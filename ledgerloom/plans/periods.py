"""Reporting periods on the April-to-March year."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    label: str
    start: date
    end: date
    months: tuple[date, ...] = field(default=())


def month_end(d: date) -> date:
    return d.replace(day=calendar.monthrange(d.year, d.month)[1])


def year_start(text: str | int | date) -> int:
    """First calendar year of ``FY 2025-26``, ``2025-2026``, ``FY25``, a year or a date."""
    if isinstance(text, date):
        return text.year if text.month >= 4 else text.year - 1
    found = re.search(r"(?:19|20)\d{2}", str(text)) or re.search(r"\d{2}", str(text))
    if not found:
        raise ValueError(f"no financial year in {text!r}")
    year = int(found[0])
    return year if year > 99 else 2000 + year


def fy_label(start: int) -> str:
    return f"FY {start}-{(start + 1) % 100:02d}"


def _add(d: date, months: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    return date(y, m + 1, 1)


def _span(first: date, n: int, label: str) -> Period:
    months = tuple(_add(first, k) for k in range(n))
    return Period(label, first, month_end(months[-1]), months)


def months(fy: int) -> list[Period]:
    return [_span(_add(date(fy, 4, 1), k), 1, _add(date(fy, 4, 1), k).strftime("%b-%y")) for k in range(12)]


def quarters(fy: int) -> list[Period]:
    return [_span(_add(date(fy, 4, 1), 3 * k), 3, f"Q{k + 1} {fy_label(fy)}") for k in range(4)]


def halves(fy: int) -> list[Period]:
    return [_span(_add(date(fy, 4, 1), 6 * k), 6, f"H{k + 1} {fy_label(fy)}") for k in range(2)]


def custom(start: date, end: date) -> Period:
    if end < start:
        raise ValueError("the period ends before it starts")
    first, n = start.replace(day=1), (end.year - start.year) * 12 + end.month - start.month + 1
    return Period(f"{start:%d %b %Y} - {end:%d %b %Y}", start, end, tuple(_add(first, k) for k in range(n)))


def select(kind: str, fy: str | int, index: int = 1, start: date | None = None, end: date | None = None) -> Period:
    """``year``, ``half``, ``quarter``, ``month`` (with a 1-based index) or ``custom``."""
    year = year_start(fy)
    if kind == "custom":
        if start is None or end is None:
            raise ValueError("a custom period needs both dates")
        return custom(start, end)
    if kind == "year":
        return _span(date(year, 4, 1), 12, fy_label(year))
    found = {"half": halves, "quarter": quarters, "month": months}[kind](year)
    if not 1 <= index <= len(found):
        raise ValueError(f"{kind} {index} is not in 1..{len(found)}")
    return found[index - 1]


def month_spine(spark: SparkSession, period: Period) -> DataFrame:
    """(report_month, month_label) of the period's months."""
    a, b = period.months[0], period.months[-1]
    return spark.range(1).select(F.explode(F.sequence(F.lit(a), F.lit(b), F.expr("INTERVAL 1 MONTH"))).alias("report_month")).withColumn("month_label", F.date_format("report_month", "MMM-yy"))
