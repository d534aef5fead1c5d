"""JSON fields of raw records.

A record is parsed once, by ``from_json`` with the wanted fields as strings; Catalyst prunes the fields that a
query doesn't use. Objects and arrays are not scalars: they read as NULL. Casts never raise.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(29,9)"


def record(raw: Column, scalars: list[str], arrays: list[str] = ()) -> Column:
    """One struct with the named fields: strings, and arrays of JSON strings."""
    ddl = [f"`{x}` string" for x in dict.fromkeys(scalars)] + [f"`{x}` array<string>" for x in arrays]
    return F.from_json(raw, ", ".join(ddl))


def scalar(text: Column) -> Column:
    return F.when(~F.substring(F.ltrim(text), 1, 1).isin("{", "["), text)


def text(rec: str, *names: str) -> Column:
    """First field that is there."""
    return F.coalesce(*(scalar(F.col(f"{rec}.`{n}`")) for n in names))


def number(value: Column) -> Column:
    return value.try_cast(MONEY)


def first_number(rec: str, *names: str) -> Column:
    return F.coalesce(*(number(scalar(F.col(f"{rec}.`{n}`"))) for n in names))


def day(value: Column) -> Column:
    """Only whole dates: a bare year or month is no date, nor is an object or array. ``value`` stands here once: a filter on a day
    copies the parse of the record for each time that it does."""
    return F.regexp_extract(value, r"^(\d{4}-\d{1,2}-\d{1,2})$", 1).try_cast("date")


def boolean(value: Column) -> Column:
    return F.when(F.lower(value) == "true", F.lit(True)).when(F.lower(value) == "false", F.lit(False))


def exact_json(*columns: Column) -> Column:
    """JSON of a struct with null fields kept: equal text if and only if all fields are equal."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
