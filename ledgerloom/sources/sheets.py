"""Uploaded sheets: header detection, alias columns and clean-up for bank statements and tax returns.

A sheet is a relation (sheet, row_idx, cells array<string>), whichever reader made it; text files are read by
Spark. Header rows are found by scores over the first rows of each sheet, in SQL; the best sheet and row win.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.money import bank_number, to_money
from ledgerloom.sources.ingest import parse_day, period_month

# fixed values: spellings of the columns
BANK = {
    "transaction_date": ["txn date", "transaction date", "date", "value date", "trans date", "posting date"],
    "narration": ["description", "narration", "particulars", "transaction details", "transaction detail", "details", "remarks"],
    "debit_amount": ["withdrawal", "withdrawals", "debit", "debit amount", "paid out", "withdrawal amt", "dr amount", "dr"],
    "credit_amount": ["deposit", "deposits", "credit", "credit amount", "paid in", "deposit amt", "cr amount", "cr"],
    "balance_amount": ["balance", "closing balance", "running balance", "amount balance", "balance amount", "available balance"],
    "amount": ["amount", "transaction amount", "txn amount", "transaction amt"],
    "reference_number": ["reference number", "reference no", "ref no", "cheque no", "chq no", "utr"],
}
GSTR = {
    "supplier_gstin": ["gstin", "gst number", "gst no", "gstin of supplier", "gstin/uin of supplier", "gstin/uin of the supplier", "supplier gstin", "supplier_gstin"],
    "supplier_name": ["trade/legal name", "trade legal name", "supplier name", "legal name", "trade name"],
    "invoice_number": ["invoice number", "invoice no", "invoice no.", "invoice num", "invoice_number", "inum"],
    "invoice_date": ["invoice date", "invoice dt", "invoice_date", "idt"],
    "invoice_value": ["invoice value", "invoice value(₹)", "invoice value (₹)", "invoice value rs", "invoice value inr", "val"],
    "taxable_value": ["taxable value", "taxable value(₹)", "taxable value (₹)", "taxable amount", "taxable value rs", "taxable value inr", "txval"],
    "igst_amount": ["integrated tax", "integrated tax(₹)", "integrated tax (₹)", "integrated tax amount", "igst", "igst amount", "iamt"],
    "cgst_amount": ["central tax", "central tax(₹)", "central tax (₹)", "central tax amount", "cgst", "cgst amount", "camt"],
    "sgst_amount": ["state/ut tax", "state/ut tax(₹)", "state/ut tax (₹)", "state tax", "state tax amount", "sgst", "sgst amount", "samt"],
    "cess_amount": ["cess", "cess(₹)", "cess (₹)", "cess amount", "csamt"],
    "place_of_supply": ["place of supply", "pos"],
    "period": ["return period", "filing period", "tax period", "period"],
    "invoice_type": ["invoice type"],
    "reverse_charge": ["supply attract reverse charge", "reverse charge"],
}
#: Columns of the stored uploads that may come along under their own names.
STORED = {"value_date": ["value date"], "total_tax": ["total tax"]}


def alias_key(text: str | None) -> str:
    key = "".join(c for c in (text or "").lower() if c.isascii() and c.isalnum())
    return "" if key.startswith("unnamed") else key


def _key(c: Column) -> Column:
    k = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    return F.when(k.startswith("unnamed"), F.lit("")).otherwise(k)


def text_sheet(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A delimited text file as a sheet, all cells text, rows in file order. (One statement is one small file.)"""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("sheet"), F.posexplode(F.split("value", r"\r?\n")).alias("row_idx", "line"))
    cells = F.transform(F.regexp_extract_all("line", F.lit(rf'(?:^|{delimiter})("(?:[^"]|"")*"|[^{delimiter}]*)'), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')))
    return rows.where(F.trim("line") != "").select("sheet", "row_idx", cells.alias("cells"))


def from_rows(spark: SparkSession, sheets: dict[str, list[list]]) -> DataFrame:
    """Sheets given as lists of rows (what a spreadsheet reader yields)."""
    rows = [(name, i, [None if c is None else str(c) for c in r]) for name, body in sheets.items() for i, r in enumerate(body)]
    return spark.createDataFrame(rows, "sheet string, row_idx int, cells array<string>")


def _scores(kind: str, names: Column) -> tuple[Column, Column]:
    has = lambda n: F.array_contains(names, n)
    one = lambda c: c.cast("int")
    if kind == "bank":
        money = (has("debit_amount") & has("credit_amount")) | has("amount") | has("debit_amount") | has("credit_amount")
        score = F.size(names) + 2 * one(has("narration")) + 2 * one(has("debit_amount") & has("credit_amount")) + one(has("amount")) + one(has("balance_amount"))
        return score, has("transaction_date") & money
    amount = has("taxable_value") | has("invoice_value") | has("total_tax") | has("igst_amount")
    score = F.size(names) + 2 * one(has("invoice_number")) + 2 * one(has("supplier_gstin")) + 2 * one(has("taxable_value"))
    return score, has("invoice_number") & (has("supplier_gstin") | has("supplier_name") | amount)


def header_of(sheets: DataFrame, kind: str) -> DataFrame:
    """(sheet, row_idx, cells) of the best header: highest score, then first sheet, then first row."""
    aliases, rows = (BANK, 30) if kind == "bank" else (GSTR, 50)
    spelled = sorted({(alias_key(a), n) for n, names in aliases.items() for a in names})
    cell = sheets.where(F.col("row_idx") < rows).withColumn("cell", F.explode("cells")).withColumn("k", _key(F.col("cell")))
    table = F.broadcast(sheets.sparkSession.createDataFrame(spelled, "k string, name string"))
    found = cell.join(table, "k").groupBy("sheet", "row_idx").agg(F.collect_set("name").alias("names"), F.first("cells").alias("cells"))
    score, fit = _scores(kind, F.col("names"))
    return found.where(fit).withColumn("score", score).orderBy(F.desc("score"), "sheet", "row_idx").limit(1).select("sheet", "row_idx", "cells")


def body(sheets: DataFrame, kind: str) -> DataFrame:
    """The rows below the header under their standard names; of two columns with one name the first filled cell counts."""
    head = header_of(sheets, kind).first()
    if head is None:
        raise ValueError("no header row was found")
    aliases = (BANK if kind == "bank" else GSTR) | STORED
    keys = {n: {alias_key(a) for a in names} for n, names in aliases.items()}
    places: dict[str, list[int]] = {}
    for i, text in enumerate(head["cells"]):
        for name in (n for n in aliases if alias_key(text) in keys[n]):
            places.setdefault(name, []).append(i)
    rows = sheets.where((F.col("sheet") == head["sheet"]) & (F.col("row_idx") > head["row_idx"]))
    cell = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    cols = [F.coalesce(*[cell(i) for i in places[n]]).alias(n) if n in places else F.lit(None).cast("string").alias(n) for n in aliases]
    return rows.select("row_idx", *cols).na.drop("all", subset=list(places))


def bank_statement(sheets: DataFrame) -> DataFrame:
    """Statement lines: signed amounts split into debit and credit, rows without day or narration dropped."""
    b = body(sheets, "bank")
    amount = bank_number(F.col("amount"))
    debit, credit = F.abs(to_money(F.col("debit_amount"))), F.abs(to_money(F.col("credit_amount")))
    none = F.col("amount").isNotNull() & (debit == 0) & (credit == 0)
    zero = F.lit(0).cast("decimal(38,2)")
    out = b.withColumns({"d": F.when(none & (amount < 0), -amount).otherwise(debit), "c": F.when(none & (amount > 0), amount).otherwise(credit), "day": parse_day(F.col("transaction_date"))})
    out = out.where(F.col("day").isNotNull() & F.col("narration").isNotNull())
    rank = F.row_number().over(W.orderBy("row_idx")).cast("long")
    return out.select(rank.alias("raw_row_number"), F.col("day").alias("transaction_date"), parse_day(F.col("value_date")).alias("value_date"), "narration", F.coalesce("d", zero).alias("debit_amount"), F.coalesce("c", zero).alias("credit_amount"), F.when(F.col("balance_amount").isNotNull(), bank_number(F.col("balance_amount"))).alias("balance_amount"), "reference_number")


def tax_return(sheets: DataFrame) -> DataFrame:
    """Return lines: missing taxes are 0, taxable and invoice value from each other, period from the day."""
    return derive_return(body(sheets, "gstr"))


def derive_return(b: DataFrame) -> DataFrame:
    parts = {c: to_money(F.col(c)) for c in ("igst_amount", "cgst_amount", "sgst_amount", "cess_amount")}
    sums = reduce(lambda x, y: x + y, parts.values())
    tax = F.when(sums != 0, sums).otherwise(to_money(F.col("total_tax")))
    value, taxable = to_money(F.col("invoice_value")), to_money(F.col("taxable_value"))
    taxable = F.when(F.col("taxable_value").isNotNull() & (taxable != 0), taxable).otherwise(F.greatest(value - tax, F.lit(0).cast("decimal(38,2)")))
    day = parse_day(F.col("invoice_date"))
    out = b.where(F.col("supplier_gstin").isNotNull() | F.col("invoice_number").isNotNull())
    return out.select("supplier_gstin", "supplier_name", "invoice_number", day.alias("invoice_date"), F.coalesce(period_month(F.col("period")), F.date_format(day, "yyyy-MM")).alias("period"), taxable.alias("taxable_value"), *[v.alias(c) for c, v in parts.items()], tax.alias("total_tax"), F.when(F.col("invoice_value").isNotNull() & (value != 0), value).otherwise(taxable + tax).alias("invoice_value"), "place_of_supply", "invoice_type", "reverse_charge")


RECORD_KEYS = ("invoices", "records", "data")


def json_return(spark: SparkSession, path: str) -> DataFrame:
    """Return lines of JSON files: the records under a known key, at any depth, else the whole object as one record."""
    import json

    names = [*GSTR, "total_tax"]
    known = {alias_key(a): n for n, keys in [*GSTR.items(), ("total_tax", STORED["total_tax"])] for a in keys}

    def records(node) -> list[dict]:
        todo, out = [node], []
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo += reversed(x)
            elif isinstance(x, dict):
                key = next((k for k in RECORD_KEYS if isinstance(x.get(k), list)), None)
                if key:
                    out += [r for r in x[key] if isinstance(r, dict)]
                else:
                    todo += [v for v in x.values() if isinstance(v, (dict, list))]
        return out or ([node] if isinstance(node, dict) else [])

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                for r in records(json.loads(text)):
                    flat = {known[alias_key(k)]: v for k, v in r.items() if alias_key(k) in known and not isinstance(v, (dict, list))}
                    rows.append([None if flat.get(n) is None else str(flat[n]) for n in names])
            yield pd.DataFrame(rows, columns=names)

    raw = spark.read.text(path, wholetext=True).mapInPandas(parse, ", ".join(f"{n} string" for n in names))
    return derive_return(raw)
