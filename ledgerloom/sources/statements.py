"""Statement pages as lines of placed words: a state machine per document turns them into transactions.

Lines come as (doc_id, line_no, text, words array<struct<text, x0>>); whoever reads the PDF makes them. A document
is a group of its own, bounded by one statement.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import statement_amount
from ledgerloom.sources.ingest import parse_day

_DATE = re.compile(r"^\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}[ -][A-Za-z]{3}[ -]\d{2,4})\b")
_AMOUNT = re.compile(r"^\(?-?[\d,]*\d\.\d{2}\)?(?:\s*(?:CR|DR))?-?$", re.I)
_IGNORED = re.compile(r"^\s*(page \d+|statement of account|opening balance|closing balance|date\s+(narration|description|particulars))", re.I)
_CREDIT = re.compile(r"\b(salary|credit|receipt|received|deposit|refund|interest)\b", re.I)
SCHEMA = "doc_id string, seq int, day_text string, narration string, debit_text string, credit_text string, balance_text string"


def _one(pdf: pd.DataFrame, anchors: dict[str, float]) -> pd.DataFrame:
    rows, day, current = [], None, None
    for text, words in zip(pdf["text"], pdf["words"]):
        text = text or ""
        if _IGNORED.match(text):
            continue
        m = _DATE.match(text)
        amounts = [(w["text"], float(w["x0"])) for w in (words if words is not None else []) if _AMOUNT.match(w["text"])]
        plain = " ".join(w["text"] for w in (words if words is not None else []) if not _AMOUNT.match(w["text"])) or re.sub(r"[\d,]+\.\d{2}", "", text)
        if m:
            day = m[1]
            plain = plain[len(m[0].strip()) :].strip() if plain.startswith(m[0].strip()) else plain
        if m or (amounts and day and current is not None and current["done"]):
            current = {"day": day, "narration": [], "debit": None, "credit": None, "balance": None, "done": False}
            rows.append(current)
        if current is None:
            continue
        if plain.strip():
            current["narration"].append(plain.strip())
        for value, x in amounts:
            column = min(anchors, key=lambda k: abs(anchors[k] - x))
            if current[column] is None:
                current[column] = value
            elif column == "debit" and current["credit"] is None and _CREDIT.search(" ".join(current["narration"])):
                current["credit"] = value
        current["done"] = current["done"] or bool(amounts)
    doc = pdf["doc_id"].iloc[0]
    out = [(doc, i, r["day"], " ".join(r["narration"]), r["debit"], r["credit"], r["balance"]) for i, r in enumerate(rows) if r["done"]]
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def transactions(lines: DataFrame, anchors: dict[str, float]) -> DataFrame:
    """``anchors``: x of the debit, credit and balance columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _one(pdf.sort_values("line_no"), anchors)

    out = lines.groupBy("doc_id").applyInPandas(run, SCHEMA)
    money = lambda c: F.when(F.col(c).isNotNull(), F.abs(statement_amount(F.col(c))))
    return out.select("doc_id", "seq", parse_day(F.col("day_text")).alias("transaction_date"), "narration", F.coalesce(money("debit_text"), F.lit(0).cast("decimal(38,2)")).alias("debit_amount"), F.coalesce(money("credit_text"), F.lit(0).cast("decimal(38,2)")).alias("credit_amount"), F.when(F.col("balance_text").isNotNull(), statement_amount(F.col("balance_text"))).alias("balance_amount"))
