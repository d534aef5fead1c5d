"""Advisory suggestions for rows under review, from a callable that is not trusted.

``advise`` sends at most ``limit`` rows, each with its candidates, to ``call(row_json, candidates_json) -> text`` in the tasks.
A suggestion counts only if it is a complete JSON object with allowed values; an error, a late answer or anything else
gives the fallback. Suggestions fill columns of their own: the status that the rules gave is never touched.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

from .relational import qualify
from .tax_matching import ORDER, TOLERANCE

# fixed values: columns, allowed answers, fallback
SUGGESTIONS, CONFIDENCES = {"possible_match", "review_match", "likely_missing", "needs_manual_review"}, {"high", "medium", "low"}
FALLBACK = {
    "gemini_suggestion": "needs_manual_review",
    "gemini_confidence": "low",
    "gemini_reason": "Gemini suggestions are not configured.",
    "gemini_recommendation": "Use rule-based reconciliation result and review manually.",
    "gemini_candidate_id": "",
}
TIMEOUT, LIMIT, CANDIDATES, ROW_TEXT, CANDIDATE_TEXT = 10.0, 10, 5, 8_000, 24_000
_ANSWER = ", ".join(f"{c} string" for c in FALLBACK)


def parse(answer) -> dict[str, str]:
    """The validated suggestion, or the fallback."""
    try:
        found = json.loads(answer)
        values = {k: found[k].strip() for k in FALLBACK}
    except (ValueError, TypeError, KeyError, AttributeError):
        return dict(FALLBACK)
    for k in ("gemini_suggestion", "gemini_confidence"):
        values[k] = values[k].lower()
    good = values["gemini_suggestion"] in SUGGESTIONS and values["gemini_confidence"] in CONFIDENCES and values["gemini_reason"] and values["gemini_recommendation"]
    return values if good else dict(FALLBACK)


def advise(rows: DataFrame, keys: list[str], call: Callable[[str, str], str] | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """Suggestions for ``rows`` (keys, row_context, candidate_context: JSON texts), one each; without a callable the fallback."""
    kinds = dict(rows.dtypes)

    def run(batches):
        pool = ThreadPoolExecutor(max_workers=4) if call else None
        for b in batches:
            answers = []
            for row, candidates in zip(b["row_context"].tolist(), b["candidate_context"].tolist()):
                try:
                    answers.append(parse(pool.submit(call, (row or "")[:ROW_TEXT], (candidates or "[]")[:CANDIDATE_TEXT]).result(timeout)) if pool else dict(FALLBACK))
                except Exception:  # whatever the callable does, the reconciliation stands  # noqa: BLE001
                    answers.append(dict(FALLBACK))
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(answers, columns=list(FALLBACK))], axis=1)
        if pool:
            pool.shutdown(wait=False, cancel_futures=True)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + _ANSWER
    return rows.select(*keys, "row_context", "candidate_context").mapInPandas(run, schema)


def with_advice(results: DataFrame, advice: DataFrame | None, keys: list[str]) -> DataFrame:
    """``results`` with the suggestion columns, blank where there is no suggestion. Keys may be null."""
    results = results.drop(*FALLBACK)
    if advice is None:
        return results.withColumns({c: F.lit("") for c in FALLBACK})
    own = advice.select(*[F.col(k).alias(f"__{k}") for k in keys], *FALLBACK)
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    joined = results.join(F.broadcast(own), on, "left").drop(*[f"__{k}" for k in keys])  # at most ``limit`` rows
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in FALLBACK})


# ---- tax returns


def _first(*names: str) -> Column:
    """The first of the columns that says anything."""
    return F.coalesce(*[F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names])


def review_rows(results: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` exceptions in the order of review: keys, what is compared, and the row as JSON."""
    place = F.array_position(F.array(*[F.lit(s) for s in ORDER]), F.col("match_status"))
    rows = results.where(F.col("match_status") != "matched").orderBy(place, "gstin", "invoice_number", "invoice_date", F.col("gstr_row_ord").asc_nulls_last(), "books_row_ord").limit(limit)
    said = {
        "gstin": _first("gstr_gstin", "gstin", "zoho_gstin"), "invoice_number": _first("gstr_invoice_number", "invoice_number", "zoho_invoice_number"), "invoice_date": _first("gstr_invoice_date", "invoice_date", "zoho_invoice_date"),
        "taxable_value": _first("taxable_value_gstr", "gstr_taxable_value", "taxable_value_books"), "total_tax_amount": _first("tax_amount_gstr", "tax_amount_books"),
    }
    context = F.to_json(F.struct(*[F.coalesce(v, F.lit("")).alias(k) for k, v in said.items()]))
    return rows.select("gstr_row_ord", "books_row_ord", "match_status", "books_record_id", *[v.alias(f"said_{k}") for k, v in said.items()], context.alias("row_context"))


def top_books(rows: DataFrame, books: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The ``n`` best prepared books of each review row: its own first, then by score; a row that is missing in the return has its own only."""
    q = rows.withColumns({"q_gstin": X.gstin_key(F.coalesce("said_gstin", F.lit(""))), "q_invoice": X.invoice_key(F.coalesce("said_invoice_number", F.lit("")))})
    b = books.select(F.col("ord").alias("book_ord"), F.col("record_id"), F.col("name").alias("party_name"), F.col("gstin").alias("b_gstin"), F.col("invoice_number").alias("b_number"), "gstin_key", "invoice_key", "day", "taxable", "tax", "value")
    pairs = b.join(F.broadcast(q), (F.col("match_status") != "missing_in_gstr") | (F.col("books_record_id") == F.col("record_id")))  # a stated, bounded set of rows against all books
    own = (F.col("books_record_id") != "") & (F.col("books_record_id") == F.col("record_id"))
    days = F.abs(F.datediff(F.col("said_invoice_date").try_cast("date"), F.col("day")))

    def near(said: str, known: str) -> Column:
        gap = F.abs(F.col(said).try_cast("double") - F.col(known))
        return F.coalesce(F.when(gap <= TOLERANCE, F.lit(2.0)).otherwise(F.greatest(F.lit(0.0), 1 - gap / 1000)), F.lit(0.0))

    same = lambda x, y, points: F.when((F.col(x) != "") & (F.col(x) == F.col(y)), F.lit(points)).otherwise(F.lit(0.0))
    score = same("q_gstin", "gstin_key", 4.0) + same("q_invoice", "invoice_key", 5.0) + F.coalesce(F.greatest(F.lit(0.0), 2 - days / 7), F.lit(0.0)) + near("said_taxable_value", "taxable") + near("said_total_tax_amount", "tax")
    pairs = pairs.withColumns({"own": own, "score": score})
    best = qualify(pairs, ["gstr_row_ord", "books_row_ord"], [F.col("own").desc(), F.col("score").desc(), "book_ord"], n)
    return best.select("gstr_row_ord", "books_row_ord", "book_ord", "record_id", "own", "score", F.to_json(F.struct(F.col("record_id").alias("candidate_id"), "party_name", F.col("b_gstin").alias("gstin"), F.col("b_number").alias("invoice_number"), "day", "taxable", "tax", "value")).alias("candidate"))


def advise_returns(results: DataFrame, books: DataFrame, call: Callable[[str, str], str] | None = None, limit: int = LIMIT, timeout: float = TIMEOUT) -> DataFrame:
    """``results`` of a tax-return run with suggestions for the first ``limit`` rows of review; ``books``: prepared."""
    keys = ["gstr_row_ord", "books_row_ord"]
    rows = review_rows(results, limit)
    found = top_books(rows, books).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("own")).alias("o"), (-F.col("score")).alias("s"), "book_ord", "candidate"))), lambda x: x["candidate"]).alias("c"))
    found = found.select(*[F.col(k).alias(f"__{k}") for k in keys], F.concat(F.lit("["), F.array_join("c", ", "), F.lit("]")).alias("candidate_context"))
    both = rows.join(found, F.col(keys[0]).eqNullSafe(F.col(f"__{keys[0]}")) & F.col(keys[1]).eqNullSafe(F.col(f"__{keys[1]}")), "left")
    return with_advice(results, advise(both, keys, call, timeout), keys)
