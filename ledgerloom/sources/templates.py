"""Bank statements read by template: which lines count, where dates and amounts stand, what opens a balance.

Lines come as (doc_id, page, line_no, text, words array<struct<text, x0>>); whoever reads the PDF makes them. Dates, amounts
and their columns are found by column expressions, one set per template. What depends on the lines before (the current
date, the narration so far, an amount that waits for its balance) is carried by a small state machine over the sorted lines
of a partition; its state is one transaction, so neither long statements nor many pages need memory.

Null texts and words count as empty; a null page or line number comes first; lines before the first date are left out;
equal lines are lines of their own; no lines give no rows. A word without a place stands at 0.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import VersionedTable

# fixed values: months, dates, amounts, ignored lines, opening words and columns of the default template
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATES = [_MONTH + r"[\s-]+\d{1,2}[\s-]+\d{4}", r"\d{1,2}[\s-]+" + _MONTH + r"[\s-]+\d{4}"]
AMOUNT = r"(?<![A-Za-z0-9])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}(?:[-+]|\s?(?:CR|DR))?(?![A-Za-z0-9])"
OPENING = ["balance b/f", "balance bf"]
IGNORED = [
    r"^account number\b", r"^select transaction history criteria\b", r"^transaction history$", r"^date transaction narrative debit credit ledger balance value$", r"^dd history page\b", r"https?://", r"\bwww\.",
    r"^url\b", r"^display previous$", r"^display next$", r"^cancel$", r"^print form$", r"^display previous display next cancel print form$",
]
CREDIT_WORDS = ["credit", "cr ", "received", "receipt", "inward", "remittance", "refund"]
COLUMNS = ["debit", "credit", "balance"]
OPENING_ROW = "BALANCE B/F"
#: Pages above which fewer rows than this are reported as a doubtful reading.
MANY_PAGES, FEW_ROWS = 20, 100


@dataclass(frozen=True)
class Template:
    template_name: str = "HSBC Default"
    bank_name: str = "HSBC"
    statement_type: str = "DD History"
    date_patterns: list[str] = field(default_factory=lambda: list(DATES))
    amount_pattern: str = AMOUNT
    opening_balance_keywords: list[str] = field(default_factory=lambda: list(OPENING))
    ignore_line_keywords: list[str] = field(default_factory=lambda: list(IGNORED))
    debit_column_x_min: float | None = 330.0
    debit_column_x_max: float | None = 410.0
    credit_column_x_min: float | None = 415.0
    credit_column_x_max: float | None = 500.0
    balance_column_x_min: float | None = 505.0
    balance_column_x_max: float | None = 590.0
    active: bool = True

    def place(self, column: str) -> float | None:
        """Midpoint of a column's borders, or the border that is known."""
        known = [x for x in (getattr(self, f"{column}_column_x_min"), getattr(self, f"{column}_column_x_max")) if x is not None]
        return sum(known) / len(known) if known else None


# ---- templates as rows


#: Columns of the editing form and the fields behind them.
FORM = {("Active/Inactive" if f.name == "active" else f.name.replace("_", " ").title()): f.name for f in fields(Template)}
_LISTS = ("date_patterns", "opening_balance_keywords", "ignore_line_keywords")
_SCHEMA = ", ".join(f"{n} " + ("array<string>" if n in _LISTS else "double" if "_x_" in n else "boolean" if n == "active" else "string") for n in FORM.values())


def _clean(x) -> str:
    return "" if x is None or (isinstance(x, float) and x != x) else str(x).strip()


def _listed(x) -> list[str]:
    parts = x if isinstance(x, (list, tuple)) else re.split(r"[\n,]+", _clean(x))
    return [_clean(p) for p in parts if _clean(p)]


def _number(x) -> float | None:
    try:
        return float(_clean(x))
    except ValueError:
        return None


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern, re.I)
    except re.error:
        return False
    return True


def problems(rows: list[dict]) -> list[str]:
    """What is wrong with edited rows (keys of ``FORM``), in words, by row."""
    if not rows:
        return ["At least one bank PDF template is required."]
    out = []
    for i, row in enumerate(rows, 1):
        need = lambda ok, text: None if ok else out.append(f"Row {i}: {text}")  # noqa: B023, E731
        need(_clean(row.get("Template Name")), "Template Name is required.")
        need(_clean(row.get("Bank Name")), "Bank Name is required.")
        dates, amount = _listed(row.get("Date Patterns")), _clean(row.get("Amount Pattern"))
        need(dates, "Date Pattern is required.")
        need(all(map(_compiles, dates)), "Date Pattern is not a valid regular expression.")
        need(amount, "Amount Pattern is required.")
        need(_compiles(amount), "Amount Pattern is not a valid regular expression.")
        for name in FORM:
            if " X " in name:
                need(not _clean(row.get(name)) or _number(row.get(name)) is not None, f"{name} must be numeric when provided.")
    return out


def from_form(row: dict) -> Template:
    """A template from an edited row; blank patterns and lists take the default's."""
    values = {}
    for name, key in FORM.items():
        x = row.get(name)
        values[key] = _listed(x) if key in _LISTS else _number(x) if "_x_" in key else _clean(x).lower() in ("active", "true", "yes", "1") if key == "active" else _clean(x)
    return _filled(values)


def _filled(values: dict) -> Template:
    default = Template()
    return Template(**{k: v if v or k == "active" or "_x_" in k else getattr(default, k) for k, v in values.items()})


def to_form(t: Template) -> dict:
    values = asdict(t)
    return {name: "\n".join(values[k]) if k in _LISTS else ("Active" if values[k] else "Inactive") if k == "active" else values[k] for name, k in FORM.items()}


def save(table: VersionedTable, rows: list[dict], expected: int | None = None) -> dict:
    """Stores edited rows as the next version, if nothing is wrong with them and nobody else saved since ``expected``."""
    errors = problems(rows)
    if errors:
        return {"status": "error", "errors": errors, "saved_count": 0}
    kept = [tuple(asdict(from_form(r)).values()) for r in rows]
    version = table.save(table.spark.createDataFrame(kept, _SCHEMA), expected)
    return {"status": "success", "errors": [], "saved_count": len(kept), "version": version}


def load(table: VersionedTable) -> list[Template]:
    """All stored templates; the default where none were stored."""
    stored = table.load()
    return [_filled(r.asDict()) for r in stored.collect()] if stored is not None else [Template()]  # a configuration


def pick(templates: list[Template], name: str | None = None) -> Template:
    """The active template of that name; else the first active one; else the default."""
    active = [t for t in templates if t.active] or [Template()]
    return next((t for t in active if t.template_name.lower() == _clean(name).lower()), active[0])


# ---- expressions over one line


def _spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _day(text: Column) -> Column:
    plain = F.initcap(F.trim(F.regexp_replace(text, r"[\s/-]+", " ")))
    forms = {r"^\p{L}{3} \d{1,2} \d{4}$": "MMM d yyyy", r"^\d{1,2} \p{L}{3} \d{4}$": "d MMM yyyy", r"^\d{4} \d{1,2} \d{1,2}$": "yyyy M d", r"^\d{1,2} \d{1,2} \d{4}$": "M d yyyy", r"^\d{1,2} \d{1,2} \d{4} ?$": "d M yyyy"}
    return F.coalesce(*[F.when(plain.rlike(p), F.to_date(F.try_to_timestamp(plain, F.lit(f)))) for p, f in forms.items()])


def _dated(text: Column, window: Column, patterns: list[str], anchor: str) -> Column:
    """struct(day, rest) of the first pattern that finds a real date in ``window``, the head of ``text``; null without one."""
    tries = []
    for p in patterns:
        rule = f"(?i){anchor}(?:{p})"
        whole, named = F.regexp_extract(window, rule, 0), F.regexp_extract(window, rule, 1 if re.compile(p).groups else 0)
        at = F.position(whole, window)
        day = _day(F.when(named != "", named).otherwise(whole))
        rest = F.concat(F.substring(text, F.lit(1), at - 1), F.substr(text, at + F.length(whole)))
        tries.append(F.when((whole != "") & day.isNotNull(), F.struct(day.alias("day"), F.trim(rest).alias("rest"))))
    return F.coalesce(*tries)


def _amount(text: Column) -> Column:
    """Commas and CR or DR go; a minus on either side is negative."""
    x = F.replace(F.trim(text), F.lit(","), F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(x, r"[+-]+$", ""), r"(?i)(?:CR|DR)$", "")).try_cast("decimal(38,2)")
    return F.when(x.endswith("-"), -bare).otherwise(bare)


def ignored(template: Template) -> Column:
    text = F.lower(_spaces(F.col("text")))
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in dict.fromkeys([*IGNORED, *template.ignore_line_keywords])], text == "")


def _credit_words(narration: Column) -> Column:
    text = F.concat(F.lower(narration), F.lit(" "))
    return reduce(lambda a, b: a | b, [text.contains(w) for w in CREDIT_WORDS])


def _fields(lines: DataFrame, template: Template) -> DataFrame:
    """(doc_id, page, line_no, prefix_day, inner_day, narration, debit, credit, balance, moved) of each line; ``debit_x`` and so on are places."""
    amount, dates = f"(?i){template.amount_pattern}", list(dict.fromkeys([*template.date_patterns, *[f"{p}\\b" for p in DATES]]))
    d = lines.withColumn("text", F.trim("text"))
    d = d.withColumn("__p", _dated(F.col("text"), F.col("text"), dates, "^")).withColumn("__rest", F.coalesce("__p.rest", "text"))
    head = F.get(F.split(F.col("__rest"), amount, 2), F.lit(0))
    d = d.withColumn("__e", _dated(F.col("__rest"), head, dates, "")).withColumn("__plain", F.coalesce("__e.rest", "__rest"))
    d = d.withColumn("narration", _spaces(F.regexp_replace("__plain", amount, "")))
    placed = F.filter("words", lambda w: F.trim(w["text"]).rlike(f"^(?:{amount})$"))
    placed = F.transform(placed, lambda w: F.struct(F.coalesce(w["x0"], F.lit(0.0)).alias("x"), _amount(w["text"]).alias("v")))
    found = F.transform(F.regexp_extract_all("text", F.lit(f"({amount})"), F.lit(1)), lambda t: F.struct(F.lit(None).cast("double").alias("x"), _amount(t).alias("v")))
    d = d.withColumn("__t", F.when(F.size("words") > 0, F.array_sort(placed, lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))).otherwise(found))
    debit_x, credit_x, balance_x = (F.col(f"{c}_x") for c in COLUMNS)
    by_place = (F.size("words") > 0) & (F.size("__t") > 0) & balance_x.isNotNull()
    border = F.coalesce((credit_x + balance_x) / 2, balance_x - 20)
    last = lambda a: F.get(a, F.size(a) - 1)
    right, n = F.filter("__t", lambda t: t["x"] >= border), F.size("__t")
    # the last amount right of the border is the balance, the last of the others the transaction's
    others = F.when(F.size(right) > 0, F.slice("__t", 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.col("__t"))
    d = d.withColumns({"__b": F.when(by_place, last(right)).otherwise(last(F.col("__t"))), "__m": F.when(by_place, last(others)).otherwise(F.get("__t", n - 2))})
    x, v = F.col("__m.x"), F.col("__m.v")
    middle, known = (debit_x + credit_x) / 2, debit_x.isNotNull() & credit_x.isNotNull() & F.col("__m.x").isNotNull()
    is_credit = F.when(known, x >= middle).otherwise(_credit_words(F.col("narration")))
    zero = F.lit(0).cast("decimal(38,2)")
    return d.select(
        "doc_id", "page", "line_no", F.col("__p.day").alias("prefix_day"), F.col("__e.day").alias("inner_day"), "narration", F.when(~is_credit, v).otherwise(zero).alias("debit"), F.when(is_credit, v).otherwise(zero).alias("credit"), F.col("__b.v").alias("balance"),
        v.isNotNull().alias("moved"), F.array(*[F.lit(k.lower()) for k in template.opening_balance_keywords]).alias("opening"),
    )


def _placed(lines: DataFrame, template: Template) -> DataFrame:
    """Lines with the columns' places: the template's midpoints; what it leaves open comes from the heads of the document's pages."""
    known = {c: template.place(c) for c in COLUMNS}
    fixed = lambda df: df.withColumns({f"{c}_x": F.lit(x).cast("double") for c, x in known.items() if x is not None})
    unknown = [c for c, x in known.items() if x is None]
    if not unknown:
        return fixed(lines)
    text = F.lower("text")
    heads = lines.where(text.contains("transaction narrative") & text.contains("debit") & text.contains("credit"))
    heads = heads.groupBy("doc_id", "page").agg(F.min_by("words", "line_no").alias("words"))
    at = lambda name: F.try_element_at(F.transform(F.filter("words", lambda w: F.lower(F.trim(w["text"])) == name), lambda w: w["x0"]), F.lit(-1))
    heads = heads.select("doc_id", "page", *[at("ledger" if c == "balance" else c).alias(c) for c in unknown])
    first = heads.groupBy("doc_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page"))).alias(f"{c}_x") for c in unknown])
    return fixed(lines.join(first, "doc_id", "left"))


# ---- what is carried from line to line


OUT = "doc_id string, seq long, transaction_date date, narration string, debit_amount decimal(38,2), credit_amount decimal(38,2), balance_amount decimal(38,2)"
_BF = re.compile(r"\bbalance\s+b/?f\b", re.I)


def _carried(batches):
    """Rows of the sorted lines of a partition; documents follow each other."""
    doc, begun, seq, day, parts, waiting = None, False, 0, None, [], None
    for pdf in batches:
        rows = []
        for d, prefix, inner, narration, debit, credit, balance, moved, opening in zip(*[pdf[c] for c in ("doc_id", "prefix_day", "inner_day", "narration", "debit", "credit", "balance", "moved", "opening")]):
            if not begun or d != doc:
                doc, begun, seq, day, parts, waiting = d, True, 0, None, [], None
            for found in (prefix, inner):
                if found is not None and found == found:
                    if day is not None and found != day and parts:
                        parts, waiting = [], None
                    day = found
            if day is None:
                continue
            if narration:
                parts.append(narration)
            if balance is None:
                waiting = (debit, credit) if moved else waiting
                continue
            text = " ".join(parts)
            if _BF.search(text) or any(k in text.lower() for k in opening):
                row = (OPENING_ROW, 0, 0)
            elif moved:
                row = (text, debit, credit)
            elif waiting:
                row = (text, *waiting)
            else:
                continue
            rows.append((doc, seq, day, *row, balance))
            seq, parts, waiting = seq + 1, [], None
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def transactions(lines: DataFrame, *templates: Template) -> DataFrame:
    """Transactions of each document, numbered from 0 in their order.

    With several templates the lines carry ``template_name`` and documents of unknown names take the first one; with one
    (or none: the default) all lines are read by it. One shuffle by document."""
    have = lambda c, kind: (F.col(c) if c in lines.columns else F.lit(0)).cast(kind).alias(c)
    used = templates or (Template(),)
    names = [t.template_name.lower() for t in used]
    which = F.lower(F.trim(F.coalesce("template_name", F.lit("")))) if len(used) > 1 else F.lit("")
    d = lines.select(F.col("doc_id").cast("string").alias("doc_id"), have("page", "long"), F.col("line_no").cast("long").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("words", F.array().cast(dict(lines.dtypes)["words"])).alias("words"), F.when(which.isin(*names), which).otherwise(names[0]).alias("which"))
    parts = []
    for name, t in zip(names, used):
        own = d.where(F.col("which") == name) if len(used) > 1 else d
        parts.append(_fields(_placed(own.drop("which"), t).where(~ignored(t)), t))
    sorted_ = reduce(DataFrame.unionByName, parts).repartition("doc_id").sortWithinPartitions("doc_id", "page", "line_no")
    return sorted_.mapInPandas(_carried, OUT)


def doubtful(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, pages, n_rows) of long documents that gave few rows: their template may not fit."""
    n = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    p = lines.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count_distinct("page").alias("pages")).where(F.col("pages") > MANY_PAGES)
    return p.join(n, "doc_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long"))).where(F.col("n_rows") < FEW_ROWS)


def summary(rows: DataFrame) -> DataFrame:
    """Rows, first and last day of each document."""
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"))
