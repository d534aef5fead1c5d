"""Keyword and account rules, compiled into one ordered CASE expression."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.versions import VersionedTable


@dataclass
class Rule:
    name: str
    source_types: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    match_fields: list[str] = field(default_factory=lambda: ["all_text"])
    account_ids: list[str] = field(default_factory=list)
    account_codes: list[str] = field(default_factory=list)


def load(text: str) -> list[Rule]:
    """Rules from YAML: a mapping of rule names to their fields, in order."""
    return [Rule(name=k, **(v or {})) for k, v in (yaml.safe_load(text) or {}).items()]


#: Neutral example rules; a deployment brings its own.
EXAMPLE = """
services_revenue: {source_types: [invoice]}
bank_costs: {source_types: [journal, bill], keywords: [bank, charges], exclude: [rebanked]}
accruals: {source_types: [journal], keywords: [accrual]}
parts_low: {source_types: [bill], keywords: [part 1, part 2], match_fields: [line_text]}
other_cogs: {source_types: [bill]}
"""


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def test(rule: Rule) -> Column:
    """Account ids or codes match at once, before excludes; else no exclude word and any keyword in the joined fields.
    A rule with neither accounts nor keywords takes all of its sources."""
    accounts = []
    if rule.account_ids:
        accounts.append(F.coalesce(F.arrays_overlap("account_ids", F.array(*map(F.lit, rule.account_ids))), F.lit(False)))
    if rule.account_codes:
        accounts.append(F.coalesce(F.arrays_overlap("account_codes", F.array(*map(F.lit, rule.account_codes))), F.lit(False)))
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in rule.match_fields]))
    words = _any([hay.contains(w.lower()) for w in rule.keywords]) if rule.keywords else F.lit(not (rule.account_ids or rule.account_codes))
    barred = _any([hay.contains(w.lower()) for w in rule.exclude])
    found = _any(accounts) | (~barred & words)
    return found & F.col("source_type").isin(*rule.source_types) if rule.source_types else found


def classify(df: DataFrame, rules: list[Rule], column: str = "category") -> DataFrame:
    """The first rule that matches; NULL if none does."""
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in rules:
        case = case.when(test(r), F.lit(r.name))
    return df.withColumn(column, case.otherwise(F.lit(None).cast("string")))


def with_accounts(rules: list[Rule], mapping: list[dict]) -> list[Rule]:
    """Rules extended by an account mapping: rows (rule, account_id, account_code, is_active)."""
    out = {r.name: Rule(**vars(r)) for r in rules}
    for row in mapping:
        if not row.get("is_active", True) or row["rule"] not in out:
            continue
        rule = out[row["rule"]]
        if row.get("account_id"):
            rule.account_ids = [*rule.account_ids, str(row["account_id"])]
        if row.get("account_code"):
            rule.account_codes = [*rule.account_codes, str(row["account_code"])]
    return list(out.values())


def mapping_problems(mapping: DataFrame) -> DataFrame:
    """Active rows without a label or without code and name, and duplicate active (organisation, code) groups."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    active = mapping.where(F.coalesce("is_active", F.lit(False)))
    bad = active.where(blank("label") | (blank("account_code") & blank("account_name"))).select("organization", "account_code", F.lit("incomplete").alias("problem"), F.lit(1).cast("long").alias("n"))
    twice = active.where(~blank("account_code")).groupBy("organization", "account_code").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return bad.unionByName(twice.select("organization", "account_code", F.lit("duplicate").alias("problem"), "n"))


# fixed values: what a mapping row is without the field
MAPPING_DEFAULTS = {"report_template": "MidofficeData_KeyMetrics_PL_FY2526", "section": "expense", "organization": "all", "sign_rule": "positive"}
MAPPING_FIELDS = ["report_template", "section", "label", "account_id", "account_code", "account_name", "organization", "sign_rule"]


def save_mapping(table: VersionedTable, mapping: DataFrame, by: str, at: str, expected: int | None = None) -> dict:
    """Stores an account mapping as the next version, unless ``mapping_problems`` finds any or somebody else saved since ``expected``.

    Inactive blank rows go; fields without a value take their default; ``at`` and ``by`` are stored on each row."""
    word = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in mapping.columns else F.lit("")
    m = mapping.select(*[F.when(word(c) == "", F.lit(MAPPING_DEFAULTS.get(c, ""))).otherwise(word(c)).alias(c) for c in MAPPING_FIELDS], F.coalesce("is_active", F.lit(False)).alias("is_active"), F.lit(at).alias("updated_at"), F.when(word("updated_by") == "", F.lit(by)).otherwise(word("updated_by")).alias("updated_by"))
    found = {r["problem"]: r["n"] for r in mapping_problems(m).groupBy("problem").agg(F.count(F.lit(1)).alias("n")).collect()}  # two kinds
    if found:
        return {"status": "error", "errors": found, "saved_count": 0}
    version = table.save(m.where(F.concat("label", "account_id", "account_code", "account_name") != ""), expected)
    return {"status": "success", "errors": {}, "saved_count": table.load(version).count(), "version": version}
