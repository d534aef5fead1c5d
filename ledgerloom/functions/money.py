"""Money: text to numbers, currency conversion, display."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: rates to INR of the consolidated views, and the default rate of the management report
RATES = {"INR": "1.00", "USD": "83.00"}
REPORT_USD = 90.0


def fx_rates(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{c}', CAST({r} AS DECIMAL(8,2)))" for c, r in RATES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(currency_code, inr_rate)")


def with_inr(df: DataFrame, amounts: list[str], currency: str = "original_currency") -> DataFrame:
    """``x_inr`` for each amount. The rates are a constant of two rows, so the join is a broadcast one."""
    fx = F.broadcast(fx_rates(df.sparkSession).withColumnRenamed("currency_code", "__cur"))
    df = df.join(fx, df[currency] == F.col("__cur"), "left")
    rate = F.coalesce("inr_rate", F.lit(1).cast("decimal(8,2)"))
    return df.withColumns({f"{a}_inr": (F.col(a).cast("decimal(29,9)") * rate).cast("decimal(38,9)") for a in amounts}).drop("__cur", "inr_rate")


def report_inr(amount: Column, currency: Column, rate: Column) -> Column:
    """Management report: INR or blank as it is, USD by the document's rate or the default, others unchanged."""
    usd = F.when(F.coalesce(rate, F.lit(0.0)) > 0, rate).otherwise(F.lit(REPORT_USD))
    return F.when(F.upper(F.trim(F.coalesce(currency, F.lit("")))) == "USD", amount * usd).otherwise(amount)


def to_money(c: Column) -> Column:
    """Text to two decimals, half up: parentheses are negative, currency signs and CR/DR go, junk is 0.00."""
    x = F.trim(c.cast("string"))
    digits = F.regexp_replace(x, r"[^0-9.\-]", "")
    value = F.round(F.coalesce(digits.try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)")), 2).cast("decimal(38,2)")
    return F.when(x.rlike(r"^\(.*\)$"), -F.abs(value)).otherwise(value)


def bank_number(c: Column) -> Column:
    """As ``to_money``, and Dr or debit is negative, Cr or credit positive."""
    x, v = F.lower(F.coalesce(c.cast("string"), F.lit(""))), to_money(c)
    return F.when(x.rlike(r"\bdr\b|debit"), -F.abs(v)).when(x.rlike(r"\bcr\b|credit"), F.abs(v)).otherwise(v)


def statement_amount(c: Column) -> Column:
    """Amounts of statement lines: a trailing minus or DR is negative."""
    x, v = F.upper(F.trim(F.coalesce(c, F.lit("")))), F.abs(to_money(c))
    return F.when(x.rlike(r"-$|DR\.?$|^-|^\("), -v).otherwise(v)


def short_inr(c: Column) -> Column:
    """``INR 1.25 Cr``, ``INR 3.40 L`` or whole rupees."""
    a = F.abs(c)
    big = lambda unit, name: F.concat(F.lit("INR "), F.format_string("%.2f", c / unit), F.lit(name))
    return F.when(a >= 1e7, big(1e7, " Cr")).when(a >= 1e5, big(1e5, " L")).otherwise(F.concat(F.lit("INR "), F.format_number(c, 0)))


def sum_known(*parts: Column, require_all: bool = False) -> Column:
    """Row-wise sum; NULL if none is known (or, on demand, not all)."""
    known = [p.isNotNull() for p in parts]
    test = known[0]
    for k in known[1:]:
        test = (test & k) if require_all else (test | k)
    total = F.lit(0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0))
    return F.when(test, total)
