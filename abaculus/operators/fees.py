"""Interest and fees: classification, period summaries, expected amounts and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.functions.amounts import pick_amount
from abaculus.functions.dates import period_key

MONEY = "decimal(20,2)"
INTEREST, FEE = "利息", "手续费"

#: Fixed values: (pattern, type, category, keyword), the first that matches counts.
CATEGORIES = (
    ("利息支出|贷款利息|借款利息", INTEREST, "利息支出", "利息"),
    ("利息", INTEREST, "利息收入", "利息"),
    ("结息", INTEREST, "利息收入", "结息"),
    ("interest", INTEREST, "利息收入", "interest"),
    ("转账.*手续费|汇款.*手续费", FEE, "转账手续费", "手续费"),
    ("提现.*手续费|取现.*手续费", FEE, "提现手续费", "手续费"),
    ("支付.*手续费", FEE, "支付手续费", "手续费"),
    ("管理费", FEE, "账户管理费", "管理费"),
    ("年费", FEE, "账户管理费", "年费"),
    ("网银.*费", FEE, "网银服务费", "服务费"),
    ("短信.*费", FEE, "短信服务费", "服务费"),
    ("手续费", FEE, "其他手续费", "手续费"),
    ("工本费", FEE, "其他手续费", "工本费"),
    ("服务费", FEE, "其他手续费", "服务费"),
    ("fee", FEE, "其他手续费", "fee"),
)

#: Category, rate, least and most for amounts; or a sum per month or per year.
RATES = {"转账手续费": ("0.005", "1", "50")}
MONTHLY = {"账户管理费": "10"}
YEARLY = {"年费": "100"}


def classify(summary: Column, categories: tuple = CATEGORIES) -> Column:
    """Struct (type, category, keyword) of a summary; three empty texts if none matches."""
    out = F.struct(F.lit("").alias("type"), F.lit("").alias("category"), F.lit("").alias("keyword"))
    for pattern, kind, category, keyword in reversed(categories):
        out = F.when(summary.rlike(f"(?i){pattern}"), F.struct(F.lit(kind).alias("type"), F.lit(category).alias("category"), F.lit(keyword).alias("keyword"))).otherwise(out)
    return out


def fee_rows(df: DataFrame, categories: tuple = CATEGORIES) -> DataFrame:
    """Rows of interest or fees with type, category, keyword and amount (A10)."""
    amount = F.coalesce(pick_amount(F.col("payment"), F.col("receipt")), F.lit(0).cast(MONEY))
    return df.withColumn("_c", classify(F.col("summary"), categories)).where("_c.type <> ''").select("txn_uid", "bank", "account", "subject", "trade_date", amount.alias("amount"), "_c.type", "_c.category", "_c.keyword")


def expected_amount(category: Column, base: Column, period: str = "month") -> Column:
    """Expected fee of a category: a clamped rate, or a fixed sum; unknown ones 0."""
    out = F.lit(0).cast("decimal(20,6)")
    for name, (rate, least, most) in RATES.items():
        d = [F.lit(x).cast("decimal(20,6)") for x in (rate, least, most)]
        out = F.when(category == name, F.least(F.greatest((base * d[0]).cast("decimal(20,6)"), d[1]), d[2])).otherwise(out)
    for name, each in MONTHLY.items():
        out = F.when(category == name, F.lit(each).cast("decimal(20,6)") * (12 if period == "year" else 3 if period == "quarter" else 1)).otherwise(out)
    for name, each in YEARLY.items():
        share = 1 if period == "year" else 4 if period == "quarter" else 12
        out = F.when(category == name, (F.lit(each).cast("decimal(20,6)") / share).cast("decimal(20,6)")).otherwise(out)
    return out.cast("decimal(20,6)")


def period_summary(rows: DataFrame, period: str = "month") -> DataFrame:
    """Count, sum and extremes by period, subject, bank and category."""
    return rows.groupBy(period_key(F.col("trade_date"), period).alias("period"), "subject", "bank", "type", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.max("amount").alias("largest"), F.min("amount").alias("smallest")
    )


def fee_anomalies(summary: DataFrame, period: str = "month", threshold: float = 0.5) -> DataFrame:
    """The summary with reasons: off the expected rate, off the mean of earlier periods, or off the period before.

    Sums are compared by products, so no rounding enters: |a - b| > threshold * b.
    """
    each = Window.partitionBy("subject", "bank", "category").orderBy("period")
    before = F.lag("total").over(each)
    past = each.rowsBetween(Window.unboundedPreceding, -1)
    past_sum, past_n = F.sum("total").over(past), F.count("total").over(past)
    t = F.lit(str(threshold)).cast("decimal(6,4)")
    known = F.col("category").isin(*RATES, *MONTHLY, *YEARLY)
    per_row = expected_amount(F.col("category"), F.lit(0).cast(MONEY), period)
    expected = F.when(F.col("category").isin(*RATES), per_row * F.col("n")).otherwise(per_row)
    reasons = [
        F.when(known & (F.abs(F.col("total") - expected) > t * expected), "预期费率"),
        F.when((past_n > 0) & (F.abs(F.col("total") * past_n - past_sum) > t * F.abs(past_sum)), "历史均值"),
        F.when(before.isNotNull() & (F.abs(F.col("total") - before) > t * F.abs(before)), "环比"),
    ]
    return summary.withColumn("reasons", F.array_join(F.array_compact(F.array(*reasons)), ",")).withColumn("is_anomaly", F.col("reasons") != "")


def check(df: DataFrame, period: str = "month", categories: tuple = CATEGORIES) -> DataFrame:
    """Classification, summary and anomalies in one."""
    return fee_anomalies(period_summary(fee_rows(df, categories), period), period)
