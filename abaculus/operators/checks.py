"""Balance continuity, screening and amount anomalies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.functions.amounts import parse_amount, pick_amount

MONEY = "decimal(20,2)"


def balance_breaks(df: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Rows whose balance isn't the previous one plus receipt and payment.

    Accounts that are blank and rows without a date take no part.
    """
    rows = df.where((F.coalesce(F.trim("account"), F.lit("")) != "") & F.col("trade_date").isNotNull())
    order = Window.partitionBy("account").orderBy("trade_date", "txn_id")
    zero = F.lit(0).cast(MONEY)
    expected = F.lag("balance").over(order) + F.coalesce("receipt", zero) + F.coalesce("payment", zero)
    checked = rows.withColumn("expected", expected.cast(MONEY)).withColumn("difference", (F.col("balance") - F.col("expected")).cast(MONEY))
    return checked.where(F.abs("difference") > F.lit(tolerance).cast(MONEY)).select("txn_uid", "account", "trade_date", "balance", "expected", "difference")


def _level(ratio: Column, high: float, medium: float) -> Column:
    return F.when(ratio >= high, "high").when(ratio >= medium, "medium").otherwise("low")


def large_amounts(df: DataFrame, threshold: float | None) -> DataFrame:
    """Rows at or above a threshold, by how often it is exceeded (A1); none without a threshold above zero."""
    rows = df.withColumn("amount", pick_amount(F.col("payment"), F.col("receipt")))
    if threshold is None or threshold <= 0:
        return rows.where(F.lit(False)).select(F.lit("large_amount").alias("risk_type"), F.lit("").alias("risk_level"), "txn_uid", "trade_date", "amount")
    limit = F.lit(str(threshold)).cast(MONEY)
    return rows.where(F.col("amount") >= limit).select(F.lit("large_amount").alias("risk_type"), F.when(F.col("amount") >= limit * 5, "high").when(F.col("amount") >= limit * 2, "medium").otherwise("low").alias("risk_level"), "txn_uid", "trade_date", "amount")


def busy_days(df: DataFrame, threshold: int | None, with_ids: bool = False) -> DataFrame:
    """Dates with at least ``threshold`` rows over all accounts (A2); a sorted list of a date's ids only on request,
    as it is as long as the date has rows (``busy_day_rows`` gives them one by one)."""
    rows = df.where("trade_date is not null").withColumn("amount", pick_amount(F.col("payment"), F.col("receipt")))
    n = F.count(F.lit(1))
    days = rows.groupBy("trade_date").agg(n.alias("n"), F.coalesce(F.sum("amount"), F.lit(0).cast(MONEY)).alias("amount"), F.min_by("bank", "txn_uid").alias("bank"), *[F.array_sort(F.collect_list("txn_id")).alias("txn_ids")] * with_ids)
    limit = threshold or 0
    return days.where(F.col("n") >= limit if limit > 0 else F.lit(False)).select(F.lit("high_frequency").alias("risk_type"), _level(F.col("n") / F.lit(float(limit or 1)), 3, 1.5).alias("risk_level"), "trade_date", "n", "amount", "bank", *["txn_ids"] * with_ids)


def busy_day_rows(df: DataFrame, threshold: int | None) -> DataFrame:
    """The rows of busy dates, one by one: for dates with too many rows for a list (A2)."""
    limit = threshold or 0
    counts = df.where("trade_date is not null").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    days = counts.where(F.col("n") >= limit if limit > 0 else F.lit(False)).select("trade_date", _level(F.col("n") / F.lit(float(limit or 1)), 3, 1.5).alias("risk_level"))
    return df.join(days, "trade_date").select(F.lit("high_frequency").alias("risk_type"), "risk_level", "trade_date", "txn_uid", "txn_id")


@dataclass
class FrequencyRule:
    name: str
    window_days: int
    min_count: int
    min_total: float | None = None
    enabled: bool = True


#: Defaults: thresholds for one amount and one day, and the frequency rules.
LARGE, BUSY = 500_000.0, 50
FREQUENCY = (FrequencyRule("30d", 30, 20, 100_000.0), FrequencyRule("7d", 7, 10))


def frequent_counterparties(df: DataFrame, rules: tuple[FrequencyRule, ...] = FREQUENCY) -> DataFrame:
    """Counterparties and dates whose trailing window reaches a rule's count and total.

    Rows are first summed by counterparty and day, so a hot counterparty has a row a day in the
    window, not one a transaction; one range window per rule, days included at both ends.
    """
    amount = F.coalesce(pick_amount(F.col("payment"), F.col("receipt")), F.lit(0).cast(MONEY))
    rows = df.where((F.coalesce(F.trim("counterparty"), F.lit("")) != "") & F.col("trade_date").isNotNull())
    days = rows.groupBy(F.trim("counterparty").alias("counterparty"), "trade_date").agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount")).withColumn("day_no", F.unix_date("trade_date"))
    found = None
    for r in rules:
        if not r.enabled:
            continue
        w = Window.partitionBy("counterparty").orderBy("day_no").rangeBetween(-(r.window_days - 1), 0)
        hits = days.select("counterparty", "trade_date", F.sum("n").over(w).alias("n"), F.sum("amount").over(w).alias("amount")).where(F.col("n") >= r.min_count)
        if r.min_total is not None:
            hits = hits.where(F.col("amount") >= F.lit(str(r.min_total)).cast(MONEY))
        hits = hits.select(F.lit("counterparty_frequency").alias("risk_type"), _level(F.col("n") / F.lit(float(r.min_count)), 3, 1.5).alias("risk_level"), F.lit(r.name).alias("rule"), "counterparty", "trade_date", "n", "amount")
        found = hits if found is None else found.unionByName(hits)
    return found


def screening(df: DataFrame, large: float = LARGE, busy: int = BUSY, rules: tuple[FrequencyRule, ...] = FREQUENCY) -> DataFrame:
    """All alerts in one table (A4)."""
    cols = ["risk_type", "risk_level", "trade_date", "amount"]
    alerts = large_amounts(df, large).select(*cols).unionByName(busy_days(df, busy).select(*cols))
    return alerts.unionByName(frequent_counterparties(df, rules).select(*cols))


def screening_levels(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("risk_type", "risk_level").agg(F.count(F.lit(1)).alias("n"))


ANOMALIES = ("LARGE_AMOUNT", "ZERO_WITH_COUNTERPARTY", "NEGATIVE_RECEIPT", "POSITIVE_PAYMENT", "BALANCE_NEGATIVE", "BOTH_PAYMENT_AND_RECEIPT", "NEITHER_PAYMENT_NOR_RECEIPT")


def amount_anomalies(df: DataFrame, threshold: float = 500_000.0, enabled: tuple[str, ...] = ANOMALIES) -> DataFrame:
    """``df`` with the list of its amount anomalies (A5); text amounts with separators are read too."""
    numeric = dict(df.dtypes)
    money = {c: (F.col(c) if numeric[c].startswith("decimal") else parse_amount(F.col(c))) for c in ("payment", "receipt", "balance")}
    pay, get, balance = money["payment"], money["receipt"], money["balance"]
    zero = lambda c: F.coalesce(c, F.lit(0).cast(MONEY))
    limit = F.lit(str(threshold)).cast(MONEY)
    empty = (zero(pay) == 0) & (zero(get) == 0)
    tests = {
        "LARGE_AMOUNT": (F.greatest(F.abs(zero(pay)), F.abs(zero(get))) >= limit) if threshold > 0 else F.lit(False),
        "ZERO_WITH_COUNTERPARTY": empty & (F.coalesce(F.trim("counterparty"), F.lit("")) != ""),
        "NEGATIVE_RECEIPT": get < 0,
        "POSITIVE_PAYMENT": pay > 0,
        "BALANCE_NEGATIVE": balance < 0,
        "BOTH_PAYMENT_AND_RECEIPT": (zero(pay) != 0) & (zero(get) != 0),
        "NEITHER_PAYMENT_NOR_RECEIPT": empty,
    }
    return df.withColumn("anomalies", F.array_compact(F.array(*[F.when(tests[a], F.lit(a)) for a in ANOMALIES if a in enabled])))


def anomaly_summary(marked: DataFrame) -> DataFrame:
    """Rows by anomaly, and all rows with any (type null)."""
    rows = marked.where(F.size("anomalies") > 0)
    each = rows.select(F.explode("anomalies").alias("anomaly")).groupBy("anomaly").agg(F.count(F.lit(1)).alias("n"))
    return each.unionByName(rows.agg(F.lit(None).cast("string").alias("anomaly"), F.count(F.lit(1)).alias("n")))
