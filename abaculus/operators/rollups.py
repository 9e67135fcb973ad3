"""Summaries and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.functions.dates import year_month

MONEY = "decimal(20,2)"


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _named(c: Column, missing: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(missing))


def flows() -> list[Column]:
    """Count, counts and sums of payments (below zero) and receipts (above zero), and the net."""
    pays, gets = F.col("payment") < 0, F.col("receipt") > 0
    pay, get = F.coalesce(F.sum(F.when(pays, F.col("payment"))), _zero()), F.coalesce(F.sum(F.when(gets, F.col("receipt"))), _zero())
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(pays).alias("n_payment"), F.count_if(gets).alias("n_receipt"),
        pay.alias("payment"), get.alias("receipt"), (pay + get).alias("net"),
    ]


def query_summary(df: DataFrame, missing: str = "未知") -> DataFrame:
    """Totals of all matches, and the same by bank, subject and account, in one pass (G1)."""
    named = df.select("payment", "receipt", *[_named(F.col(c), missing).alias(c) for c in ("bank", "subject", "account")])
    sets = [[], [F.col("bank")], [F.col("subject")], [F.col("account")]]
    return named.groupingSets(sets, "bank", "subject", "account").agg(*flows(), F.grouping_id().alias("level"))


def by(df: DataFrame, *keys: str) -> DataFrame:
    """Count and sums by keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("payment"), _zero()).alias("payment"), F.coalesce(F.sum("receipt"), _zero()).alias("receipt"))


def daily_trend(df: DataFrame, days: int = 30) -> DataFrame:
    """The last ``days`` dates that occur."""
    return by(df.where("trade_date is not null"), "trade_date").orderBy(F.desc("trade_date")).limit(days)


def extent(df: DataFrame) -> DataFrame:
    """Rows, first and last date."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def subject_rollup(df: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Income, expense, net and counts by subject, bank and month and their combinations, in one pass.

    ``exclude`` holds txn_uid of internal transfers. Rows without a non-zero amount don't count.
    """
    if exclude is not None:
        df = df.join(exclude.select("txn_uid"), "txn_uid", "left_anti")
    gets, pays = F.coalesce(F.col("receipt"), _zero()), F.coalesce(F.col("payment"), _zero())
    rows = df.where((gets != 0) | (pays != 0)).select(
        _named(F.col("subject"), "未指定主体").alias("subject"), "bank", year_month(F.col("trade_date")).alias("month"), gets.alias("receipt"), pays.alias("payment")
    )
    s, b, m = F.col("subject"), F.col("bank"), F.col("month")
    income, expense = F.sum("receipt"), F.sum(F.abs("payment"))
    return rows.groupingSets([[s], [s, b], [s, m], [s, b, m], [b], [m], []], "subject", "bank", "month").agg(
        F.grouping_id().alias("level"), income.alias("income"), expense.alias("expense"), (income - expense).alias("net"),
        F.count_if(F.col("receipt") != 0).alias("n_income"), F.count_if(F.col("payment") != 0).alias("n_expense"),
    )


def distincts(df: DataFrame) -> DataFrame:
    """Numbers of subjects, banks and months."""
    return df.agg(F.countDistinct("subject").alias("subjects"), F.countDistinct("bank").alias("banks"), F.countDistinct(year_month(F.col("trade_date"))).alias("months"))


def unmatched_accounts(df: DataFrame) -> DataFrame:
    """Accounts of rows without a subject, most rows first."""
    rows = df.where((F.coalesce(F.trim("subject"), F.lit("")) == "") & (F.coalesce(F.trim("account"), F.lit("")) != ""))
    return rows.groupBy("account").agg(
        F.array_join(F.array_sort(F.collect_set("bank")), ",").alias("banks"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        F.coalesce(F.sum("payment"), _zero()).alias("payment"), F.coalesce(F.sum("receipt"), _zero()).alias("receipt"), F.count(F.lit(1)).alias("n"),
    )


def dashboard_summary(df: DataFrame) -> DataFrame:
    """Totals, distinct subjects and counterparties, range of months, over all rows."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.abs("payment")), _zero()).alias("payment"), F.coalesce(F.sum("receipt"), _zero()).alias("receipt"),
        F.countDistinct(F.nullif(F.trim("subject"), F.lit(""))).alias("subjects"), F.countDistinct(F.nullif(F.trim("counterparty"), F.lit(""))).alias("counterparties"),
        F.min(F.date_format("trade_date", "yyyy-MM")).alias("first_month"), F.max(F.date_format("trade_date", "yyyy-MM")).alias("last_month"),
    )


def monthly_trend(df: DataFrame) -> DataFrame:
    """Payment, receipt, net and count by month; dates out of 2000-2100 don't count."""
    pay, get = F.coalesce(F.sum(F.abs("payment")), _zero()), F.coalesce(F.sum("receipt"), _zero())
    return df.where(F.year("trade_date").between(2000, 2100)).groupBy(F.date_format("trade_date", "yyyy-MM").alias("month")).agg(pay.alias("payment"), get.alias("receipt"), (get - pay).alias("net"), F.count(F.lit(1)).alias("n"))


def _totals(df: DataFrame, key: Column) -> DataFrame:
    pay, get = F.coalesce(F.sum(F.abs("payment")), _zero()), F.coalesce(F.sum("receipt"), _zero())
    return df.groupBy(key).agg(pay.alias("payment"), get.alias("receipt"), (get - pay).alias("net"), (pay + get).alias("total"), F.count(F.lit(1)).alias("n"))


def top_counterparties(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest counterparties by amount moved."""
    name = F.trim("counterparty").alias("counterparty")
    return _totals(df.where(F.coalesce(F.trim("counterparty"), F.lit("")) != ""), name).orderBy(F.desc("total"), "counterparty").limit(k)


def subject_breakdown(df: DataFrame) -> DataFrame:
    """Amounts by subject, blank ones as 未知主体."""
    return _totals(df, _named(F.col("subject"), "未知主体").alias("subject"))


def period_totals(df: DataFrame, period: Column) -> DataFrame:
    """Income, expense, net and counts by period."""
    income, expense = F.coalesce(F.sum(F.when(F.col("receipt") > 0, F.col("receipt"))), _zero()), F.coalesce(F.sum(F.abs(F.when(F.col("payment") < 0, F.col("payment")))), _zero())
    return df.groupBy(period.alias("period")).agg(income.alias("income"), expense.alias("expense"), (income - expense).alias("net"), F.count_if(F.col("receipt") > 0).alias("n_income"), F.count_if(F.col("payment") < 0).alias("n_expense"))


def personal_summary(df: DataFrame) -> DataFrame:
    """Income, expense, net, counts and dates, without transfers."""
    income, expense = F.coalesce(F.sum(F.when(F.col("direction") == "income", F.col("amount"))), _zero()), F.coalesce(F.sum(F.when(F.col("direction") == "expense", F.col("amount"))), _zero())
    return df.where("direction <> 'transfer'").agg(
        income.alias("income"), expense.alias("expense"), (income - expense).alias("net"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("direction") == "income").alias("n_income"),
        F.count_if(F.col("direction") == "expense").alias("n_expense"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        F.countDistinct("bank_name").alias("banks"), F.countDistinct("account_number").alias("accounts"),
    )


def category_breakdown(df: DataFrame, direction: str = "expense") -> DataFrame:
    """Amount, count and share in ten-thousandths by category of one direction."""
    sums = df.where(F.col("direction") == direction).groupBy("category").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    whole = sums.agg(F.sum("amount").alias("whole"))  # one row
    return sums.join(F.broadcast(whole), how="cross").select("category", "amount", "n", F.floor(F.col("amount") * 10000 / F.nullif(F.col("whole"), F.lit(0))).cast("long").alias("share"))


def personal_trend(df: DataFrame) -> DataFrame:
    """Income and expense by month."""
    month = F.substring("trade_date", 1, 7).alias("month")
    return df.where("direction <> 'transfer'").groupBy(month).agg(*[F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), _zero()).alias(d) for d in ("income", "expense")], F.count(F.lit(1)).alias("n"))


def top_merchants(df: DataFrame, direction: str = "expense", k: int = 10) -> DataFrame:
    """The ``k`` merchants with the largest amounts."""
    rows = df.where((F.col("direction") == direction) & (F.coalesce("merchant", F.lit("")) != ""))
    return rows.groupBy("merchant").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("amount"), "merchant").limit(k)


def end_balances(df: DataFrame) -> DataFrame:
    """Balance, date and number of each account's last row by date and transaction."""
    rows = df.where((F.coalesce(F.trim("account"), F.lit("")) != "") & F.col("trade_date").isNotNull())
    last = F.max_by(F.struct("bank", "subject", "balance", "trade_date", "txn_id"), F.struct("trade_date", "txn_id"))
    ends = rows.groupBy("account").agg(last.alias("last"), F.count(F.lit(1)).alias("n"))
    return ends.where("last.balance is not null").select("account", "last.bank", "last.subject", "last.balance", F.col("last.trade_date").alias("last_date"), F.col("last.txn_id").alias("last_txn_id"), "n")


def status_counts(df: DataFrame, day: str, *sums: str) -> DataFrame:
    """Rows and sums by status and by day in one pass."""
    d = F.col(day).cast("date").alias("day")
    return df.select("status", d, *sums).groupingSets([[F.col("status")], [F.col("day")], []], "status", "day").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums])


def top_submitters(df: DataFrame, column: str = "submitter", k: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def folder_totals(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows, sums and numbers of banks, accounts and subjects by folder and in all."""
    rows = None
    for name, df in frames.items():
        one = df.select(F.lit(name).alias("folder"), "bank", "account", "subject", "payment", "receipt")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupingSets([[F.col("folder")], []], "folder").agg(
        F.count(F.lit(1)).alias("n"), F.sum("payment").alias("payment"), F.sum("receipt").alias("receipt"),
        F.countDistinct("bank").alias("banks"), F.countDistinct("account").alias("accounts"), F.countDistinct("subject").alias("subjects"),
    )


def lookup_duplicates(df: DataFrame) -> DataFrame:
    """Account keys that stand more than once, with their subjects."""
    return df.groupBy("account_key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("subjects")).where("n > 1")


def duplicate_transactions(df: DataFrame) -> DataFrame:
    """Rows whose match key occurs more than once, with how often."""
    return df.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("match_key"))).where("copies > 1")


def timings(df: DataFrame, key: str = "operation", value: str = "ms") -> DataFrame:
    """Count, sum, mean, extremes per operation, with flags for slow ones."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 3).alias("total"), F.round(F.avg(value), 3).alias("mean"), F.round(F.max(value), 3).alias("slowest"), F.round(F.min(value), 3).alias("fastest")
    ).withColumn("slow", F.col("mean") > 2000)


def slowest(df: DataFrame, value: str = "ms", tie: str = "event_id", k: int = 5) -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last(), tie).limit(k)
