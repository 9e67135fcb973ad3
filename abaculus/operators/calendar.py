"""Working days and accounting periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abaculus.functions.dates import accounting_month, accounting_quarter, day_class

#: Dates known to be holidays (with names) or adjusted workdays; users add their own calendar.
HOLIDAYS = {"2024-01-01": "元旦", "2024-02-10": "春节", "2024-05-01": "劳动节", "2024-10-01": "国庆节"}
ADJUSTED_WORKDAYS = ("2024-02-04", "2024-02-18")


def calendar(spark: SparkSession, holidays: dict[str, str] | None = None, adjusted: tuple[str, ...] | None = None) -> DataFrame:
    """(day, holiday, adjusted): a few rows a year."""
    rows = [(d, n, None) for d, n in (HOLIDAYS if holidays is None else holidays).items()]
    rows += [(d, None, True) for d in (ADJUSTED_WORKDAYS if adjusted is None else adjusted)]
    return spark.createDataFrame(rows, "day string, holiday string, adjusted boolean").withColumn("day", F.col("day").cast("date"))


def mark_days(df: DataFrame, days: DataFrame) -> DataFrame:
    """``df`` with day_tag, holiday_name and is_workday; an adjusted workday is a workday."""
    marked = df.join(F.broadcast(days.withColumnRenamed("day", "_day")), F.col("trade_date") == F.col("_day"), "left")
    tag = day_class(F.col("trade_date"), F.col("holiday"), F.col("adjusted"))
    return marked.select(*df.columns, tag.alias("day_tag"), F.when(F.col("adjusted").isNull(), F.coalesce("holiday", F.lit(""))).otherwise("").alias("holiday_name")).withColumn("is_workday", F.col("day_tag").isin("工作日", "调休工作日"))


def day_summary(marked: DataFrame) -> DataFrame:
    """Rows by tag, by holiday and by subject and tag, in one pass."""
    t, h, s = F.col("day_tag"), F.col("holiday_name"), F.col("subject")
    return marked.groupingSets([[t], [t, h], [s, t]], "day_tag", "holiday_name", "subject").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


def assign_period(df: DataFrame, kind: str = "month", cutoff: int = 31, fiscal_start: int = 1) -> DataFrame:
    """``df`` with its accounting period."""
    d = F.col("trade_date")
    return df.withColumn("period", accounting_month(d, cutoff) if kind == "month" else accounting_quarter(d, cutoff, fiscal_start))
