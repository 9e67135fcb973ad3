"""Dates: parsing, period keys, accounting periods and day classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN, UNKNOWN_PERIOD = "未知", "未知期间"
FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "yyyy年M月d日", "M/d/yyyy", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy-M-d'T'H:m:s", "yyyyMMdd HHmmss")


def parse_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """Date of a text in one of ``formats``, tried in order; null if none fits."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def parse_date_or_keep(c: Column) -> Column:
    """ISO text of the date; an unreadable text is kept as it is."""
    return F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), F.trim(c.cast("string")))


def year_month(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM"), F.lit(UNKNOWN))


def period_key(d: Column, period: str = "month") -> Column:
    """2024-03, 2024Q1, 2024 or 2024-W01 (ISO week and its year)."""
    year = F.year(d).cast("string")
    iso_year = F.year(F.date_add(d, (4 - (F.weekday(d) + 1)).cast("int")))
    key = {
        "month": F.date_format(d, "yyyy-MM"),
        "quarter": F.concat(year, F.lit("Q"), F.quarter(d).cast("string")),
        "year": year,
        "week": F.concat(iso_year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0")),
    }[period]
    return F.coalesce(key, F.lit(UNKNOWN))


def monthly_period(d: Column, cutoff: int = 31) -> Column:
    """First day of the accounting month: days after the cutoff (or the month's last day) belong to the next."""
    first = F.trunc(d, "MM").cast("date")
    return F.when(F.day(d) > F.least(F.lit(cutoff), F.day(F.last_day(d))), F.add_months(first, 1)).otherwise(first)


def accounting_month(d: Column, cutoff: int = 31) -> Column:
    return F.coalesce(F.date_format(monthly_period(d, cutoff), "yyyy-MM"), F.lit(UNKNOWN_PERIOD))


def accounting_quarter(d: Column, cutoff: int = 31, fiscal_start: int = 1) -> Column:
    """'2024-Q1' by fiscal years named after the year they begin in; the cutoff only matters in a quarter's last month."""
    shifted = F.month(d) - fiscal_start  # months since the fiscal year began, below zero before it
    year = F.year(d) + F.floor(shifted / 12).cast("int")
    month = F.pmod(shifted, F.lit(12))
    late = (month % 3 == 2) & (F.day(d) > F.least(F.lit(cutoff), F.day(F.last_day(d))))
    quarter = F.floor(month / 3).cast("int") + late.cast("int")
    label = F.concat((year + F.floor(quarter / 4).cast("int")).cast("string"), F.lit("-Q"), (F.pmod(quarter, F.lit(4)) + 1).cast("string"))
    return F.coalesce(label, F.lit(UNKNOWN_PERIOD))


def day_class(d: Column, holiday: Column, adjusted: Column) -> Column:
    """Adjusted workday before holiday before weekend before workday; a null date is a workday."""
    return F.when(d.isNull(), "工作日").when(adjusted.isNotNull(), "调休工作日").when(holiday.isNotNull(), "节假日").when(F.weekday(d) >= 5, "周末").otherwise("工作日")
