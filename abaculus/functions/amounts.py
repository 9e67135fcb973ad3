"""Amounts: parsing, picking, signs and directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MONEY = "decimal(20,2)"
FULL_WIDTH, HALF_WIDTH = "０１２３４５６７８９．，－＋（）", "0123456789.,-+()"


def to_float(c: Column) -> Column:
    """Number of a trimmed plain text; anything else is null (no thousands separators)."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def is_numeric(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "false"), F.lit(False)) | to_float(c).isNotNull()


def parse_amount(c: Column) -> Column:
    """Amount of a formatted text: separators, full-width forms and currency marks go, (x) is negative;
    dashes and 无 are null. As decimal(20,2)."""
    text = F.translate(F.trim(c.cast("string")), FULL_WIDTH, HALF_WIDTH)
    text = F.regexp_replace(text, r"CNY|RMB|[,¥￥元\s]", "")
    text = F.regexp_replace(text, r"^\((.*)\)$", r"-$1")
    text = F.regexp_replace(text, "^--", "-")
    return F.when(text.rlike(NUMBER), text.try_cast(MONEY))


def parse_amount_or_zero(c: Column) -> Column:
    """``parse_amount`` for personal bills, where a failure counts as zero."""
    return F.coalesce(parse_amount(c), F.lit(0).cast(MONEY))


def pick_amount(payment: Column, receipt: Column) -> Column:
    """|payment| if not zero, else receipt if not zero (with its sign), else null."""
    return F.coalesce(F.nullif(F.abs(payment), F.lit(0)), F.nullif(receipt, F.lit(0)))


def net_amount(payment: Column, receipt: Column) -> Column:
    zero = F.lit(0).cast(MONEY)
    return F.when(payment.isNull() & receipt.isNull(), None).otherwise(F.coalesce(payment, zero) + F.coalesce(receipt, zero))


def direction(payment: Column, receipt: Column) -> Column:
    """收入, 支出, 收支 (both) or 无流向 (neither)."""
    pays, gets = F.coalesce(payment != 0, F.lit(False)), F.coalesce(receipt != 0, F.lit(False))
    return F.when(pays & gets, "收支").when(gets, "收入").when(pays, "支出").otherwise("无流向")
