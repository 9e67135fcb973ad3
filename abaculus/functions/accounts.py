"""Account numbers, keys and row identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_account(c: Column) -> Column:
    """Text of an account that may have been read as a number: '38812345678.0' becomes '38812345678'; null and NaN become ''."""
    text = F.trim(c.cast("string"))
    text = F.when(text.rlike(r"^\d+\.0*$"), F.regexp_replace(text, r"\.0*$", "")).otherwise(text)
    return F.when(text.isNull() | F.lower(text).isin("nan", "none"), "").otherwise(text)


def account_key(c: Column) -> Column:
    """Account without leading zeros; an empty one or zeros only give '0'."""
    return F.coalesce(F.nullif(F.regexp_replace(normalize_account(c), "^0+", ""), F.lit("")), F.lit("0"))


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(F.nullif(F.lower(c.cast("string")), F.lit("nan"))), F.lit(""))


def match_key(account: Column, txn_id: Column, trade_date: Column, payment: Column, receipt: Column) -> Column:
    """key::txn_id where there is a transaction number, else key::date::payment::receipt."""
    money = lambda c: F.coalesce(c.cast("decimal(20,2)").cast("string"), F.lit(""))
    by_id = F.concat_ws("::", account_key(account), F.trim(txn_id))
    by_value = F.concat_ws("::", account_key(account), F.coalesce(trade_date.cast("string"), F.lit("")), money(payment), money(receipt))
    return F.when(_blank(txn_id).isNotNull(), by_id).otherwise(by_value)


def unique_id(at: Column, *parts: Column) -> Column:
    """20 digits of time and 32 hexadecimal digits; the latter are a digest of ``parts``, so reruns agree."""
    return F.concat(F.date_format(at, "yyyyMMddHHmmssSSSSSS"), F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])))


def row_id(file: Column, row: Column, date: Column, amount: Column, merchant: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (file, row, date, amount, merchant)]))
