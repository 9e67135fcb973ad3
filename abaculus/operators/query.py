"""Filtered queries, sorting, paging and set operations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.functions import amounts, dates
from abaculus.functions.accounts import account_key, normalize_account


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def like(c: Column, part: str) -> Column:
    """Case-blind substring; % and _ of the user act as wildcards."""
    return c.ilike(f"%{part}%")


def account_is(c: Column, part: str) -> Column:
    """The account, or its key without leading zeros, contains ``part`` or its key."""
    key = part.lstrip("0") or "0"
    return like(c, part) | like(account_key(c), key)


def filtered(
    df: DataFrame, subject: str | None = None, account: str | None = None, bank: str | None = None, start: str | None = None, end: str | None = None,
    min_amount: float | None = None, max_amount: float | None = None, counterparty: str | None = None, summary: str | None = None,
) -> DataFrame:
    """Rows that meet all given conditions; dates include both ends."""
    money = lambda x: F.lit(str(x)).cast("decimal(20,2)")
    conditions = [like(F.col(c), v) for c, v in (("subject", subject), ("bank", bank), ("counterparty", counterparty), ("summary", summary)) if v]
    if account:
        conditions.append(account_is(F.col("account"), account))
    if start:
        conditions.append(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        conditions.append(F.col("trade_date") <= F.lit(end).cast("date"))
    if min_amount is not None:
        conditions.append((F.abs("payment") >= money(min_amount)) | (F.col("receipt") >= money(min_amount)))
    if max_amount is not None:
        conditions.append((F.abs("payment") <= money(abs(max_amount))) | (F.col("receipt") <= money(max_amount)))
    return df.where(_all(conditions))


def ordered(df: DataFrame, by: str = "trade_date", ascending: bool = False, allowed: tuple[str, ...] = ("trade_date", "payment", "receipt", "bank", "account", "subject", "counterparty", "balance", "amount"), tie: str = "txn_uid") -> DataFrame:
    """Sorted by an allowed column (else the date), nulls last, ties by ``tie``."""
    c = F.col(by if by in allowed and by in df.columns else "trade_date")
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), tie)


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Limit and offset; without a limit the offset has no effect."""
    return df if limit is None else df.offset(offset).limit(limit)


def personal_query(df: DataFrame, bank: str | None = None, direction: str | None = None, category: str | None = None, merchant: str | None = None, start: str | None = None, end: str | None = None, min_amount: float | None = None, max_amount: float | None = None, limit: int | None = None) -> DataFrame:
    """Personal rows by equality, ranges and a merchant's part, newest first, all of them unless there is a limit."""
    conditions = [F.col(c) == v for c, v in (("bank_name", bank), ("direction", direction), ("category", category)) if v]
    if merchant:
        conditions.append(like(F.col("merchant"), merchant))
    conditions += [F.col("trade_date") >= start] if start else []
    conditions += [F.col("trade_date") <= end] if end else []
    conditions += [F.col("amount") >= F.lit(str(min_amount)).cast("decimal(20,2)")] if min_amount is not None else []
    conditions += [F.col("amount") <= F.lit(str(max_amount)).cast("decimal(20,2)")] if max_amount is not None else []
    return page(ordered(df.where(_all(conditions)), tie="id"), limit)


def voucher_query(df: DataFrame, txn_id: str | None = None, kind: str | None = None, keyword: str | None = None) -> DataFrame:
    """Attachments by transaction, type, and a keyword in remark or path."""
    conditions = [F.col(c) == v for c, v in (("txn_id", txn_id), ("attachment_type", kind)) if v]
    if keyword:
        conditions.append(like(F.col("remark"), keyword) | like(F.col("path"), keyword))
    return df.where(_all(conditions))


def batch_query(df: DataFrame, start: str | None = None, end: str | None = None, status: str | None = None, operator: str | None = None, min_records: int | None = None) -> DataFrame:
    """Batches by date, status, operator's part and size."""
    conditions = [F.col("status") == status] if status else []
    conditions += [F.col("started_at").cast("date") >= F.lit(start).cast("date")] if start else []
    conditions += [F.col("started_at").cast("date") <= F.lit(end).cast("date")] if end else []
    conditions += [like(F.col("operator"), operator)] if operator else []
    conditions += [F.col("n_records") >= min_records] if min_records is not None else []
    return df.where(_all(conditions))


def workflow_list(df: DataFrame, limit: int, offset: int = 0, **equal: str) -> DataFrame:
    """A page of workflows that equal all given values, with the number of all matches (P10)."""
    found = df.where(_all([F.col(k) == v for k, v in equal.items()]))
    total = found.agg(F.count(F.lit(1)).alias("total"))  # one row
    return page(ordered(found, "created_at", allowed=("created_at",), tie="workflow_id"), limit, offset).join(F.broadcast(total), how="cross")


def pipeline_filter(df: DataFrame, banks: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of enabled banks within the trade dates."""
    return filtered(df.where(F.col("bank").isin(banks)), start=start, end=end)


@dataclass
class DerivedColumn:
    name: str
    calculator: str
    settings: dict = field(default_factory=dict)


CALCULATORS: dict[str, Callable[..., Column]] = {
    "net_amount": lambda: amounts.net_amount(F.col("payment"), F.col("receipt")),
    "transaction_direction": lambda: amounts.direction(F.col("payment"), F.col("receipt")),
    "accounting_period": lambda cutoff=31: dates.accounting_month(F.col("trade_date"), cutoff),
}


def derived(df: DataFrame, columns: list[DerivedColumn]) -> DataFrame:
    """Adds configured columns; one with an unknown calculator is null."""
    return df.withColumns({c.name: CALCULATORS[c.calculator](**c.settings) if c.calculator in CALCULATORS else F.lit(None).cast("string") for c in columns})


def lookup_search(df: DataFrame, keyword: str) -> DataFrame:
    """Entries whose subject, account or extra values contain the keyword, whatever its case."""
    k = keyword.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(k), F.lit(False))
    return df.where(has(F.col("subject")) | has(normalize_account(F.col("account"))) | F.coalesce(F.exists(F.map_values("extra"), has), F.lit(False)))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def duplicate_files(df: DataFrame, hash_col: str = "content_hash", order: str = "path") -> DataFrame:
    """Of files with equal content the first is 'processed', the others are 'skipped' (O7)."""
    rank = F.row_number().over(Window.partitionBy(hash_col).orderBy(order))
    return df.withColumn("status", F.when(rank == 1, "processed").otherwise("skipped"))


def column_order(df: DataFrame, enabled: list[str]) -> DataFrame:
    """Enabled columns in order, then the others (K2)."""
    first = [c for c in enabled if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])
