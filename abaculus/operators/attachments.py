"""Voucher attachments as a table: insert, update, delete and get."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of an attachment that an update may change.
CHANGEABLE = ("path", "attachment_type", "remark")


def insert(table: DataFrame, rows: DataFrame, now: str) -> DataFrame:
    """``table`` and ``rows`` (txn_id, path and, optional, attachment_type, remark and times), with ids above the largest so far.

    Ids grow but may leave gaps, so that no task has to see all rows. A missing type is empty; missing times are ``now``.
    """
    largest = table.agg(F.coalesce(F.max("attachment_id"), F.lit(0)).alias("largest"))  # one row
    at = lambda c: F.coalesce(rows[c], F.lit(now)) if c in rows.columns else F.lit(now)
    fresh = rows.select(
        F.monotonically_increasing_id().alias("nth"), "txn_id", "path",
        (F.coalesce("attachment_type", F.lit("")) if "attachment_type" in rows.columns else F.lit("")).alias("attachment_type"),
        (F.col("remark") if "remark" in rows.columns else F.lit(None).cast("string")).alias("remark"), at("created").alias("created"), at("updated").alias("updated"),
    ).crossJoin(F.broadcast(largest))
    fresh = fresh.withColumn("attachment_id", F.col("largest") + 1 + F.col("nth"))
    return table.unionByName(fresh.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns]))


def update(table: DataFrame, edits: DataFrame, now: str) -> DataFrame:
    """``table`` with the fields of ``edits`` (attachment_id and any of CHANGEABLE) that are not null, empty texts included.

    Rows so changed get ``now`` as their time; edits without a field, and those of unknown ids, change nothing.
    """
    named = [c for c in CHANGEABLE if c in edits.columns]
    if not named:
        return table
    given = edits.select("attachment_id", *[F.col(c).alias(f"_{c}") for c in named]).dropDuplicates(["attachment_id"])
    joined = table.join(given, "attachment_id", "left")
    touched = F.coalesce(*[F.col(f"_{c}") for c in named]).isNotNull()
    changed = {c: F.coalesce(f"_{c}", c) for c in named} | {"updated": F.when(touched, F.lit(now)).otherwise(F.col("updated"))}
    return joined.withColumns(changed).select(*table.columns)


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    """``table`` without the attachments of ``ids``; unknown ids change nothing."""
    return table.join(ids.select("attachment_id"), "attachment_id", "left_anti").select(*table.columns)


def get(table: DataFrame, attachment_id: int) -> DataFrame:
    """The attachment of an id; no row for an unknown one."""
    return table.where(F.col("attachment_id") == attachment_id)
