"""What a change of lookup or parse rule would change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abaculus.operators.lookups import resolve
from abaculus.operators.merging import diff

TRACE = ("src_file", "src_relpath", "processed_at")


def lookup_impact(df: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_subject, new_subject, n, n_accounts) of rows whose subject would differ."""
    a = resolve(df.select("txn_uid", "account"), old).select("txn_uid", "account", F.coalesce("found_subject", F.lit("")).alias("old_subject"))
    both = resolve(a, new).withColumn("new_subject", F.coalesce("found_subject", F.lit("")))
    return both.where("old_subject <> new_subject").groupBy("old_subject", "new_subject").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("account").alias("n_accounts"))


def rule_impact(cells: DataFrame, old: Callable[[DataFrame], DataFrame], new: Callable[[DataFrame], DataFrame], fields: tuple[str, ...]) -> DataFrame:
    """Differences of two extractions of the same sheets, by file, sheet and row; traceability columns don't count."""
    at = F.concat_ws("|", "file", "sheet", F.col("row").cast("string"))
    return diff(old(cells).withColumn("at", at), new(cells).withColumn("at", at), tuple(f for f in fields if f not in TRACE), "at", "row")
