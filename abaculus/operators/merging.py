"""Incremental merge, table differences, overlays and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abaculus.functions.texts import same_amount, same_value
from abaculus.operators.query import first_per_key

AMOUNTS = ("payment", "receipt", "balance")


def new_rows(existing: DataFrame, incoming: DataFrame, key: str = "match_key", order: str = "txn_uid") -> DataFrame:
    """Incoming rows whose key neither exists nor stands earlier in the batch."""
    return first_per_key(incoming, [key], [F.col(order)]).join(existing.select(key), key, "left_anti").select(*incoming.columns)


def merge_counts(existing: DataFrame, incoming: DataFrame, key: str = "match_key") -> DataFrame:
    """One row: incoming, new and duplicate rows."""
    keys = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = existing.select(key).distinct().withColumn("known", F.lit(True))
    joined = keys.join(known, key, "left")
    fresh = F.count_if(F.col("known").isNull())
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_incoming"), fresh.alias("n_new"), (F.coalesce(F.sum("n"), F.lit(0)) - fresh).alias("n_duplicate"))


def merged(existing: DataFrame, incoming: DataFrame, key: str = "match_key", order: str = "txn_uid") -> DataFrame:
    """Existing rows and the new ones (K1)."""
    return existing.unionByName(new_rows(existing, incoming, key, order), allowMissingColumns=True)


def diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...], key: str = "match_key", order: str = "txn_uid") -> DataFrame:
    """(key, change, changed_fields) over the full outer join of two tables; amounts within 0.01 are equal."""
    side = lambda df, p: first_per_key(df, [key], [F.col(order)]).select(key, F.struct(*fields).alias(p))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    same = lambda f: (same_amount if f in AMOUNTS else same_value)(F.col(f"o.{f}"), F.col(f"n.{f}"))
    changed = F.array_compact(F.array(*[F.when(~same(f), F.lit(f)) for f in fields]))
    change = F.when(F.col("o").isNull(), "新增").when(F.col("n").isNull(), "删除").when(F.size(changed) > 0, "变更").otherwise("未变")
    none = F.col("o").isNull() | F.col("n").isNull()
    return both.select(key, change.alias("change"), F.when(none, "").otherwise(F.array_join(changed, ",")).alias("changed_fields"))


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def field_histogram(changes: DataFrame) -> DataFrame:
    """How often each field changed."""
    rows = changes.where("changed_fields <> ''").select(F.explode(F.split("changed_fields", ",")).alias("field"))
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


RECORD_KEY = ("txn_id", "trade_date", "payment", "receipt", "summary")


def compare_records(old: DataFrame, new: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row: total, affected, unaffected, added and removed records by a five-field key.

    Of rows with equal keys the first by txn_uid counts.
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RECORD_KEY])
    changes = diff(old.withColumn("record_key", key), new.withColumn("record_key", key), fields, "record_key")
    count = lambda c: F.count_if(F.col("change") == c)
    return changes.agg(F.count(F.lit(1)).alias("n_total"), count("变更").alias("n_affected"), count("未变").alias("n_unaffected"), count("新增").alias("n_added"), count("删除").alias("n_removed"))


def reconcile(total: DataFrame, statement: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Every account of both sides with status, difference and a note.

    ``total``: account, balance, last_date; ``statement``: account, statement_balance, statement_date.
    """
    both = total.select("account", "balance", "last_date").join(statement.select("account", "statement_balance", "statement_date"), "account", "full_outer")
    d = F.col("balance") - F.col("statement_balance")
    status = F.when(F.col("statement_balance").isNull(), "missing_statement").when(F.col("balance").isNull(), "missing_total").when(F.abs(d) <= F.lit(tolerance).cast("decimal(20,2)"), "matched").otherwise("diff")
    notes = F.concat_ws(";", F.when((status == "diff") & (F.abs(d) >= 10000), "large difference"), F.when(F.col("last_date") != F.col("statement_date"), "dates differ"))
    return both.select("account", "balance", "statement_balance", status.alias("status"), d.alias("difference"), notes.alias("note"))


def reconciliation_summary(rows: DataFrame) -> DataFrame:
    """Counts, sum of absolute differences, and the share matched as text, like 80.0%."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("status") == "matched")
    rate = F.when(n == 0, "0.0%").otherwise(F.concat(F.round(ok * F.lit(100).cast("decimal(10,1)") / n, 1).cast("decimal(10,1)").cast("string"), F.lit("%")))
    return rows.agg(n.alias("n"), ok.alias("n_matched"), F.count_if(F.col("status") == "diff").alias("n_diff"), F.coalesce(F.sum(F.abs("difference")), F.lit(0).cast("decimal(20,2)")).alias("total_difference"), rate.alias("match_rate"))


def apply_edits(table: DataFrame, edits: DataFrame, editable: tuple[str, ...], key: str = "txn_uid") -> DataFrame:
    """The table with non-empty edited cells of editable columns in place."""
    e = edits.select(F.col(key), *[F.nullif(F.trim(F.col(c)), F.lit("")).alias(f"_{c}") for c in editable])
    return table.join(e, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in editable}).select(*table.columns)


def unmatched_edits(table: DataFrame, edits: DataFrame, key: str = "txn_uid") -> DataFrame:
    return edits.join(table.select(key), key, "left_anti")


def deleted(subject: str | None = None, account: str | None = None, start: str | None = None, end: str | None = None) -> Column:
    """Whether a row meets all given conditions; no row does without a condition (K7)."""
    hit = F.lit(any(x is not None for x in (subject, account, start, end)))
    for c, v in (("subject", subject), ("account", account)):
        hit = hit & (F.col(c) == v) if v is not None else hit
    hit = hit & (F.col("trade_date") >= F.lit(start).cast("date")) if start else hit
    hit = hit & (F.col("trade_date") <= F.lit(end).cast("date")) if end else hit
    return F.coalesce(hit, F.lit(False))


def delete_where(table: DataFrame, **conditions: str | None) -> DataFrame:
    """The table without rows that meet all given conditions (K7)."""
    return table.where(~deleted(**conditions))


def manifest(files: DataFrame) -> DataFrame:
    """Files and records by status and in all (K9)."""
    return files.groupingSets([[F.col("status")], []], "status").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_files"), F.sum("n_records").alias("n_records"))
