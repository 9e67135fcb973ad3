"""Tables in folders and databases: partitioned ledgers, JDBC, samples, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abaculus.operators import merging
from abaculus.operators.merging import new_rows
from abaculus.operators.query import first_per_key


def month() -> Column:
    return F.date_format("trade_date", "yyyy-MM")


def write_ledger(df: DataFrame, path: str, mode: str = "append") -> None:
    """Ledger partitioned by month, so date filters prune folders. Rows of a month are spread over
    several tasks, since one month may hold a large share."""
    spread = F.pmod(F.xxhash64("match_key"), F.lit(16))
    df.withColumn("trade_month", month()).repartition("trade_month", spread).write.mode(mode).partitionBy("trade_month").parquet(path)


def upsert_ledger(spark: SparkSession, incoming: DataFrame, path: str) -> None:
    """Append the rows whose match key is not in the table (K5); errors are not swallowed.

    A key may come again with another date, so all months are asked, of the table for its keys alone. Many
    small additions are better made by ``streaming.ingest``, whose state knows the keys.
    """
    write_ledger(new_rows(spark.read.parquet(path).select("match_key"), incoming, "match_key"), path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("trade_month")


def rewrite_months(spark: SparkSession, path: str, hit: Column, changed: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Put ``changed`` of the rows in place of a ledger's months in which ``hit`` holds for a row (K7, K8); other months aren't touched.

    ``changed`` gets all rows of those months. They are written anew by dynamic partition overwrite, from a checkpoint, and
    folders of months that nothing is left of go. Returns the months.
    """
    table = spark.read.parquet(path)
    months = sorted(r[0] for r in table.where(hit).select("trade_month").distinct().collect())  # a name per month
    if not months:
        return months
    left = changed(table.where(F.col("trade_month").isin(months))).checkpoint()
    kept = {r[0] for r in left.select("trade_month").distinct().collect()}
    dealt = left.hint("rebalance", F.col("trade_month"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_month").parquet(path)
    jvm = spark.sparkContext._jvm
    for month_name in set(months) - kept:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/trade_month={month_name}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return months


def delete_in_place(spark: SparkSession, path: str, **conditions: str | None) -> list[str]:
    """Delete the rows that meet all given conditions (as ``merging.delete_where``) from a ledger in a folder (K7)."""
    hit = merging.deleted(**conditions)
    return rewrite_months(spark, path, hit, lambda rows: rows.where(~hit))


def edit_in_place(spark: SparkSession, path: str, edits: DataFrame, editable: tuple[str, ...], key: str = "txn_uid") -> list[str]:
    """Put edited cells (as ``merging.apply_edits``) into a ledger in a folder (K8, K13); ``edits`` also has each row's trade_month."""
    months = edits.select("trade_month").distinct()
    hit = F.col("trade_month").isin([r[0] for r in months.collect()])
    return rewrite_months(spark, path, hit, lambda rows: merging.apply_edits(rows, edits.select(key, *editable), editable, key))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database table, in ``parts`` ranges of a numeric column between its least and largest value; filters and
    columns are pushed down (S23). Rows without a value of the column come with the first range."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and parts > 1:
        low, high = spark.read.format("jdbc").options(url=url, **options).option("query", f"select min({column}) as low_end, max({column}) as high_end from {table}").load().first()
        if low is not None:
            reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(int(high) + 1), numPartitions=str(parts))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def upsert_jdbc(df: DataFrame, url: str, table: str, key: str, order: str | None = None, **options: str) -> int:
    """Insert the rows whose key a database table lacks, of rows with one key the first by ``order``; returns their number (K5, K6).

    Tasks write a staging table beside it; one statement of the database then inserts what is absent, in one
    transaction, so a failure leaves the table as it was, and running it again adds nothing twice.
    """
    staging, spark = f"{table}_staging", df.sparkSession
    first = first_per_key(df, [key], [F.col(order or key)])
    write_jdbc(first, url, staging, "overwrite", **options)
    names = ", ".join(f'"{c}"' for c in df.columns)
    properties = spark.sparkContext._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    link = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        statement = link.createStatement()
        added = statement.executeUpdate(f'insert into {table} ({names}) select {names} from {staging} s where not exists (select 1 from {table} t where t."{key}" = s."{key}")')
        statement.executeUpdate(f"drop table {staging}")
        return added
    finally:
        link.close()


def read_samples(spark: SparkSession, path: str, schema: str, keep: int = 50) -> DataFrame:
    """Records of the newest ``keep`` sample files, {"saved_at": ..., "bank": ..., "records": [...]} each."""
    files = spark.read.schema(f"saved_at timestamp, bank string, records array<struct<{schema}>>").json(path, multiLine=True)
    newest = files.orderBy(F.desc("saved_at"), "bank").limit(keep)
    return newest.select("saved_at", "bank", F.inline("records"))


def append_batch(df: DataFrame, path: str) -> None:
    """Bookkeeping of import batches."""
    df.write.mode("append").parquet(path)


def latest_batches(spark: SparkSession, path: str, k: int = 10) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("batch_id")).limit(k)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A result as JSON lines, CSV with a header, or Parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else getattr(writer, kind)(path)
