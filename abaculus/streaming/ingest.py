"""Directory ingestion and windowed checks as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from abaculus.operators.merging import new_rows
from abaculus.sources.tables import month


def watch(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", archive: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream, each once; with ``archive`` finished files move there."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def _known(spark: SparkSession, table: str, rows: DataFrame, key: str) -> DataFrame:
    """The table's keys; none while it has no folder yet."""
    try:
        return spark.read.parquet(table).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return rows.select(key).limit(0)


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier batch had, one of each key (of rows that come in one batch any one).

    The state is the keys, in RocksDB and without expiry: a batch looks its own keys up and doesn't read what was ever written.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.dropDuplicates([key])


def ingest(stream: DataFrame, table: str, checkpoint: str, key: str = "match_key", part: Column | None = None, once: bool = True, interval: str = "30 seconds", transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append rows whose key has not been seen, every batch in a folder of its own, partitioned by ``part``, the month unless given.

    A batch that runs again gets the state of the batch before it and overwrites its folder, so a restart neither loses
    rows nor adds any twice. What a table holds before the stream's first batch is looked up in that batch alone.
    """
    rows = first_seen(transform(stream) if transform else stream, key)

    def write(batch: DataFrame, number: int) -> None:
        if number == 0:
            held = _known(batch.sparkSession, table, batch, key) if not _exists(batch.sparkSession, f"{table}/batch=0") else batch.select(key).limit(0)
            batch = batch.join(held.distinct(), key, "left_anti").select(*batch.columns)
        dealt = batch.withColumn("part", _part(batch, part)).hint("rebalance", F.col("part"))  # few files a part, large parts split
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{table}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def _part(df: DataFrame, part: Column | None) -> Column:
    """``part``, else the month, else one part for all."""
    return (part if part is not None else month() if "trade_date" in df.columns else F.lit("all")).cast("string")


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, folder: str) -> bool:
    store, path = _store(spark, folder)
    return store.exists(path)


def stage(rows: DataFrame, table: str, staging: str, key: str = "match_key", order: str = "txn_uid", part: Column | None = None) -> str:
    """Write what of ``rows`` is new to the table, and a manifest, below ``staging``: a dry run that ``commit`` can make real."""
    rows = rows.withColumn("part", _part(rows, part))
    fresh = new_rows(_known(rows.sparkSession, table, rows, key), rows, key, order)
    fresh.hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(f"{staging}/rows")
    read = rows.sparkSession.read.schema(fresh.schema).parquet(f"{staging}/rows")
    new = read.groupBy("part").agg(F.count(F.lit(1)).alias("n_new"))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_incoming")).join(new, "part", "left")
    found = counts.select("part", "n_incoming", F.coalesce("n_new", F.lit(0)).alias("n_new"))
    found.withColumn("n_duplicate", F.col("n_incoming") - F.col("n_new")).write.mode("overwrite").parquet(f"{staging}/manifest")
    return staging


def manifest(spark: SparkSession, staging: str) -> DataFrame:
    """(part, n_incoming, n_new, n_duplicate) of staged rows."""
    return spark.read.parquet(f"{staging}/manifest")


def commit(spark: SparkSession, staging: str, table: str, batch: int) -> bool:
    """Move staged rows into the table as one batch, by one rename; False if that batch is there already."""
    store, target = _store(spark, f"{table}/batch={batch}")
    if store.exists(target):
        return False
    store.mkdirs(target.getParent())
    if not store.rename(_store(spark, f"{staging}/rows")[1], target):
        raise OSError(f"{staging} could not be moved to {target.toString()}")
    return True


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 day", *keys: str) -> DataFrame:
    """Count and sum per window and keys, with a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,4)")).alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day", *keys: str) -> DataFrame:
    """Count per session of each key, with a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_rows(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once while the watermark has not passed it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_table(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and return its output as a table. In complete mode the last batch stands."""
    if mode == "append":
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
