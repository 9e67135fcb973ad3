"""Exact deduplication with streaming keyed state.

A structured stream keeps one state entry per content digest in a disk-backed
(RocksDB) store that never expires: the digest, the stable identifier that
stays, the locator of its content and the number of copies seen. State is
updated by partial aggregates, so a group that holds a third of all rows moves
one row per input partition. Hits (digests seen more than once) are then checked
on their full bytes: a group by digest *and* text, combined before the shuffle.

Defined results: null text counts as empty; of equal texts the row with the
largest id stays; rows that repeat that id all stay (the id is the identity); a
null id never stays over another id; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abaculus.llm.shared import Workspace, broadcast_if_small, lower_az, without_ids

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store takes megabytes of disk before its first row
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",  # of all stores of an executor, outside its heap
}


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), lower_az(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))


def update_registry(spark: SparkSession, arrivals_path: str, registry_path: str, state_path: str, schema) -> None:
    """Feed new files of ``arrivals_path`` (doc_id, digest, locator) to the keyed state, once each.

    May be called again with the same paths as files arrive: the state continues
    from its checkpoint and each batch appends the changed entries to the registry.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(schema)
            .parquet(arrivals_path)
            .groupBy("digest")
            .agg(F.max("doc_id").alias("keep_id"), F.max_by("locator", "doc_id").alias("keep_locator"), F.count(F.lit(1)).alias("group_size"))
        )
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", state_path)
            .trigger(availableNow=True)
            .foreachBatch(lambda changed, batch: changed.write.mode("overwrite").parquet(f"{registry_path}/batch={batch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_registry(spark: SparkSession, registry_path: str) -> DataFrame:
    """The latest entry per digest; the kept columns only grow, so their maxima are the latest."""
    rows = spark.read.schema("digest string, keep_id long, keep_locator string, group_size long, batch int").parquet(registry_path)
    return rows.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max_by("keep_locator", "batch").alias("keep_locator"), F.max("group_size").alias("group_size"))


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (what ``digest`` gives) and keep_locator for every row of ``docs``."""
    spark = docs.sparkSession
    ws = Workspace(spark, "exact-dedup")
    norm = normalised(docs, id_col, text_col).withColumn("digest", digest(F.col("norm")))
    arrivals = ws.write(norm.select("doc_id", "digest", F.concat_ws("#", F.input_file_name(), F.col("doc_id")).alias("locator")), "arrivals")
    update_registry(spark, ws.at("arrivals"), ws.at("registry"), ws.at("state"), arrivals.schema)
    registry = ws.write(read_registry(spark, ws.at("registry")), "entries")
    hits = registry.where("group_size > 1").select("digest")
    texts = norm.join(broadcast_if_small(hits), "digest", "left_semi").groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clashes = ws.write(texts.groupBy("digest").count().where("count > 1").select("digest"), "clashes")
    plain = arrivals.select("doc_id", "digest")
    if clashes.isEmpty():
        found = plain.join(registry, "digest", "left")
    else:  # equal digests of different bytes: these texts are grouped by their bytes
        again = norm.join(clashes, "digest", "left_semi")
        groups = again.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = plain.join(clashes, "digest", "left_anti").join(registry, "digest", "left").unionByName(
            again.join(groups, ["digest", "norm"]).select("digest", "doc_id", "keep_id", F.lit(None).cast("string").alias("keep_locator"), "group_size")
        )
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), "keep_locator")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops."""
    return without_ids(docs, exact_dedup(docs).where("not kept").select("doc_id"))
