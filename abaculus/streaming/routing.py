"""Lines that don't parse or lack what they need, beside those that do (T5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BROKEN = "_broken"


def judged(lines: DataFrame, schema: str, required: tuple[str, ...]) -> DataFrame:
    """``lines`` (value) with ``row``, the line parsed as JSON, and ``reason``, null where it may enter:
    ``unreadable``, or the first required field that is missing."""
    row = F.from_json("value", f"{schema}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    reason = F.when(F.col("row").isNull() | F.col(f"row.{BROKEN}").isNotNull(), "unreadable")
    for c in required:
        reason = reason.when(F.col(f"row.{c}").isNull(), f"no {c}")
    return lines.withColumn("row", row).withColumn("reason", reason)


def route(lines: DataFrame, schema: str, good: str, bad: str, checkpoint: str, required: tuple[str, ...] = (), once: bool = True, interval: str = "30 seconds") -> StreamingQuery:
    """Rows into ``good``, the other lines with their reason and file into ``bad``; each batch has a folder in both.

    ``lines`` is a stream of text files (value). A batch that runs again overwrites both folders.
    """
    columns = [f.strip().split()[0] for f in schema.split(",")]
    found = judged(lines.select("value", F.col("_metadata.file_path").alias("file")), schema, required)

    def write(batch: DataFrame, number: int) -> None:
        batch.where("reason is null").select(*[F.col(f"row.{c}").alias(c) for c in columns]).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("reason is not null").select("value", "file", "reason").write.mode("overwrite").parquet(f"{bad}/batch={number}")

    writer = found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
