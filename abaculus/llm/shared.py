"""Helpers shared by the training-data operators: shared storage, ASCII case folding, size-checked joins."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from abaculus.session import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A join side is broadcast only while its counted rows and the bytes of its texts and arrays stay within these bounds.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on a single machine) a temporary folder is set; on a
    cluster that would be machine-local, so there an unset folder is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="abaculus-")
        spark.sparkContext.setCheckpointDir(root)
    return root if ":/" in root else f"file://{root}"


class Workspace:
    """A folder of written tables below the shared root; cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return it as a table without lineage."""
        df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII texts take the cheap built-in, which does the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes of texts and arrays; reads it once."""
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, (NumericType, BooleanType))]
    held = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in wide), F.lit(0).cast("long"))
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0))).first()
    return n <= rows and size <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted size is within the bounds; else leave the join to shuffle."""
    return F.broadcast(df) if small(df, rows) else df.hint("merge")


def without_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not in ``dropped``; rows with a null key stay."""
    return docs.join(broadcast_if_small(dropped.select(key)), key, "left_anti").select(*docs.columns)


def prepare_workers(spark: SparkSession) -> None:
    """Ship the package, and bound the bytes of an Arrow batch (a smaller bound of the session stays).

    By default a batch takes 10,000 rows or 64 MB, which executor and worker both hold, more than once.
    """
    ship_package(spark)
    set_to = spark.conf.get(BATCH_CONF, "64m")
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(set_to) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return freed memory of this Python worker, which later tasks and stages reuse, to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def open_fs(uri: str):
    """(pyarrow file system, path in it) of a shared folder's URI; usable on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write, attempt: int) -> None:
    """Write a file under a name of this attempt's own and move it in place, so that a repeated or
    speculative task leaves whole files only. ``write`` gets the open stream."""
    target, path = open_fs(uri)
    target.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{attempt}.part"
    with target.open_output_stream(part) as out:
        write(out)
    target.move(part, path)


def smallest_hashes(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The ``rows`` rows with the smallest hash of ``keys``: a sample bounded whatever the size.

    A cut on the hash leaves about 1.25 times as many rows before they are ordered, so tasks
    don't each send that many to the driver. (The cut may leave a few rows too little, never too many.)
    """
    n = df.count()
    df = df.withColumn("_hash", F.xxhash64(*keys))
    if n > 2 * rows:
        df = df.where(F.col("_hash") < F.lit(int(2**64 * 1.25 * rows / n) - 2**63))
    return df.orderBy("_hash", *keys).limit(rows).drop("_hash")
