"""Row numbers over a whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.operators.sizes import broadcast_if_small

#: monotonically_increasing_id() holds the partition above this many bits and the place in it below.
PLACE_BITS = 33


def in_order(df: DataFrame, order: list[Column], partitions: int) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with ``_part`` and ``_place``, the place in the partition from 0.

    The rows stand on a checkpoint, so that a lost executor can't deal them anew.
    """
    dealt = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = F.col("_at")
    return dealt.withColumns({"_part": F.shiftright(at, PLACE_BITS), "_place": at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("_at").checkpoint()


def numbered(df: DataFrame, order: list[Column], name: str = "n", partitions: int | None = None, within: list[str] | None = None) -> DataFrame:
    """``df`` with 1, 2, 3 ... in ``order`` over all rows, or over those with equal ``within`` columns.

    Each range of the order is sorted by a task of its own, so a group that holds most rows is the work of many
    tasks; what was before a range is a prefix sum over one count per range and group. Rows that tie in all of
    ``order`` get any of their numbers.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = within or []
    placed = in_order(df, [F.col(c) for c in groups] + order, partitions)
    sizes = placed.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))  # groups of a range stand one after the other
    earlier = F.sum("_size").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_size")
    before = sizes.select(F.col("_part").alias("_of_part"), *[F.col(c).alias(f"_of_{c}") for c in groups], "_first", earlier.alias("_before"))
    same = F.col("_part") == F.col("_of_part")
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = placed.join(broadcast_if_small(before), same)
    return joined.withColumn(name, F.col("_place") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)
