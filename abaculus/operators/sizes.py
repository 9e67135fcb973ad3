"""Broadcasts behind a count of rows and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType

BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes in its texts, maps and arrays; reads it once."""
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, (NumericType, BooleanType, DateType))]
    held = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in wide), F.lit(0).cast("long"))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0))).first()
    return n <= rows and total <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if is_small(df, rows, size) else df
