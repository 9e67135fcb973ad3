"""SQLite databases in a shared folder, a file per range of a numeric key.

For executors in processes of their own and no database server between them: a range's file is
copied to the task, changed by SQL there and published anew in the folder of the next version, so
a repeated task changes nothing twice. Ranges are written and read by one task each. Columns are
whole numbers, doubles and texts. Rows without a value of the key are in the first range.
"""

from __future__ import annotations

import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from abaculus.operators.query import first_per_key
from abaculus.session import ship_package

FETCH_ROWS = 10_000


def _copy(uri: str, target: Path) -> None:
    store, path = pa.fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as source, target.open("wb") as out:
        shutil.copyfileobj(source, out, 1 << 20)


def _publish(source: Path, uri: str, attempt: int) -> None:
    """Under the attempt's own name first, then moved in place."""
    store, path = pa.fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with source.open("rb") as held, store.open_output_stream(f"{path}.{attempt}.part") as out:
        shutil.copyfileobj(held, out, 1 << 20)
    store.move(f"{path}.{attempt}.part", path)


class RangedTable:
    """A table of ``schema`` in ``parts`` ranges of ``key`` between ``low`` and ``high`` (values beyond are in the outer ranges)."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, low: int | None, high: int | None, parts: int):
        folder = folder if ":/" in folder else f"file://{folder}"
        self.spark, self.folder, self.schema, self.key, self.parts, self.version = spark, folder, schema, key, parts, 0
        self.low = low or 0
        self.width = max(1, -(-((high or 0) - self.low + 1) // parts))

    def append(self, df: DataFrame) -> int:
        return self._change(df, "")

    def upsert(self, df: DataFrame, order: str | None = None) -> int:
        """Insert the rows whose key the table lacks, of rows with one key the first by ``order``; returns their number."""
        first = first_per_key(df, [self.key], [F.col(order or self.key)])
        return self._change(first, f' where not exists (select 1 from t where "{self.key}" = ?{self.schema.names.index(self.key) + 1})')

    def _change(self, df: DataFrame, condition: str) -> int:
        folder, old, names, key = self.folder, self.version, self.schema.names, self.key
        insert = f"insert into t select {', '.join(f'?{i + 1}' for i in range(len(names)))}{condition}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            with tempfile.TemporaryDirectory() as scratch:
                place, link, local = None, None, Path(scratch) / "range.db"

                def finish() -> pa.RecordBatch:
                    added = link.total_changes
                    link.commit()
                    link.close()
                    _publish(local, f"{folder}/{old + 1}/{place:06d}.db", TaskContext.get().taskAttemptId())
                    local.unlink()
                    return pa.RecordBatch.from_pydict({"added": [added]})

                for batch in batches:
                    places, held = (batch.column(c).to_pylist() for c in ("place", "held"))
                    rows = list(zip(*(batch.column(c).to_pylist() for c in names)))
                    cuts = [i for i in range(len(places)) if not i or places[i] != places[i - 1]] + [len(places)]
                    for a, b in zip(cuts, cuts[1:]):
                        if places[a] != place:
                            if link:
                                yield finish()
                            place = places[a]
                            if old:
                                _copy(f"{folder}/{old}/{place:06d}.db", local)
                            link = sqlite3.connect(local)
                            link.execute("pragma journal_mode = off")  # a copy of the task's own
                            if not old:
                                link.execute(f"create table t ({', '.join(f'"{c}"' for c in names)})")
                                link.execute(f'create index by_key on t ("{key}")')
                        link.executemany(insert, [r for r, h in zip(rows[a:b], held[a:b]) if h])
                if link:
                    yield finish()

        ship_package(self.spark)
        place = F.expr(f"cast(greatest(0, least({self.parts - 1}, coalesce((`{key}` - {self.low}) div {self.width}, 0))) as int)")
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], place.alias("place"), F.lit(True).alias("held"))
        every = self.spark.range(self.parts).select(F.col("id").cast("int").alias("place"), F.lit(False).alias("held"))  # ranges without new rows are handed on too
        dealt = rows.unionByName(every, allowMissingColumns=True).repartition(self.parts, "place").sortWithinPartitions("place")
        added = dealt.mapInArrow(run, "added long").agg(F.sum("added")).first()[0]
        self.version += 1
        return added

    def read(self, condition: str = "true", columns: list[str] | None = None) -> DataFrame:
        """The rows that meet a condition of the database's SQL, a partition per range."""
        folder, version = self.folder, self.version
        schema = StructType([self.schema[c] for c in columns or self.schema.names])
        arrow, query = to_arrow_schema(schema), f"select {', '.join(f'"{c}"' for c in schema.names)} from t where {condition}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with tempfile.TemporaryDirectory() as scratch:
                local = Path(scratch) / "range.db"
                for batch in batches:
                    for place in batch.column(0).to_pylist():
                        _copy(f"{folder}/{version}/{place:06d}.db", local)
                        with closing(sqlite3.connect(local)) as link:
                            found = link.execute(query)
                            while rows := found.fetchmany(FETCH_ROWS):
                                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        ship_package(self.spark)
        return self.spark.range(0, self.parts, 1, self.parts).mapInArrow(run, schema)
