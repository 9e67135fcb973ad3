"""Progress of streams as a table."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "run_id string, name string, batch_id long, at string, n_rows long, duration_ms long, metric string, value double"


class ProgressTable(StreamingQueryListener):
    """Appends a row for each batch and observed metric (metric null where none is observed) to a Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.last = spark, path, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = [(f"{name}.{k}", None if v is None else float(v)) for name, row in p.observedMetrics.items() for k, v in row.asDict().items()]
        head = (str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, p.batchDuration)
        self.spark.createDataFrame([(*head, *m) for m in observed or [(None, None)]], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.last[str(p.runId)] = p.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.last[str(event.runId)] = None

    def wait(self, query: StreamingQuery, seconds: int = 60) -> None:
        """Until the end of an ended query has been heard of, as events come later than what they tell of."""
        end = time.time() + seconds
        while self.last.get(str(query.runId), 0) is not None and time.time() < end:
            time.sleep(0.1)


def observed(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """``stream`` whose batches tell these aggregates with their progress."""
    return stream.observe(name, *[c.alias(k) for k, c in metrics.items()])
