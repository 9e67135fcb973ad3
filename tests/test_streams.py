"""Streams over folders: restarts, routing, staging, progress and stability."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from abaculus.sources import tables
from abaculus.streaming import ingest, progress, routing, stability


def forget_commit(state, batch):
    """As if the run had ended between a batch's output and its commit."""
    for name in (f"{batch}", f".{batch}.crc"):
        (state / "commits" / name).unlink(missing_ok=True)


def test_ingest_runs_a_batch_again_without_loss_or_twice(spark, tmp_path):
    inbox, table, state = tmp_path / "in", str(tmp_path / "table"), tmp_path / "state"
    rows = lambda a, z: spark.sql(f"select 'K'||(id % 50) as match_key, id as txn_uid, date'2024-01-01' + cast(id % 90 as int) as trade_date from range({a}, {z})")
    run = lambda: ingest.ingest(ingest.watch(spark, str(inbox), rows(0, 1).schema), table, str(state)).awaitTermination()
    for (a, z), known in (((0, 30), 30), ((20, 60), 50), ((0, 5), 50)):
        rows(a, z).write.mode("append").parquet(str(inbox))
        run()
        keys = [r.match_key for r in spark.read.parquet(table).select("match_key").collect()]
        assert len(keys) == len(set(keys)) == known
    forget_commit(state, 1)
    run()
    keys = [r.match_key for r in spark.read.parquet(table).select("match_key").collect()]
    assert len(keys) == len(set(keys)) == 50
    assert "part" in spark.read.parquet(table).columns


def test_first_batch_knows_what_the_table_holds(spark, tmp_path):
    rows = spark.sql("select 'K'||id as match_key, id as txn_uid, date'2024-01-01' as trade_date from range(10)")
    table, staging = str(tmp_path / "table"), str(tmp_path / "staging")
    assert ingest.commit(spark, ingest.stage(rows.where("txn_uid < 4"), table, staging), table, 900)
    assert not ingest.commit(spark, staging, table, 900)
    assert [tuple(r) for r in ingest.manifest(spark, staging).collect()] == [("2024-01", 4, 4, 0)]
    rows.write.parquet(str(tmp_path / "in"))
    ingest.ingest(ingest.watch(spark, str(tmp_path / "in"), rows.schema), table, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.txn_uid for r in spark.read.parquet(table).collect()) == list(range(10))
    again = ingest.stage(rows, table, str(tmp_path / "again"))
    assert [tuple(r) for r in ingest.manifest(spark, again).collect()] == [("2024-01", 10, 0, 10)]


def test_routing_keeps_every_line_on_one_side(spark, tmp_path):
    lines = [json.dumps({"a": n, "b": str(n)}) for n in range(5)] + ['{"a": 7', "", "null", '{"b": "x"}', '{"a": "no number", "b": "y"}', "[1]"]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "x.txt").write_text("\n".join(lines) + "\n")
    good, bad, state = str(tmp_path / "good"), str(tmp_path / "bad"), tmp_path / "state"
    for _ in range(2):
        routing.route(ingest.watch(spark, str(folder), "value string", "text"), "a long, b string", good, bad, str(state), ("a",)).awaitTermination()
        rows, left = spark.read.parquet(good).collect(), spark.read.parquet(bad).collect()
        assert sorted(r.a for r in rows) == list(range(5)) and len(rows) + len(left) == len(lines)
        assert {r.value: r.reason for r in left}['{"b": "x"}'] == "no a" and {r.value: r.reason for r in left}['{"a": 7'] == "unreadable"
        assert all(r.file.endswith("x.txt") for r in left)
        forget_commit(state, 0)


def test_files_pass_once_they_have_stayed(spark, tmp_path):
    start = datetime(2024, 1, 1)
    seen = lambda path, size, at, locked=False, modified=1: (path, size, modified, start + timedelta(seconds=at), locked)
    batches = [
        [seen("grows", 1, 0), seen("grows", 2, 10), seen("stays", 5, 0), seen("stays", 5, 10), seen("locked", 9, 0)],
        [seen("grows", 2, 41), seen("stays", 5, 30), seen("stays", 5, 60), seen("locked", 9, 20, True), seen("touched", 3, 20), seen("locked", 9, 40)],
        [seen("grows", 3, 50), seen("grows", 3, 80), seen("locked", 9, 69), seen("locked", 9, 70), seen("touched", 3, 60, modified=2), seen("stays", 5, 1)],
    ]
    schema = "path string, size long, modified long, seen_at timestamp, locked boolean"
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = stability.stable_files(ingest.watch(spark, folder, spark.createDataFrame([], schema).schema), 30)
        found = ingest.run_to_table(spark, stream, out, state)
    got = sorted((r.path, r.size, (r.seen_at - start).total_seconds()) for r in found.collect())
    assert got == [("grows", 2, 41.0), ("grows", 3, 80.0), ("locked", 9, 70.0), ("stays", 5, 30.0)]


def test_progress_of_batches_without_metrics(spark, tmp_path):
    spark.range(20).repartition(2).write.parquet(str(tmp_path / "in"))
    listener = progress.ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    try:
        query = ingest.watch(spark, str(tmp_path / "in"), "id long", files_per_batch=1).writeStream.queryName("plain").format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    rows = spark.read.schema(progress.SCHEMA).parquet(str(tmp_path / "progress")).where("n_rows > 0").collect()
    assert sum(r.n_rows for r in rows) == 20 and {(r.name, r.metric, r.value) for r in rows} == {("plain", None, None)}


def test_months_rewritten_in_place(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.sql("select 'U'||id as txn_uid, 'K'||id as match_key, 'S'||(id % 2) as subject, 'A' as account, date'2024-01-01' + cast(id as int) as trade_date, 'old' as summary from range(120)")
    tables.write_ledger(rows, path)
    stamp = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "ledger").rglob("*.parquet")}
    before = stamp()
    assert tables.delete_in_place(spark, path, subject="S1", start="2024-02-01", end="2024-02-29") == ["2024-02"]
    kept = {p: t for p, t in before.items() if "2024-02" not in str(p)}
    assert kept.items() <= stamp().items()
    assert tables.delete_in_place(spark, path, start="2024-03-01", end="2024-03-31") == ["2024-03"] and not (tmp_path / "ledger" / "trade_month=2024-03").exists()
    assert tables.delete_in_place(spark, path, subject="none") == [] == tables.delete_in_place(spark, path)
    tables.edit_in_place(spark, path, spark.createDataFrame([("U3", "2024-01", "new"), ("U4", "2024-01", " "), ("gone", "2023-01", "x")], "txn_uid string, trade_month string, summary string"), ("summary",))
    got = {r.txn_uid: r.summary for r in tables.read_ledger(spark, path).collect()}
    assert len(got) == 120 - 15 - 31 and got["U3"] == "new" and got["U4"] == "old"


def test_database_upsert_and_ranges(spark):
    url = "jdbc:derby:memory:units;create=true"
    rows = lambda a, z: spark.sql(f"select id as ID, 'v'||id as V from range({a}, {z})").withColumnsRenamed({"id": "ID", "v": "V"})
    tables.write_jdbc(rows(0, 10), url, "T")
    assert tables.upsert_jdbc(rows(5, 20).union(rows(5, 20)), url, "T", "ID", "V") == 10
    assert tables.upsert_jdbc(rows(5, 20), url, "T", "ID") == 0
    found = tables.read_jdbc(spark, url, "T", "ID", 4)
    assert found.rdd.getNumPartitions() == 4 and sorted(r.ID for r in found.collect()) == list(range(20))
    plan = found.where("V = 'v3'").select("ID")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(V), *EqualTo(V,v3)]" in plan
    with pytest.raises(Exception, match="NOWHERE"):
        tables.upsert_jdbc(rows(0, 1), url, "NOWHERE", "ID")


def test_frequent_spans_are_native(spark):
    stream = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.col("value").alias("k"))
    assert stability.frequent(stream, 7, 5, "1 day", "k").columns == ["window", "k", "n"]
