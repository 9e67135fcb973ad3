"""Databases in files per range: changes, odd rows, executors in processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

from abaculus.sources.ranged import RangedTable

CLUSTER = """
import duckdb
from abaculus.plans.catalog import QUERIES, SQL
from abaculus.session import build_session

spark = build_session("cluster", **{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": "SHARED"})
got = QUERIES["s23_jdbc_ranges"](spark, "SF")
duckdb.sql("create view orders as select * from 'SF/orders.parquet'")
want = duckdb.sql(SQL["s23_jdbc_ranges"]).fetchall()
assert sorted(map(tuple, got.collect())) == sorted(want) and got.rdd.getNumPartitions() == 6
print("equal", len(want))
spark.stop()
"""


def test_ranges_reached_by_several_processes(sf_dir, tmp_path):
    script = CLUSTER.replace("SHARED", str(tmp_path)).replace("SF", sf_dir)
    home = str(Path(__file__).parent.parent)
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"PYTHONPATH": home, "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", script], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0 and "equal" in done.stdout, done.stderr[-3000:]


def test_ranged_table(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string, x double")
    table = RangedTable(spark, f"{tmp_path}/db", frame([]).schema, "id", 0, 9, 4)
    assert table.append(frame([(i, f"v{i}", None) for i in range(10)] + [(None, "none", 1.5)])) == 11
    assert table.upsert(frame([(i, f"w{i}", 2.5) for i in [*range(5, 20), *range(5, 20), -3]]), "v") == 11
    assert table.upsert(frame([(i, "again", 0.0) for i in range(5, 20)])) == 0 == table.append(frame([]))
    got = table.read()
    assert got.rdd.getNumPartitions() == 4
    want = [(None, "none", 1.5), (-3, "w-3", 2.5), *[(i, f"v{i}", None) for i in range(10)], *[(i, f"w{i}", 2.5) for i in range(10, 20)]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert [tuple(r) for r in table.read("x > 2 and id < 11", ["v"]).orderBy("v").collect()] == [("w-3",), ("w10",)]
