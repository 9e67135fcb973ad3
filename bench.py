"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

HEADLINE = (
    "p1_combined_query",
    "g1_query_summary",
    "g6_subject_rollup",
    "g11_top_counterparties",
    "g20_end_balances",
    "j1_subject_resolution",
    "j4_incremental_rows",
    "j5_table_diff",
    "j8_internal_transfers",
    "j9_reconciliation",
    "w1_balance_continuity",
    "a3_counterparty_frequency",
    "a5_amount_anomalies",
    "a12_fee_anomalies",
    "a16_counterparty_rules",
    "a17_cashflow",
    "a20_vouchers",
    "s8_rule_extract",
    "a22_known_issues",
    "t1_tumbling_days",
)


def main() -> None:
    from abaculus.plans.catalog import QUERIES
    from abaculus.session import build_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))  # one machine; a cluster names spark.checkpoint.dir
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # the JVM's start isn't a query's
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "ledger_headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
