"""Times the headline log queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) has the tables, BENCH_CPUS (default 8) the cores.
Each query writes its whole result to Spark's ``noop`` sink; the first, untimed run of a
small query starts the engine.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "filter_ids", "filter_layers", "filter_conditions", "filter_text_regex", "payload_semi_join", "column_metadata", "column_values", "capture_diff",
    "interval_join", "parent_as_of", "greedy_burst", "logon_sessions", "record_gaps", "tags_context", "tag_summary", "ioc_table", "threat_match",
    "chain_brute_force", "chain_process_tree", "surprisal_command", "composite_score", "script_blocks", "json_ingest",
    "rule_brute_force", "log_ioc_table", "process_parents",
]


def main() -> None:
    from pyspark.sql import SparkSession

    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    os.environ["PYTHONPATH"] = os.pathsep.join([here, os.environ.get("PYTHONPATH", "")])  # for Spark's Python workers
    from sparklog import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("filter_ids")
    took = {}
    for name in HEADLINE:
        began = time.time()
        run(name)
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "log_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
