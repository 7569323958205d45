"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Stages are timed separately and reported honestly:
  catalogue_store   the stand-in catalogue (files + commits) written as parquet
  hierarchy_store   the hierarchy level tables written once (the load job's stage)
  standin_store     the other stand-in inputs (XML layout, push feed, workspace) written once
  <query>           each registered query, fully executed (noop sink, no pruning)

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None

    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="lectern-bench-")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("lectern-bench")
             .config("spark.sql.shuffle.partitions", str(max(8, cpus * 2)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "16g"))
             .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR", scratch))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from lectern.plans.queries import QUERIES
    from lectern.plans.registry import ctx, stored_ctx
    from lectern.session import checkpoint_dir

    checkpoint_dir(spark)
    times: dict[str, float] = {}

    t0 = time.time()
    c = ctx(spark, sf_dir)
    c.files.count()
    c.commits.count()
    times["catalogue_store"] = round(time.time() - t0, 3)

    t0 = time.time()
    h = stored_ctx(spark, sf_dir).h
    for name in ("courses", "chapters", "sequentials", "verticals", "blocks"):  # each is written when first read
        getattr(h, name)
    times["hierarchy_store"] = round(time.time() - t0, 3)

    # the other stand-in inputs (XML layout, push feed, workspace) are written once too
    from lectern.sources import catalogue
    from lectern.sources.catalogue_xml import xml_files
    from lectern.sources.push import push_deliveries
    t0 = time.time()
    catalogue.stored(spark, sf_dir, "xml_files", xml_files).count()
    catalogue.stored(spark, sf_dir, "push_deliveries", lambda s, d: push_deliveries(s, d)).count()
    catalogue.stored(spark, sf_dir, "workspace", catalogue.workspace_files).count()
    times["standin_store"] = round(time.time() - t0, 3)

    failed = []
    for name in sorted(QUERIES):
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as exc:  # noqa: BLE001 - report and go on
            failed.append(f"{name}: {str(exc).splitlines()[0][:200]}")
    stages = ("catalogue_store", "hierarchy_store", "standin_store")
    query_total = round(sum(v for k, v in times.items() if k not in stages), 3)
    out = {"metric": "sum_query_seconds", "value": query_total, "unit": "sec", "queries": times, "sf": sf,
           "cpus": cpus, "stages_total": round(sum(times.values()), 3)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
