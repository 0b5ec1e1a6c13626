"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line. Each runs once to warm up, then the median of up to three counts (fewer once a query has taken 10 s)."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from emberlog.operators import changelog  # noqa: E402
from emberlog.plans import catalog  # noqa: E402

HEADLINE = ["kv_snapshot", "kv_multi_get", "kv_as_of_seq", "seq_increment", "http_replay", "merge_l0_l1", "merge_layout", "sparse_index", "bloom_build", "bloom_test", "wal_json_roundtrip", "datagen_load", "kv_update_only", "hot_counter"]


def hot_counter(spark, sf):
    """A million increments of one key."""
    return changelog.counters(spark.range(1_000_000).select(F.lit("hot").alias("key"), F.col("id").alias("seq"), F.lit(False).alias("deleted")))


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, out = {**catalog.QUERIES, "hot_counter": hot_counter}, {}
    for name in HEADLINE:
        took = []
        while len(took) < 4 and (len(took) < 2 or sum(took) < 10):
            began = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        out[name] = round(statistics.median(took[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
