"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from probatum.catalog import QUERIES  # noqa: E402

NAMES = ["rule_content_any", "rule_forbidden", "subject_digest_by_source", "applicability_case", "crosswalk_both_ways", "latest_evidence", "evidence_state_as_of", "reconcile_full_outer", "revalidation_split", "chain_links_broken", "monotone_state_fold", "soa_inclusion", "secret_redact", "push_list_complete"]

#: The table whose rows a second are told of some queries.
INPUT = {"rule_content_any": "documents", "latest_evidence": "events", "evidence_state_as_of": "events", "crosswalk_both_ways": "lineitem", "chain_links_broken": "events"}


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()  # compile, read into the page cache
        runs = []
        for _ in range(3):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(sorted(runs)[1], 3)
    rows = {name: spark.read.parquet(f"{sf}/{t}.parquet").count() for name, t in INPUT.items()}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_second": {name: round(n / took[name]) for name, n in rows.items()}, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
