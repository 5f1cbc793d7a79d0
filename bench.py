"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from scrubwell.plans import catalog

HEADLINE = [
    "r1_placeholders_distinct", "v_rule_map_last_wins", "r2_replace_map", "p11_all_have_id", "c_clean_lines", "e_keyword_rules", "r6_backdate",
    "n_hipaa", "t2_merge", "l8_half_split", "w2_threshold", "w2_train_test", "a7_keep_first", "m5_mentions", "u6_gold_diseases", "a15_softmax", "l6_topk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalog.queries(), {}
    found["a1_docs_per_subject"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the first job also starts the workers
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "seconds for the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
