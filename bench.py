"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quotelens.plans import QUERIES
from quotelens.session import build_session

HEADLINE = (
    "c4_comparison_rows", "c9_purchase_list", "h4_dispersion", "h5_gap_index", "p5_fx_conversion",
    "p16_total_as_unit_price", "m10_match_ranked", "e2_best_format", "t3_prep",
    "l2_alias_confirmation", "w2_sessions", "e16_supplier_detection", "t9_pack_size", "p13_unit_router",
)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["s1_scan_projection"](spark, sf).count()  # JVM warm-up
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
