"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1), local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution, nothing collected).
Prints one JSON line: {"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "q05_main_pages", "q08_usage_statistics", "q13_training_titles", "l01_upsert_entries",
    "l09_mark_used_tokens", "l16_clean_and_limit", "i02_foreign_keys", "s03_export_nested",
    "t02_word_frequencies", "t04_pair_counts", "t05_learn_merges", "t07_apply_merges", "t10_encode",
    "m08_page_loss", "m11_critical_tokens", "m16_nucleus",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from corpus_ledger.registry import REGISTRY
    from corpus_ledger.session import build_session

    spark = build_session()
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM / session warm-up, not timed
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
