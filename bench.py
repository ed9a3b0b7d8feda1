"""Headline queries timed on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores) and
optionally BENCH_QUERIES (comma-separated names) choose what runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftline.queries import QUERIES  # noqa: E402
from siftline.session import build_session  # noqa: E402

HEADLINE = (
    "signal_summary",
    "zero_width_report",
    "homoglyph_clean",
    "url_extract",
    "mark_all",
    "bulk_rule_counts",
    "dedup_keep_first",
    "priority_merge",
    "corpus_summary",
    "simhash_blake2b",
    "near_dup_pairs",
    "outbreak_flags",
    "outbreak_flags_ttl",
    "blast_sizes",
    "candidate_order",
    "undecided_pool",
    "stratified_split",
    "macro_metrics",
    "classify_messages",
    "classify_with_outbreaks",
    "review_resolve",
    "confidence_histogram",
    "drift_hourly",
    "paraphrase",
    "adversarial_set",
    "redirect_resolve",
    "ip_classify",
    "outbreak_crowds",
    "new_batch_lookup",
    "drift_stream",
    "classify_stream",
    "ml_train_score",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        "siftline-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["signal_summary"](spark, sf_dir).limit(1).collect()  # start workers, compile
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
