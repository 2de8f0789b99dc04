"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "overlap_counts", "normalize_timeline", "token_intervals", "expand_chars", "pad_regions", "layout", "locate", "ripple_clips", "ripple_captions",
    "classify", "segment_captions_text", "signals", "lexicon_hits", "normalize_text", "split_text", "strip_marks", "gap_captions", "pack_batches", "reconcile_model",
    "eligible_candidates", "place_markers", "concurrency_mix", "coverage_quality", "chars_in_regions", "validate", "review_counts", "exportable",
    "review_state", "edit_key", "caption_events", "match_assets",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from cuetable import bindings
    from cuetable.checks.registry import collect
    from cuetable.plans.folders import release

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = collect("QUERIES")
    queries["active_jobs"](spark, sf_dir).collect()  # starts the executors
    for relation in (bindings.captions, bindings.clips):  # derived relations are not timed
        relation(spark, sf_dir).count()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    release(spark)
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
