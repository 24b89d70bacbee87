"""Wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from sitegauge.plans.registry import QUERIES
from sitegauge.session import local_session

HEADLINE = (
    "rescore", "rescore_transitions", "quality_histogram", "page_structure", "declared_languages", "site_signal", "page_emails",
    "email_extract", "page_fingerprint", "glyph_ratio", "lexicon_prepare", "text_verdicts", "text_classes", "rule_hits",
    "review_signal", "owner_scores", "cheap_filter", "publish_order", "placement", "notes_collected", "merge_sightings",
    "upsert_places", "quota_cut", "running_usage", "threshold_whatif", "queue_profile", "stall_gaps", "work_sessions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
