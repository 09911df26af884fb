"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfmark.session import local_session  # noqa: E402
from workload import MODULES  # noqa: E402,F401
from workload.registry import QUERIES  # noqa: E402

HEADLINE = (
    "category_rollup", "category_rollup_parts", "taxonomy_node_counts", "attributes_parsed", "product_table",
    "categories_mapped", "labels_indexed", "rare_labels_rolled_up", "refresh_by_keys", "write_by_category",
    "capped_sample", "capped_sample_lines", "hierarchical_cap", "stratified_split", "folds",
    "product_tokens", "normalised_tokens", "document_frequency", "term_frequency", "vocabulary_bands", "rank_share",
    "information_gain", "top_word_overlap", "common_words_by_category", "bigram_profile_common", "dictionary",
    "price_distribution_by_category", "level_accuracy", "confidence_sweep", "confused_by_count", "measurements",
    "word_profile_common", "dictionary_bands", "demographics_profile", "category_ids", "word_embedding", "classifier_tree", "topics_checked",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", **{"spark.ui.showConsoleProgress": "false"})
    chosen = sys.argv[1:] or HEADLINE
    QUERIES["category_rollup"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
