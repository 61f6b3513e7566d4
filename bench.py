"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = """
assemble_tags lyric_terms_topk frequency_counter dynamic_score recommend recommend_with_history
dedup_most_complete latest_nonblank_merge clean_lyric_text search_text chart_table last_n
history_preference search_similar nearest_neighbors label_similarity snapshot_flatten snapshot_upsert
audio_measures
""".split()


def main() -> None:
    from tonearm import build_session
    from tonearm.queries import catalogue

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tonearm-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the JVM, the Python workers and the code caches is not part of any query.
    catalogue.QUERIES["parse_filename"](spark, folder).write.format("noop").mode("overwrite").save()
    spent = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec",
        "queries": spent, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
