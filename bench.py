"""Headline-query benchmark: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_QUERIES (comma list,
optional).  Each query is executed to completion with the ``noop`` sink (no collect to the
driver) twice: "cold" is its first run in the session, "warm" the second run with a warm JVM
but with Spark's cache and the trained-model memo cleared, so no result is reused.  The
headline value is the sum of warm times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "polarity_features", "emoji_frequency", "lexicon_anti_join", "stratified_split", "tfidf_transform",
    "score_relational", "predict_sentiment", "top_drivers", "calibration_bins", "feature_ablation",
    "union_results", "pass_rate_pivot", "health_summary", "stream_score", "train_evaluate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)
    from vetolex.session import build_session
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(4, cpus * 2), driver_memory="6g",
                          app_name="vetolex-bench")
    from vetolex.plans import QUERIES, q_experiments, q_train
    # warm the JVM once (parquet reader, codegen) so the first query does not pay for it
    QUERIES["scan_parquet"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    cold, warm = {}, {}
    for name in names:
        for store in (cold, warm):
            # nothing computed by an earlier run is reused: cached frames and trained models are dropped
            spark.catalog.clearCache()
            q_train._MEMO.clear()
            q_experiments._FITS.clear()
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            store[name] = round(time.perf_counter() - t, 3)
        print(f"# {name}: cold {cold[name]}s warm {warm[name]}s", file=sys.stderr, flush=True)
    derived = {}
    if "predict_sentiment" in warm:
        from vetolex.sources.tables import posts_all
        n_posts = posts_all(spark, sf_dir).count()
        # batch throughput against the baseline's per-text inference claim (< 15 ms per text)
        derived = {"posts_scored": n_posts,
                   "predict_sentiment_ms_per_text": round(1000.0 * warm["predict_sentiment"] / max(n_posts, 1), 3)}
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "cold_total": round(sum(cold.values()), 3), "derived": derived,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
