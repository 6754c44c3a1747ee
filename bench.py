"""Time the headline queries and print one JSON line: python bench.py (BENCH_SF_DIR, BENCH_CPUS)."""

import json
import os
import time

from seriesloom.plans import catalog
from seriesloom.session import build_session

HEADLINE = [
    "b02_profile_quality", "b03_min_coverage", "c01_equi_join", "c06_nearest_within", "c09_neighbourhood_join", "d03_describe", "d04_exceedance_count",
    "d05_weighted_mean", "d10_bin_stats", "d15_gini", "d17_dispersion_of_gaps", "d22_duplicates", "e01_ols_trend", "e02_mann_kendall",
    "e06_spearman", "e08_mann_whitney", "e15_model_selection", "e24_skill_scores", "f01_delta", "f05_ewma_variance", "f09_rolling_event_window",
    "f11_rolling_pair_corr", "g01_episodes_raw", "g06_episode_profile", "h03_lomb_scargle", "h05_morlet_power", "i02_rank_change", "i03_top_k_per_group",
    "l01_html_extract", "l03_key_paragraphs", "l05_key_terms", "l08_document_claims", "l09_web_claims", "l10_similar_pairs", "p01_signals",
    "p02_quantile_buckets", "q01_warming_rank", "q08_streamflow", "q13_blended_rate", "q21_signal_portfolio",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderpriority").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
