"""Time the headline queries and print one JSON line."""

import json
import os
import time

from tipoff.queries import QUERIES
from tipoff.session import intermediates, local_session

HEADLINE = [
    "load_plays", "scoring_events", "running_points", "interval_snapshots", "rest_days_joined", "player_form",
    "team_form", "feature_build", "bellman_pairs", "feature_stats", "bellman_gram", "lspi_weights",
    "network_score", "score_histogram", "lineitem_histogram", "embedding_gram", "ewm_events_daily",
    "rest_days_orders", "order_day_ordinal", "first_non_null", "option_basis", "put_target",
]


def run(spark, name, folder):
    """Seconds to compute every row and column of a query."""
    with intermediates(spark):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    run(spark, "feature_build", folder)  # warm the JVM and the Python workers
    seconds = {name: round(run(spark, name, folder), 3) for name in HEADLINE}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
