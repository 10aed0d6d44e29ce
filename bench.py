"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import numpy as np

from tidemark.operators import transport as X
from tidemark.plans import catalog
from tidemark.session import session, ship

HEADLINE = [
    "track_sessions", "cleaning_report", "asof_interpolate", "behavioural_prior", "region_prefilter", "dark_antijoin", "ranked_candidates",
    "bernoulli_loglik", "hdr_cells", "spatial_time_marginals", "bilinear_lookup", "gaussian_smooth", "connected_components", "current_field", "detect_scene", "invert_planted",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def transport(spark) -> None:
    """1e5 particles over 192 steps with full physics, the one figure that compares like with like."""
    from pyspark.sql import functions as F

    full = lambda x: np.full((50, 60, 60), x)
    field = X.Field(400_000.0, 6_200_000.0, 2000.0, 2000.0, 0.0, 3600.0, full(0.05), full(0.02), full(3.0), full(-1.0), np.zeros((60, 60), bool))
    i = F.col("id")
    seeds = spark.range(0, 100_000, 1, 8).select(i.alias("particle_id"), (i % 16).alias("origin"), (440_000.0 + i % 200 * 100).alias("x"), (6_240_000.0 + i % 300 * 100).alias("y"), F.lit(0.0).alias("seed_time"))
    drain(X.simulate(seeds, field, 0.0, 172_800.0))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = ship(session(f"local[{cpus}]", "bench", spark_driver_memory="8g", spark_ui_enabled="false"))
    spark.conf.set("spark.sql.shuffle.partitions", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    runs = {name: (lambda n=name: drain(catalog.QUERIES[n](spark, sf))) for name in HEADLINE} | {"transport_1e5x192": lambda: transport(spark)}
    try:
        from tidemark.llm import queries as llm
    except ModuleNotFoundError:
        llm = None
    if llm:
        runs |= {name: (lambda n=name: drain(llm.QUERIES[n](spark, sf))) for name in sorted(llm.QUERIES)}
    drain(catalog.QUERIES["track_gaps"](spark, sf))  # starts the session's threads and workers
    for name, run in runs.items():
        began = time.time()
        run()
        seconds[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
