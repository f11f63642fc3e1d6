"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from tarnhelm.catalog import load
from tarnhelm.plans.levels import Level
from tarnhelm.queries import DEMO_KEY, QUERIES
from tarnhelm.session import force, get_session

HEADLINE = (
    "bdb_q1", "bdb_q2", "bdb_q3", "tpch_q9_like", "pagerank_step", "least_squares_moments", "kmeans_iter", "logreg_grad",
    "agg_sum", "agg_count_distinct", "join_inner", "join_full", "sort_total", "top_k", "distinct", "union_distinct", "vec_dot", "vec_sum",
)


def _timed(f, runs: int) -> float:
    f()
    out = []
    for _ in range(runs):
        t = time.perf_counter()
        f()
        out.append(time.perf_counter() - t)
    return round(statistics.median(out), 4)


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = get_session("bench", cpus, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {q: _timed(lambda q=q: force(QUERIES[q](spark, d)), runs) for q in HEADLINE}
    # one scan-and-aggregate plan at each protection level, over inputs that are sealed beforehand
    for level in Level:
        df = level.apply_to(load(spark, d, "lineitem"), "lineitem", DEMO_KEY, columns=["l_quantity", "l_returnflag", "l_extendedprice"])
        times[f"level_{level.value}"] = _timed(lambda df=df: force(df.filter("l_quantity > 10").groupBy("l_returnflag").agg(F.sum("l_extendedprice"))), runs)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
