"""Headline timings: ``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crossfactor.operators import fit as fitops, ranktest  # noqa: E402
from crossfactor.operators.fit import FitOptions  # noqa: E402
from crossfactor.plans import cellsets  # noqa: E402
from crossfactor.registry import entries  # noqa: E402
from crossfactor.session import build_session, ship  # noqa: E402


def _rank_test(cells, n):
    return ranktest.rank_test(cells, n_bootstrap=n).summary


#: The workload sizes the default options stand for: 1000 replicates per matrix, both ranks, run to convergence.
HEADLINE = {
    "rank_test_1_matrix_1000": lambda spark, sf: _rank_test(cellsets.order_value_cells(spark, sf), 1000),
    "rank_test_5_matrices_1000": lambda spark, sf: _rank_test(cellsets.priority_cells(spark, sf), 1000),
    "rank_test_625_cells_200": lambda spark, sf: _rank_test(cellsets.revenue_cells(spark, sf), 200),
    "rank_test_all_suppliers_20": lambda spark, sf: _rank_test(cellsets.supplier_cells(spark, sf), 20),
    "fit_all_suppliers": lambda spark, sf: fitops.fit(cellsets.supplier_cells(spark, sf), unique=True).summary,
    "large_matrix_relational": lambda spark, sf: fitops.fit(
        cellsets.line_observations(spark, sf), FitOptions(max_iter=4, tol=0.0, start_rounds=2, group_max_cells=20_000, rank=1)
    ).summary,
    "large_matrix_grouped": lambda spark, sf: fitops.fit(
        cellsets.line_observations(spark, sf), FitOptions(max_iter=4, tol=0.0, start_rounds=2, group_max_cells=10_000_000, rank=1)
    ).summary,
}
REGISTERED = [
    "cells_errors", "cut_and_bin", "collapse_duplicates", "shape_curves", "localization", "spearman_pairs", "preset_sweep", "global_p",
    "residual_pulls", "compare_direct", "ks_uniform", "usable_tables", "spot_checks",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    known = entries()
    todo = dict(HEADLINE) | {name: known[name][0] for name in REGISTERED}
    # start the JVM's code paths and the Python workers once
    fitops.fit(cellsets.priority_cells(spark, sf), FitOptions(max_iter=2, tol=0.0), unique=True).summary.collect()
    times = {}
    only = sys.argv[1:]
    for name, fn in todo.items():
        if only and name not in only:
            continue
        t0 = time.time()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
