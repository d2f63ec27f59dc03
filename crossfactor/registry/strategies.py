"""Queries on whole replication studies, their plot tables, and agreement of starts."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfactor.operators import fit as fitops, mode, replicate, report
from crossfactor.operators.fit import FitOptions
from crossfactor.plans import cellsets
from crossfactor.registry import sqltext as s
from crossfactor.registry.fits import FIXED, _random_rounds
from crossfactor.registry.modes import SWEEP, _sweep
from crossfactor.registry.relate import INTERPOLATED, _MODES_SQL, _priority_modes, modes_sql, report_sql
from crossfactor.session import cut


def _modes(cells):
    return mode.residual_modes(fitops.fit(cells, FIXED, unique=True)).withColumnRenamed("matrix_id", "mode_id")


def _reported(out):
    return out.select(
        "dataset", "n_comparisons", "all_replicate", "best_comparison", "worst_comparison",
        F.round("mean_v2_cosine", 4).alias("mean_v2_cosine"), F.round("mean_replication_score", 4).alias("mean_replication_score"),
    )


def _groups(name: str, listed: str, admits: str) -> str:
    inner = f"""
SELECT g.matrix_id, n_name AS row_label, 'year=' || CAST(year(o_orderdate) AS VARCHAR) AS col_label, avg(o_totalprice) AS value,
 stddev_samp(o_totalprice) / sqrt(count(*)) AS total_err, count(*) AS n_obs
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN ({listed}) g ON g.x IS NULL OR {admits} GROUP BY g.matrix_id, n_name, year(o_orderdate) HAVING count(*) >= 2"""
    return s.cte(name, s.CELL_INDEX.format(inner=inner))


def leave_one_out_replication(spark, sf):
    """The mode of all orders against those without one priority, and these among themselves."""
    return _reported(replicate.full_and_left_out(_modes(cellsets.grouped_priority_cells(spark, sf, leave_out=True))))


_LEFT_OUT = "SELECT 'full' AS matrix_id, NULL AS x UNION ALL SELECT DISTINCT 'without ' || o_orderpriority, o_orderpriority FROM orders"
LEAVE_ONE_OUT = report_sql(modes_sql(_groups("lo", _LEFT_OUT, "o_orderpriority <> g.x"), "lo", "a.id < b.id"), "leave_one_out")


def source_replication(spark, sf):
    """Priorities as sources among themselves, and all orders together against each."""
    return _reported(replicate.by_source(_modes(cellsets.grouped_priority_cells(spark, sf, leave_out=False)), has_grid=False))


_SOURCES = "SELECT 'combined' AS matrix_id, NULL AS x UNION ALL SELECT DISTINCT o_orderpriority, o_orderpriority FROM orders"
_SOURCE_PAIRS = "(a.id = 'combined' AND b.id <> 'combined') OR (a.id < b.id AND a.id <> 'combined' AND b.id <> 'combined')"
SOURCE = report_sql(modes_sql(_groups("so", _SOURCES, "o_orderpriority = g.x"), "so", _SOURCE_PAIRS), "diffractive")


def energy_replication(spark, sf):
    """Event curves of different types, each on its own days, compared pair by pair over what they share."""
    cv = cellsets.event_curves(spark, sf)
    m = cv.select(F.col("matrix_id").alias("mode_id"), F.lit("col").alias("axis"), F.col("t").cast("int").alias("idx"), F.col("y").alias("val"), F.col("t").alias("grid"))
    return _reported(replicate.by_energy(m))


_HUNDRED = INTERPOLATED.replace("range(40)", "range(100)").replace("i = 39", "i = 99").replace("/ 39)", "/ 99)")
ENERGY = f"""SELECT 'elastic' AS dataset, count(*) AS n_comparisons, bool_and(replication_grade IN ('excellent', 'good')) AS all_replicate,
 arg_max(source_a || ' vs ' || source_b, replication_score) AS best_comparison, arg_min(source_a || ' vs ' || source_b, replication_score) AS worst_comparison,
 round(avg(v2_cosine), 4) AS mean_v2_cosine, round(avg(replication_score), 4) AS mean_replication_score FROM ({_HUNDRED})"""


def similarity(spark, sf):
    """Similarity matrix of the priorities' modes as a long table."""
    m = _priority_modes(spark, sf)
    out = report.similarity(cut(replicate.compare_direct(m, replicate.unordered_pairs(m))))
    return out.select("source_a", "source_b", F.round("similarity", 4).alias("similarity"))


SIMILARITY = _MODES_SQL + """, h AS (SELECT al.source_a, al.source_b, round(v2_cosine, 4) AS similarity FROM al LEFT JOIN cmp USING (source_a, source_b))
SELECT * FROM h UNION ALL SELECT source_b, source_a, similarity FROM h UNION ALL SELECT id, id, 1.0 FROM ids"""


def compared_sources(spark, sf):
    """Every condition that takes part in a comparison of one with all others."""
    m = _priority_modes(spark, sf)
    return replicate.pair_members(replicate.one_against_many(m, "3-MEDIUM"))


COMPARED = "SELECT DISTINCT o_orderpriority AS id FROM orders"


def heat_cells(spark, sf):
    """Pulls of the rank-one fit, those beyond two flagged."""
    c = cellsets.priority_cells(spark, sf)
    out = report.heat_cells(mode.residual_map(c, fitops.fit(c, FIXED, unique=True)))
    return out.withColumn("pull", F.round("pull", 5))


HEAT = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6, 1)) + """
SELECT matrix_id, row_label, col_label, round(r * sqrt(wc), 5) AS pull, abs(r * sqrt(wc)) > 2 AS flagged FROM f_r1 JOIN cc USING (matrix_id, row_idx, col_idx)"""


def sweep_bars(spark, sf):
    """Presets by falling statistic, as bars."""
    out = report.sweep_bars(_sweep(spark, sf).summary)
    return out.select("matrix_id", "preset", "place", F.round("lambda_stat", 4).alias("lambda_stat"), F.round("p_value", 9).alias("p_value"))


BARS = f"""SELECT matrix_id, preset, row_number() OVER (PARTITION BY matrix_id ORDER BY lambda_stat DESC, preset) AS place, lambda_stat, p_value FROM ({SWEEP})"""


def combined_summary(spark, sf):
    """Fit results of every priority beside the modal peak of those with a mode analysis (all but the last one)."""
    c = cellsets.priority_cells(spark, sf)
    t = fitops.fit(c, FIXED, unique=True)
    peaks = mode.peak(mode.residual_modes(t).filter((F.col("axis") == "col") & (F.col("matrix_id") != "5-LOW"))).select("matrix_id", "peak_index")
    out = report.combined_summary(t.summary, peaks)
    return out.select("matrix_id", "n_obs", F.round("lambda_stat", 5).alias("lambda_stat"), "peak_index")


COMBINED = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6), s.lambdas(["matrix_id"])) + """,
pk AS (SELECT matrix_id, arg_max(col_idx, (abs(v2), -col_idx)) AS peak_index FROM f_vv WHERE matrix_id <> '5-LOW' GROUP BY matrix_id)
SELECT matrix_id, n_obs, round(lambda_stat, 5) AS lambda_stat, peak_index FROM f_lam LEFT JOIN pk USING (matrix_id)"""


def start_agreement(spark, sf):
    """How far the predictions of three random starts are apart after six rounds."""
    t = fitops.multistart(cellsets.priority_cells(spark, sf), 3, 42, FitOptions(max_iter=6, tol=0.0, rank=1), unique=True)
    out = fitops.start_agreement(t, rank=1)
    return out.select("matrix_id", F.round("max_rel_diff", 5).alias("max_rel_diff"), "is_stable")


STARTS = s.with_(s.CC, _random_rounds()) + """,
x AS (SELECT matrix_id, start, sum(wc * (y - u * v) * (y - u * v)) AS chi2 FROM c JOIN u6 USING (matrix_id, start, row_idx) JOIN v6 USING (matrix_id, start, col_idx) GROUP BY matrix_id, start),
o AS (SELECT matrix_id, start, row_number() OVER (PARTITION BY matrix_id ORDER BY chi2, start) AS place FROM x),
g AS (SELECT matrix_id, place, row_idx, col_idx, u * v AS p FROM u6 JOIN v6 USING (matrix_id, start) JOIN o USING (matrix_id, start)),
d AS (SELECT a.matrix_id, a.place AS pa, b.place AS pb, sqrt(sum((a.p - b.p) * (a.p - b.p))) / sqrt(sum(a.p * a.p)) AS rel
 FROM g a JOIN g b ON a.matrix_id = b.matrix_id AND a.row_idx = b.row_idx AND a.col_idx = b.col_idx AND a.place < b.place GROUP BY 1, 2, 3)
SELECT matrix_id, round(max(rel), 5) AS max_rel_diff, max(rel) <= 0.05 AS is_stable FROM d GROUP BY matrix_id"""


ENTRIES = {
    "leave_one_out_replication": (leave_one_out_replication, LEAVE_ONE_OUT),
    "source_replication": (source_replication, SOURCE),
    "energy_replication": (energy_replication, ENERGY),
    "similarity": (similarity, SIMILARITY),
    "compared_sources": (compared_sources, COMPARED),
    "heat_cells": (heat_cells, HEAT),
    "sweep_bars": (sweep_bars, BARS),
    "combined_summary": (combined_summary, COMBINED),
    "start_agreement": (start_agreement, STARTS),
}
