"""The published presets run on curves and on facts: cells, fits and what is reported of presets without cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfactor.operators import fit as fitops, preset_cells, presets
from crossfactor.operators.cells import index_labels
from crossfactor.operators.fit import FitOptions
from crossfactor.plans import cellsets
from crossfactor.registry import sqltext as s
from crossfactor.session import cut

FIXED = FitOptions(max_iter=4, tol=0.0, start_rounds=2)
LO, HI, N = 0.02, 0.28, 20


def _curves(spark, sf):
    """Event curves over hundredths of a day number, so that the published ranges of t lie on them."""
    return cellsets.event_curves(spark, sf).withColumn("t", F.col("t") / 100)


def _elastic(spark, sf):
    return cut(preset_cells.curve_cells(_curves(spark, sf), presets.ELASTIC_PRESETS, LO, HI, N))


def elastic_preset_cells(spark, sf):
    """All nine presets of the curves: ranges, resolutions and modes."""
    c = _elastic(spark, sf)
    return c.select("preset", "row_label", "col_idx", "col_label", F.round("axis_value", 9).alias("axis_value"), "n_points", "mode", F.round("value", 7).alias("value"), F.round("total_err", 7).alias("total_err"))


def elastic_preset_fits(spark, sf):
    """Both fits of the curves under every preset."""
    c = _elastic(spark, sf).withColumn("matrix_id", F.lit("curves"))
    c = index_labels(c.withColumnRenamed("col_idx", "grid")).drop("col_idx").withColumnRenamed("grid", "col_idx")
    t = fitops.fit(c, FIXED, unique=True)
    return t.summary.select("preset", "n_obs", "n_rows", "n_cols", F.round("chi2_rank1", 3).alias("chi2_rank1"), F.round("chi2_rank2", 3).alias("chi2_rank2"))


def _facts(spark, sf):
    """Order lines as facts with the columns that the published cuts name."""
    line = cellsets.table(spark, sf, "lineitem")
    return line.select(
        F.lit("lines").alias("matrix_id"), F.concat(F.lit("supplier "), (F.col("l_suppkey") % 10).cast("string")).alias("row_label"), F.format_string("year=%d", F.year("l_shipdate")).alias("col_label"),
        F.col("l_quantity").alias("Q2"), (F.col("l_discount") * 10).alias("beta"), F.when(F.col("l_linestatus") == "O", "H1").otherwise("ZEUS").alias("source"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"),
    )


def diffractive_preset_cells(spark, sf):
    """All six presets of the diffractive list, cut before the cells are made."""
    c = preset_cells.fact_cells(_facts(spark, sf), presets.DIFFRACTIVE_PRESETS, F.col("x"))
    return c.select("matrix_id", "preset", "row_label", "col_label", "n_obs", F.round("value", 6).alias("value"), F.round("total_err", 6).alias("total_err"))


def empty_presets(spark, sf):
    """Presets that keep no cell of a matrix are listed as failed; the others with their fits."""
    some = [*presets.DIFFRACTIVE_PRESETS[:2], presets.Preset("no_source", "data_subset", "a source that is not there", subset="H2")]
    c = cut(index_labels(preset_cells.fact_cells(_facts(spark, sf), some, F.col("x"))))
    t = fitops.fit(c, FIXED, unique=True)
    out = presets.empty_presets(t.summary, c, some)
    return out.select("matrix_id", "preset", "ord", "n_obs", F.round("chi2_rank1", 4).alias("chi2_rank1"), "fit_converged")


def ranked_presets(spark, sf):
    """Presets of the facts by falling statistic."""
    c = cut(index_labels(preset_cells.fact_cells(_facts(spark, sf), presets.DIFFRACTIVE_PRESETS, F.col("x"))))
    t = fitops.fit(c, FIXED, unique=True)
    order = presets.preset_table(spark, presets.DIFFRACTIVE_PRESETS).select("preset", "ord")
    return presets.ranked_presets(t.summary.join(order, "preset")).select("matrix_id", "preset", "ord", "place", F.round("lambda_stat", 4).alias("lambda_stat"))


# ------------------------------------------------------------------------- SQL
_LIST = ", ".join(
    f"('{p.name}', {LO if p.range_min is None else p.range_min}, {HI if p.range_max is None else p.range_max}, {p.n_points or N}, '{p.mode or 'normalized'}')" for p in presets.ELASTIC_PRESETS
)
_CURVES = [
    s.CV, s.cte("cu", "SELECT matrix_id, t / 100 AS t, y, total_err FROM cv WHERE y > 0 AND t > 0"),
    s.cte("pl", f"SELECT * FROM (VALUES {_LIST}) AS x(preset, a, b, n, mode)"),
    s.cte("rg", "SELECT preset, n, mode, greatest(lo, a) AS t_lo, least(hi, b) AS t_hi FROM pl, (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT matrix_id, min(t) AS lo, max(t) AS hi FROM cu GROUP BY matrix_id))"),
    s.cte("gr", "SELECT preset, n, mode, i AS col_idx, CASE WHEN i = n - 1 THEN t_hi ELSE t_lo + i * ((t_hi - t_lo) / (n - 1)) END AS t FROM rg, (SELECT unnest(range(200)) AS i) WHERE i < n"),
    s.cte("sg", "SELECT matrix_id, t AS t0, lead(t) OVER w AS t1, ln(y) AS l0, lead(ln(y)) OVER w AS l1, total_err / y AS r0, lead(total_err / y) OVER w AS r1 FROM cu WINDOW w AS (PARTITION BY matrix_id ORDER BY t)"),
    s.cte("it", "SELECT preset, n, mode, matrix_id, col_idx, t, l0 + (t - t0) / (t1 - t0) * (l1 - l0) AS ly, r0 + (t - t0) / (t1 - t0) * (r1 - r0) AS rel FROM gr JOIN sg ON t >= t0 AND t <= t1 QUALIFY row_number() OVER (PARTITION BY preset, matrix_id, col_idx ORDER BY t0) = 1"),
    s.cte("ar", "SELECT preset, matrix_id, sum(x) AS area FROM (SELECT preset, matrix_id, (exp(ly) + lag(exp(ly)) OVER w) / 2 * (t - lag(t) OVER w) AS x FROM it WINDOW w AS (PARTITION BY preset, matrix_id ORDER BY t)) GROUP BY preset, matrix_id"),
    s.cte("ec", "SELECT preset, matrix_id AS row_label, CAST(dense_rank() OVER (PARTITION BY preset ORDER BY matrix_id) - 1 AS INTEGER) AS row_idx, CAST(col_idx AS INTEGER) AS col_idx, t, CAST(n AS INTEGER) AS n_points, mode, "
          "CASE WHEN mode = 'normalized' THEN ly - ln(area) ELSE ly END AS value, rel AS total_err FROM it JOIN ar USING (preset, matrix_id)"),
]
ELASTIC = s.with_(_CURVES) + """
SELECT preset, row_label, col_idx, 't=' || printf('%.3f', t) AS col_label, round(t, 9) AS axis_value, n_points, mode, round(value, 7) AS value, round(total_err, 7) AS total_err FROM ec"""
ELASTIC_FITS = s.with_(_CURVES, s.als("ec", ["preset"], 2, 4), s.lambdas(["preset"])) + """
SELECT preset, n_obs, n_rows, n_cols, round(chi2_rank1, 3) AS chi2_rank1, round(chi2_rank2, 3) AS chi2_rank2 FROM f_lam"""

_FACTS = s.cte(
    "fa",
    "SELECT 'lines' AS matrix_id, 'supplier ' || CAST(l_suppkey % 10 AS VARCHAR) AS row_label, 'year=' || CAST(year(l_shipdate) AS VARCHAR) AS col_label, l_quantity AS q2, l_discount * 10 AS beta, "
    "CASE WHEN l_linestatus = 'O' THEN 'H1' ELSE 'ZEUS' END AS source, l_extendedprice * (1 - l_discount) AS x FROM lineitem",
)
_CELL = "SELECT '{0}' AS preset, {1} AS ord, matrix_id, row_label, col_label, avg(x) AS value, stddev_samp(x) / sqrt(count(*)) AS total_err, count(*) AS n_obs FROM fa WHERE {2} GROUP BY matrix_id, row_label, col_label HAVING count(*) >= 2"
_KEPT = [("baseline", "TRUE"), ("high_Q2", "q2 >= 10"), ("mid_beta", "beta >= 0.1 AND beta <= 0.9"), ("dense_coverage", "TRUE"), ("h1_only", "source = 'H1'"), ("zeus_only", "source = 'ZEUS'")]
_DIFF = [
    _FACTS, s.cte("dc", " UNION ALL ".join(f"({_CELL.format(p, i, w)})" for i, (p, w) in enumerate(_KEPT))),
    s.cte("dk", "SELECT *, CAST(dense_rank() OVER (PARTITION BY preset, matrix_id ORDER BY row_label) - 1 AS INTEGER) AS row_idx, CAST(dense_rank() OVER (PARTITION BY preset, matrix_id ORDER BY col_label) - 1 AS INTEGER) AS col_idx "
          "FROM (SELECT *, count(*) OVER (PARTITION BY preset, matrix_id, row_label) AS pts FROM dc) WHERE preset <> 'dense_coverage' OR pts >= 5"),
]
DIFFRACTIVE = s.with_(_DIFF) + "SELECT matrix_id, preset, row_label, col_label, n_obs, round(value, 6) AS value, round(total_err, 6) AS total_err FROM dk"
EMPTY = s.with_(_DIFF, s.als("dk", ["matrix_id", "preset"], 2, 4), s.lambdas(["matrix_id", "preset"])) + """
SELECT m.matrix_id, p.preset, p.ord, n_obs, round(chi2_rank1, 4) AS chi2_rank1, FALSE AS fit_converged
FROM (SELECT DISTINCT matrix_id FROM dk) m, (VALUES ('baseline', 0), ('high_Q2', 1), ('no_source', 2)) AS p(preset, ord) LEFT JOIN f_lam ON f_lam.preset = p.preset AND f_lam.matrix_id = m.matrix_id"""
RANKED = s.with_(_DIFF, s.als("dk", ["matrix_id", "preset"], 2, 4), s.lambdas(["matrix_id", "preset"])) + """
SELECT matrix_id, preset, ord, CAST(row_number() OVER (PARTITION BY matrix_id ORDER BY round(lambda_stat, 9) DESC, ord) AS INTEGER) AS place, round(lambda_stat, 4) AS lambda_stat
FROM f_lam JOIN (SELECT DISTINCT preset, CAST(ord AS INTEGER) AS ord FROM dk) USING (preset)"""

ENTRIES = {
    "elastic_preset_cells": (elastic_preset_cells, ELASTIC),
    "elastic_preset_fits": (elastic_preset_fits, ELASTIC_FITS),
    "diffractive_preset_cells": (diffractive_preset_cells, DIFFRACTIVE),
    "empty_presets": (empty_presets, EMPTY),
    "ranked_presets": (ranked_presets, RANKED),
}
