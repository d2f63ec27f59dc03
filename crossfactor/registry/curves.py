"""Queries on curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfactor.operators import cells as cellops, curves
from crossfactor.plans import cellsets
from crossfactor.registry import sqltext as s

LO, HI, N = 2.5, 20.0, 15
_RANGE = s.cte(
    "rg",
    f"SELECT greatest(max(lo), {LO}) AS t_lo, least(min(hi), {HI}) AS t_hi FROM (SELECT matrix_id, min(t) AS lo, max(t) AS hi FROM cv WHERE t > 0 GROUP BY matrix_id)",
)
_GRID = s.cte(
    "gr",
    f"SELECT i AS col_idx, CASE WHEN i = {N - 1} THEN t_hi ELSE t_lo + i * ((t_hi - t_lo) / {N - 1}) END AS t FROM rg, (SELECT unnest(range({N})) AS i)",
)
_SEG = s.cte(
    "sg",
    "SELECT matrix_id, t AS t0, lead(t) OVER w AS t1, ln(y) AS l0, lead(ln(y)) OVER w AS l1, total_err / y AS r0, lead(total_err / y) OVER w AS r1 "
    "FROM cv WHERE y > 0 AND t > 0 WINDOW w AS (PARTITION BY matrix_id ORDER BY t)",
)
_INT = s.cte(
    "it",
    "SELECT DISTINCT matrix_id, col_idx, t, l0 + (t - t0) / (t1 - t0) * (l1 - l0) AS ly, r0 + (t - t0) / (t1 - t0) * (r1 - r0) AS rel FROM gr JOIN sg ON t >= t0 AND t <= t1 "
    "QUALIFY row_number() OVER (PARTITION BY matrix_id, col_idx ORDER BY t0) = 1",
)


def strict_range(spark, sf):
    out = curves.strict_range(cellsets.event_curves(spark, sf), LO, HI)
    return out.select(F.round("t_lo", 9).alias("t_lo"), F.round("t_hi", 9).alias("t_hi"))


RANGE = s.with_(s.CV, _RANGE) + "SELECT round(t_lo, 9) AS t_lo, round(t_hi, 9) AS t_hi FROM rg"


def interp_grid(spark, sf):
    cv = curves.valid_points(cellsets.event_curves(spark, sf))
    grid = curves.even_grid(curves.strict_range(cv, LO, HI), N)
    logs = cv.select("matrix_id", "t", F.log("y").alias("ly"), (F.col("total_err") / F.col("y")).alias("rel"))
    out = curves.interpolate(logs, grid, ["ly", "rel"])
    return out.select("matrix_id", "col_idx", F.round("t", 7).alias("t"), F.round("ly", 7).alias("ly"), F.round("rel", 7).alias("rel"))


INTERP = s.with_(s.CV, _RANGE, _GRID, _SEG, _INT) + """
SELECT matrix_id, CAST(col_idx AS INTEGER) AS col_idx, round(t, 7) AS t, round(ly, 7) AS ly, round(rel, 7) AS rel FROM it"""


def trapezoid_norm(spark, sf):
    out = curves.trapezoid(cellsets.event_curves(spark, sf), ["matrix_id"])
    return out.select("matrix_id", F.round("integral", 5).alias("integral"), "n_points")


TRAPEZOID = s.with_(s.CV) + """
SELECT matrix_id, round(sum(x), 5) AS integral, count(*) AS n_points FROM (SELECT matrix_id, (y + lag(y) OVER w) / 2 * (t - lag(t) OVER w) AS x
FROM cv WINDOW w AS (PARTITION BY matrix_id ORDER BY t)) GROUP BY matrix_id"""


def shape_curves(spark, sf):
    out = curves.shape_curves(cellsets.event_curves(spark, sf), LO, HI, N, log=True, normalize=True)
    return out.select("row_label", "col_idx", "col_label", F.round("value", 7).alias("value"), F.round("total_err", 7).alias("total_err"))


SHAPE = s.with_(s.CV, _RANGE, _GRID, _SEG, _INT) + """, n AS (SELECT matrix_id, sum(x) AS area FROM (SELECT matrix_id, (exp(ly) + lag(exp(ly)) OVER w) / 2 * (t - lag(t) OVER w) AS x
FROM it WINDOW w AS (PARTITION BY matrix_id ORDER BY t)) GROUP BY matrix_id)
SELECT matrix_id AS row_label, CAST(col_idx AS INTEGER) AS col_idx, 't=' || printf('%.3f', t) AS col_label, round(ln(exp(ly) / area), 7) AS value, round(rel, 7) AS total_err
FROM it JOIN n USING (matrix_id)"""


def raw_curves(spark, sf):
    out = curves.shape_curves(cellsets.event_curves(spark, sf), LO, HI, N, log=False, normalize=False)
    return out.select("row_label", "col_idx", F.round("value", 6).alias("value"), F.round("total_err", 6).alias("total_err"))


RAW = s.with_(s.CV, _RANGE, _GRID, _SEG, _INT) + """
SELECT matrix_id AS row_label, CAST(col_idx AS INTEGER) AS col_idx, round(exp(ly), 6) AS value, round(exp(ly) * rel, 6) AS total_err FROM it"""


def log_slope(spark, sf):
    out = curves.log_slope(cellsets.event_curves(spark, sf), 2.0, 12.0)
    return out.select("matrix_id", F.round("slope", 8).alias("slope"), "n_points")


SLOPE = s.with_(s.CV) + """
SELECT matrix_id, round(-regr_slope(ln(y), t), 8) AS slope, count(*) AS n_points FROM cv WHERE t > 2 AND t < 12 AND y > 0 GROUP BY matrix_id HAVING count(*) >= 3"""


def slope_vs_expected(spark, sf):
    """Slopes against a table of expected constants, here the mean slope over all curves with a fixed tolerance."""
    sl = curves.log_slope(cellsets.event_curves(spark, sf), 2.0, 12.0)
    mean = sl.agg(F.avg("slope").alias("value")).scalar()
    want = sl.select("matrix_id", mean.alias("value"), F.lit(0.005).alias("tol"))
    return curves.slope_check(sl, want).select("matrix_id", F.round("value", 8).alias("expected"), "passed")


SLOPE_EXP = s.with_(s.CV) + """, sl AS (SELECT matrix_id, -regr_slope(ln(y), t) AS slope FROM cv WHERE t > 2 AND t < 12 AND y > 0 GROUP BY matrix_id HAVING count(*) >= 3)
SELECT matrix_id, round(avg(slope) OVER (), 8) AS expected, abs(slope - avg(slope) OVER ()) < 0.01 AS passed FROM sl"""


def power_law(spark, sf):
    out = curves.power_law(cellsets.event_curves(spark, sf), ["matrix_id"], F.col("t"), F.col("y"))
    return out.select("matrix_id", F.round("power", 8).alias("power"), "passed")


POWER = s.with_(s.CV) + """
SELECT matrix_id, round(regr_slope(ln(abs(y) + 1e-10), ln(t)), 8) AS power,
 regr_slope(ln(abs(y) + 1e-10), ln(t)) > -1.5 AND regr_slope(ln(abs(y) + 1e-10), ln(t)) < -0.8 AS passed FROM cv WHERE t > 0 GROUP BY matrix_id"""


def decreasing_share(spark, sf):
    out = curves.decreasing_share(cellsets.priority_cells(spark, sf))
    return out.select("matrix_id", "row_idx", F.round("share", 8).alias("share"), "passed")


DECREASING = s.with_(s.CC) + """, d AS (SELECT matrix_id, row_idx, value - lag(value) OVER (PARTITION BY matrix_id, row_idx ORDER BY col_idx) AS step FROM cc)
SELECT matrix_id, row_idx, round(avg(CASE WHEN step < 0 THEN 1.0 ELSE 0.0 END), 8) AS share, avg(CASE WHEN step < 0 THEN 1.0 ELSE 0.0 END) >= 0.7 AS passed
FROM d WHERE step IS NOT NULL GROUP BY matrix_id, row_idx HAVING count(*) > 1"""


def label_numbers(spark, sf):
    """The number inside a column label."""
    from crossfactor.functions.scalars import label_number

    c = cellsets.priority_cells(spark, sf)
    return cellops.distinct_labels(c, "col_label").withColumn("num", label_number("col_label"))


LABELS = s.with_(s.CC) + """
SELECT DISTINCT matrix_id, col_label, TRY_CAST(string_split(col_label, '=')[-1] AS DOUBLE) AS num FROM cc"""

ENTRIES = {
    "strict_range": (strict_range, RANGE),
    "interp_grid": (interp_grid, INTERP),
    "trapezoid_norm": (trapezoid_norm, TRAPEZOID),
    "shape_curves": (shape_curves, SHAPE),
    "raw_curves": (raw_curves, RAW),
    "log_slope": (log_slope, SLOPE),
    "slope_vs_expected": (slope_vs_expected, SLOPE_EXP),
    "power_law": (power_law, POWER),
    "decreasing_share": (decreasing_share, DECREASING),
    "label_numbers": (label_numbers, LABELS),
}
