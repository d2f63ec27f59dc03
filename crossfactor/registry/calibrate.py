"""Calibration and power from the rank test's own p-values, against SQL that fits every simulated table and replicate."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfactor.operators import calibrate, validate
from crossfactor.operators.fit import FitOptions
from crossfactor.plans import cellsets
from crossfactor.registry import sqltext as s

FIXED = FitOptions(max_iter=4, tol=0.0, start_rounds=2)
SIMS, B, STRENGTHS = 8, 12, (0.0, 0.5)


def _p(spark, sf):
    return calibrate.simulated_p_values(cellsets.order_value_cells(spark, sf), SIMS, B, STRENGTHS, 42, FIXED)


def calibrated_rank_test(spark, sf):
    """Statistic and p-value of every simulated table."""
    return _p(spark, sf).select("matrix_id", "strength", "sim", "k", "n_used", F.round("lambda_stat", 3).alias("lambda_stat"), F.round("p_value", 9).alias("p_value"))


def calibrated_null(spark, sf):
    """Uniformity and rejection rate of the p-values of separable tables."""
    null = _p(spark, sf).filter("strength = 0")
    out = validate.calibration_report(null, ["matrix_id"], SIMS, col="p_value")
    return out.select("matrix_id", "n", F.round("ks_statistic", 9).alias("ks_statistic"), F.round("rejection_rate", 9).alias("rejection_rate"), "rate_calibrated")


def calibrated_power(spark, sf):
    """Power at every strength of the second component."""
    curve, adequate = validate.power_curve(_p(spark, sf), ["matrix_id"], col="p_value")
    out = curve.join(adequate, "matrix_id")
    return out.select("matrix_id", "strength", "n_successful", F.round("power", 9).alias("power"), F.round("power_se", 9).alias("power_se"), "power_adequate")


_K = "'42|' || matrix_id || '|' || CAST(sim AS VARCHAR) || '|' || "
_ROW, _COL = _K + "CAST(row_idx AS VARCHAR) || '|row'", _K + "CAST(col_idx AS VARCHAR) || '|col'"
_CELL = _K + "CAST(row_idx AS VARCHAR) || '|' || CAST(col_idx AS VARCHAR) || '|sim'"
_TEST = s.with_(
    s.CA, s.als("ca", ["matrix_id"], 2, 4, 1),
    s.cte("sz", "SELECT matrix_id, sqrt(avg(u * u)) AS rms, (SELECT count(DISTINCT col_idx) FROM ca) AS n_cols FROM f_u GROUP BY matrix_id"),
    s.cte(
        "sm",
        f"SELECT matrix_id, 'strength=' || printf('%.2f', strength) || '|sim=' || CAST(sim AS VARCHAR) AS preset, strength, sim, row_idx, col_idx, total_err, "
        f"p1 * s + total_err * ({s.normal(_CELL)}) + strength * rms * s * ({s.normal(_ROW)}) * ({s.normal(_COL)}) / sqrt(n_cols) AS value "
        f"FROM ca JOIN f_r1 USING (matrix_id, row_idx, col_idx) JOIN f_s USING (matrix_id) JOIN sz USING (matrix_id), (SELECT unnest(range({SIMS})) AS sim), "
        f"(SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in STRENGTHS)}]) AS strength)",
    ),
    s.als("sm", ["matrix_id", "preset"], 2, 4, p="g"), s.lambdas(["matrix_id", "preset"], p="g"), s.pseudo("sm", ["matrix_id", "preset"], B, 42, p="g"),
    s.als("ps", ["matrix_id", "preset", "replicate"], 2, 4, p="b"), s.lambdas(["matrix_id", "preset", "replicate"], p="b"),
    s.cte("pv", "SELECT matrix_id, preset, count(*) FILTER (b_lam.lambda_stat >= g_lam.lambda_stat) AS k, count(*) AS n_used, any_value(g_lam.lambda_stat) AS lambda_stat, "
                "(count(*) FILTER (b_lam.lambda_stat >= g_lam.lambda_stat) + 1.0) / (count(*) + 1.0) AS p_value FROM b_lam JOIN g_lam USING (matrix_id, preset) GROUP BY matrix_id, preset"),
    s.cte("pp", "SELECT pv.*, strength, sim FROM pv JOIN (SELECT DISTINCT matrix_id, preset, strength, sim FROM sm) USING (matrix_id, preset)"),
)
TEST = _TEST + "SELECT matrix_id, strength, sim, k, n_used, round(lambda_stat, 3) AS lambda_stat, round(p_value, 9) AS p_value FROM pp"
NULL = _TEST + """, z AS (SELECT matrix_id, p_value AS p, count(*) OVER (PARTITION BY matrix_id) AS n, count(*) OVER (PARTITION BY matrix_id ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le,
 count(*) OVER (PARTITION BY matrix_id, p_value) AS eq FROM pp WHERE strength = 0)
SELECT matrix_id, any_value(n) AS n, round(max(greatest(le / n - p, p - (le - eq) / n)), 9) AS ks_statistic, round(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END), 9) AS rejection_rate,
 abs(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) - 0.05) < 3 * sqrt(0.05 * 0.95 / any_value(n)) AS rate_calibrated FROM z GROUP BY matrix_id"""
POWER = _TEST + """, c AS (SELECT matrix_id, strength, count(*) AS n_successful, avg(CASE WHEN p_value < 0.05 THEN 1.0 ELSE 0.0 END) AS power FROM pp GROUP BY matrix_id, strength)
SELECT matrix_id, strength, n_successful, round(power, 9) AS power, round(sqrt(power * (1 - power) / n_successful), 9) AS power_se,
 first_value(power) OVER (PARTITION BY matrix_id ORDER BY abs(strength - 0.3), strength) > 0.5 AS power_adequate FROM c"""

ENTRIES = {
    "calibrated_rank_test": (calibrated_rank_test, TEST),
    "calibrated_null": (calibrated_null, NULL),
    "calibrated_power": (calibrated_power, POWER),
}
