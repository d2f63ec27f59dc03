"""Queries on residual modes, residual maps, stability, presets and global significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfactor.operators import fit as fitops, mode, presets, ranktest
from crossfactor.plans import cellsets
from crossfactor.registry import sqltext as s
from crossfactor.registry.fits import FIXED
from crossfactor.session import keep


def _em(spark, sf):
    return cellsets.embedding_modes(spark, sf).select("matrix_id", "idx", "val")


def mode_sign_norm(spark, sf):
    em = _em(spark, sf).withColumn("axis", F.lit("col"))
    out = mode.signed_normalised(em)
    return out.select("matrix_id", "idx", F.round("val", 8).alias("val"), F.round("scale", 6).alias("scale"))


SIGN_NORM = s.with_(s.EM) + """, a AS (SELECT matrix_id, sqrt(sum(val * val)) AS norm, max(abs(val)) AS top FROM em GROUP BY matrix_id),
b AS (SELECT matrix_id, arg_min(val, idx) AS pv FROM em JOIN a USING (matrix_id) WHERE abs(val) = top GROUP BY matrix_id)
SELECT matrix_id, CAST(idx AS INTEGER) AS idx, round(CASE WHEN pv < 0 THEN -val ELSE val END / norm, 8) AS val, round(norm, 6) AS scale
FROM em JOIN a USING (matrix_id) JOIN b USING (matrix_id)"""


def sign_conventions(spark, sf):
    em = keep(_em(spark, sf))
    out = None
    for c in ("max_positive", "dot_positive", "first_positive"):
        part = mode.sign_of(em, ["matrix_id"], c).withColumn("convention", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out.select("matrix_id", "convention", "sign")


SIGN_CONV = s.with_(s.EM) + """
SELECT matrix_id, 'max_positive' AS convention, CASE WHEN arg_max(val, (abs(val), -idx)) < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS sign FROM em GROUP BY matrix_id
UNION ALL SELECT matrix_id, 'dot_positive', CASE WHEN sum(val) < 0 THEN -1.0 ELSE 1.0 END::DOUBLE FROM em GROUP BY matrix_id
UNION ALL SELECT matrix_id, 'first_positive', CASE WHEN arg_min(val, idx) FILTER (abs(val) > 1e-10) < 0 THEN -1.0 ELSE 1.0 END::DOUBLE FROM em GROUP BY matrix_id"""


def topk_mass(spark, sf):
    out = mode.top_k_mass(mode.energy(_em(spark, sf)))
    return out.select("matrix_id", "k", F.round("mass", 8).alias("mass"))


TOPK = s.with_(s.EM) + """, r AS (SELECT matrix_id, row_number() OVER (PARTITION BY matrix_id ORDER BY val * val DESC, idx) AS k,
 sum(val * val) OVER (PARTITION BY matrix_id ORDER BY val * val DESC, idx ROWS UNBOUNDED PRECEDING) AS c,
 sum(val * val) OVER (PARTITION BY matrix_id) AS t, count(*) OVER (PARTITION BY matrix_id) AS n FROM em)
SELECT matrix_id, CAST(k AS INTEGER) AS k, round(c / t, 8) AS mass FROM r WHERE k IN (1, 2, 3, least(5, n), n // 4)"""


def gini(spark, sf):
    return mode.gini(mode.energy(_em(spark, sf))).select("matrix_id", F.round("gini", 8).alias("gini"))


GINI = s.with_(s.EM) + """, r AS (SELECT matrix_id, row_number() OVER (PARTITION BY matrix_id ORDER BY val * val, idx) AS i, val * val AS q FROM em)
SELECT matrix_id, round(greatest(0.0, least(1.0, (2 * sum(i * q) / sum(q) - (count(*) + 1)) / count(*))), 8) AS gini FROM r GROUP BY matrix_id"""


def entropy(spark, sf):
    out = mode.entropy(mode.energy(_em(spark, sf)))
    return out.select("matrix_id", *[F.round(c, 8).alias(c) for c in ("entropy", "max_entropy", "normalized_entropy")])


ENTROPY = s.with_(s.EM) + """, p AS (SELECT matrix_id, val * val / sum(val * val) OVER (PARTITION BY matrix_id) AS p FROM em)
SELECT matrix_id, round(-sum(p * ln(p)) FILTER (p > 1e-12), 8) AS entropy, round(ln(count(*)), 8) AS max_entropy,
       round(-sum(p * ln(p)) FILTER (p > 1e-12) / ln(count(*)), 8) AS normalized_entropy FROM p GROUP BY matrix_id"""


def window_share(spark, sf):
    out = mode.window_share(mode.energy(_em(spark, sf)))
    return out.select("matrix_id", "w", F.round("share", 8).alias("share"))


WINDOW = s.with_(s.EM) + """, e AS (SELECT matrix_id, idx, val * val AS q, sum(val * val) OVER (PARTITION BY matrix_id) AS t, count(*) OVER (PARTITION BY matrix_id) AS n FROM em),
x AS (""" + " UNION ALL ".join(
    f"SELECT matrix_id, {w} AS w, idx, n, sum(q) OVER (PARTITION BY matrix_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) / t AS share FROM e"
    for w in (1, 2, 3, 16, 32)
) + """)
SELECT matrix_id, CAST(w AS INTEGER) AS w, round(max(share), 8) AS share FROM x WHERE idx <= n - w GROUP BY matrix_id, w"""


def peak(spark, sf):
    return mode.peak(_em(spark, sf)).select("matrix_id", "peak_index", F.round("peak_value", 8).alias("peak_value"))


PEAK = s.with_(s.EM) + """
SELECT matrix_id, CAST(idx AS INTEGER) AS peak_index, round(val, 8) AS peak_value FROM em
QUALIFY row_number() OVER (PARTITION BY matrix_id ORDER BY abs(val) DESC, idx) = 1"""


def localization(spark, sf):
    """All measures of every vector in one row, with the default top-k and window tables as JSON."""
    out = mode.localization(_em(spark, sf))
    return out.select(
        "matrix_id", F.round("gini", 8).alias("gini"), F.round("normalized_entropy", 8).alias("normalized_entropy"), "peak_index",
        F.size("top_k_mass").cast("bigint").alias("n_topk"), F.round(F.col("top_k_mass")[F.lit(1)], 8).alias("top1"),
        F.round(F.col("window_concentration")[F.lit(32)], 8).alias("half"),
    )


LOCALIZATION = s.with_(s.EM) + """, e AS (SELECT *, val * val AS q FROM em),
r AS (SELECT *, row_number() OVER (PARTITION BY matrix_id ORDER BY q, idx) AS i, q / sum(q) OVER (PARTITION BY matrix_id) AS p,
 sum(q) OVER (PARTITION BY matrix_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS w32 FROM e),
a AS (SELECT matrix_id, (2 * sum(i * p) - (count(*) + 1)) / count(*) AS g, -sum(p * ln(p)) FILTER (p > 1e-12) / ln(count(*)) AS h,
 max(p) AS top1, max(w32 / (q / p)) FILTER (idx <= 32) AS half, arg_max(idx, (abs(val), -idx)) AS pk FROM r GROUP BY matrix_id)
SELECT matrix_id, round(g, 8) AS gini, round(h, 8) AS normalized_entropy, CAST(pk AS INTEGER) AS peak_index, CAST(5 AS BIGINT) AS n_topk,
       round(top1, 8) AS top1, round(half, 8) AS half FROM a"""


# --------------------------------------------------------------- residual maps
def residual_pulls(spark, sf):
    cells = cellsets.priority_cells(spark, sf)
    m = mode.residual_map(cells, fitops.fit(cells, FIXED, unique=True))
    return m.select(
        "matrix_id", "row_idx", "col_idx", *[F.round(c, 5).alias(c) for c in ("pull1", "pull2", "correction")],
        (F.abs("pull1") > 2).alias("flagged"),
    )


_MAP = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6)) + """, m AS (SELECT a.matrix_id, a.row_idx, a.col_idx, a.r * sqrt(a.wc) AS pull1, b.r * sqrt(a.wc) AS pull2,
 (p2 - p1) * sqrt(a.wc) AS correction FROM f_r1 a JOIN f_r2 b USING (matrix_id, row_idx, col_idx))
"""
PULLS = _MAP + """SELECT matrix_id, row_idx, col_idx, round(pull1, 5) AS pull1, round(pull2, 5) AS pull2, round(correction, 5) AS correction,
 abs(pull1) > 2 AS flagged FROM m"""


def chi2_gain(spark, sf):
    cells = cellsets.priority_cells(spark, sf)
    m = mode.residual_map(cells, fitops.fit(cells, FIXED, unique=True))
    return m.groupBy("matrix_id", "row_label").agg(
        F.round(F.sum("chi2_gain"), 4).alias("gain"), F.round(F.max("chi2_gain"), 4).alias("best_cell")
    )


GAIN = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6)) + """
SELECT matrix_id, row_label, round(sum(a.r * a.r * a.wc - b.r * b.r * a.wc), 4) AS gain, round(max(a.r * a.r * a.wc - b.r * b.r * a.wc), 4) AS best_cell
FROM cc JOIN f_r1 a USING (matrix_id, row_idx, col_idx) JOIN f_r2 b USING (matrix_id, row_idx, col_idx) GROUP BY matrix_id, row_label"""


def explained_variance(spark, sf):
    cells = cellsets.priority_cells(spark, sf)
    m = fitops.predict(cells, fitops.fit(cells, FIXED, unique=True), 1)
    return mode.explained_variance(m).select("matrix_id", F.round("fraction_explained", 7).alias("fraction_explained"), "passed")


EXPLAINED = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6, 1)) + """
SELECT matrix_id, round(1 - var_pop(r) / var_pop(y), 7) AS fraction_explained, 1 - var_pop(r) / var_pop(y) > 0.8 AS passed FROM f_r1 GROUP BY matrix_id"""


def frobenius(spark, sf):
    cells = cellsets.priority_cells(spark, sf)
    m = fitops.predict(cells, fitops.fit(cells, FIXED, unique=True), 2)
    w = 1.0 / (F.col("total_err") * F.col("total_err"))
    a = fitops.frobenius(m.drop("replicate"), "value", "pred1", w).withColumnRenamed("distance", "weighted1")
    b = fitops.frobenius(m.drop("replicate"), "pred1", "pred2", w).withColumnRenamed("distance", "between")
    return a.join(b, "matrix_id").select("matrix_id", F.round("weighted1", 6).alias("weighted1"), F.round("between", 5).alias("between"))


FROBENIUS = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6)) + """
SELECT matrix_id, round(sqrt(sum(a.wc * a.r * a.r)), 6) AS weighted1, round(sqrt(sum(a.wc * (p1 - p2) * (p1 - p2))), 5) AS between
FROM f_r1 a JOIN f_r2 b USING (matrix_id, row_idx, col_idx) GROUP BY matrix_id"""


def predicted_matrix(spark, sf):
    cells = cellsets.priority_cells(spark, sf)
    g = fitops.predict_matrix(fitops.fit(cells, FIXED, unique=True), 1)
    return g.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("pred") / 1000), 4).alias("total_thousands"))


PREDICTED = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6, 1)) + """
SELECT matrix_id, count(*) AS n, round(sum(u * v * s / 1000), 4) AS total_thousands
FROM f_u JOIN f_v USING (matrix_id) JOIN f_s USING (matrix_id) GROUP BY matrix_id"""


def residual_mode_vectors(spark, sf):
    """Second component of every matrix, signed and normalised."""
    cells = cellsets.order_value_cells(spark, sf)
    m = mode.residual_modes(fitops.fit(cells, FIXED, unique=True))
    return m.select("matrix_id", "axis", "idx", F.round(F.when(F.col("axis") == "col", F.col("val")).otherwise(F.col("val") / 1000), 5).alias("val"))


MODE_VECTORS = s.with_(s.CA, s.als("ca", ["matrix_id"], 2, 6)) + """
SELECT matrix_id, 'col' AS axis, col_idx AS idx, round(v2, 5) AS val FROM f_vv
UNION ALL SELECT matrix_id, 'row', row_idx, round(u2 * s / 1000, 5) FROM f_uu JOIN f_s USING (matrix_id)"""


def stability_replicates(spark, sf):
    """Agreement of the residual mode of each replicate with the observed one."""
    cells = cellsets.order_value_cells(spark, sf)
    t = fitops.fit(cells, FIXED, unique=True)
    reps = mode.residual_modes(ranktest.null_distribution(cells, t, 20, 42, FIXED, factors=True))
    out = mode.stability(mode.residual_modes(t).drop("replicate"), starts=reps.withColumn("start", F.col("replicate")), replicates=reps)
    return out.select(
        "matrix_id", "n_starts", "n_bootstrap", "stability_grade", "is_stable", "peak_index_mode",
        *[F.round(c, 4).alias(c) for c in ("v2_cosine_mean", "v2_cosine_std", "u2_bootstrap_cosine_mean", "peak_index_consistency")],
    )


STABILITY = s.with_(
    s.CA, s.als("ca", ["matrix_id"], 2, 6), s.pseudo("ca", ["matrix_id"], 20, 42), s.als("ps", ["matrix_id", "replicate"], 2, 6, p="b"),
) + """, cv AS (SELECT matrix_id, replicate, abs(sum(a.v2 * b.v2)) / (sqrt(sum(a.v2 * a.v2)) * sqrt(sum(b.v2 * b.v2)) + 1e-12) AS c
 FROM b_vv a JOIN f_vv b USING (matrix_id, col_idx) GROUP BY matrix_id, replicate),
cu AS (SELECT matrix_id, replicate, abs(sum(a.u2 * b.u2)) / (sqrt(sum(a.u2 * a.u2)) * sqrt(sum(b.u2 * b.u2)) + 1e-12) AS c
 FROM b_uu a JOIN f_uu b USING (matrix_id, row_idx) GROUP BY matrix_id, replicate),
pk AS (SELECT matrix_id, replicate, arg_max(col_idx, abs(v2)) AS peak FROM b_vv GROUP BY matrix_id, replicate),
pc AS (SELECT matrix_id, peak, count(*) AS n, min(replicate) AS first FROM pk GROUP BY matrix_id, peak),
pm AS (SELECT matrix_id, arg_max(peak, (n, -first)) AS mode, max(n) / sum(n) AS share FROM pc GROUP BY matrix_id),
m AS (SELECT cv.matrix_id, count(*) AS n, avg(cv.c) AS vm, stddev_pop(cv.c) AS vs, avg(cu.c) AS um, stddev_pop(cu.c) AS us
 FROM cv JOIN cu USING (matrix_id, replicate) GROUP BY cv.matrix_id)
SELECT matrix_id, n AS n_starts, n AS n_bootstrap,
 CASE WHEN vm > 0.9 AND vs < 0.1 AND um > 0.9 AND us < 0.1 THEN 'high' WHEN vm > 0.8 AND um > 0.8 THEN 'medium' WHEN vm > 0.6 THEN 'low' ELSE 'unstable' END AS stability_grade,
 vm > 0.8 AND um > 0.8 AS is_stable, mode AS peak_index_mode, round(vm, 4) AS v2_cosine_mean, round(vs, 4) AS v2_cosine_std,
 round(um, 4) AS u2_bootstrap_cosine_mean, round(share, 4) AS peak_index_consistency
FROM m JOIN pm USING (matrix_id)"""


# -------------------------------------------------------------------- presets
_SLICES = [
    presets.Preset("baseline", "baseline", "all cells", is_fast=True),
    presets.Preset("loo_building", "leave_one_out", "without one segment", exclude_element="BUILDING"),
    presets.Preset("first_rows", "data_subset", "five nations", include_rows=("NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4")),
    presets.Preset("well_filled", "kinematic_cut", "cells with at least 100 orders", cuts=(("n_obs_min", 100.0),)),
]
_SWEPT = s.cte(
    "sw",
    "SELECT 'baseline' AS preset, 0 AS ord, * FROM ca UNION ALL SELECT 'loo_building', 1, * FROM ca WHERE col_label <> 'BUILDING' "
    "UNION ALL SELECT 'first_rows', 2, * FROM ca WHERE row_label IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') "
    "UNION ALL SELECT 'well_filled', 3, * FROM ca WHERE n_obs >= 100",
)


def _sweep(spark, sf):
    return presets.sweep(cellsets.order_value_cells(spark, sf), _SLICES, 20, 42, FIXED)


def _sweep_sql():
    k = ["matrix_id", "preset"]
    return s.with_(
        s.CA, _SWEPT, s.als("sw", k, 2, 6), s.lambdas(k), s.pseudo("sw", k, 20, 42), s.als("ps", [*k, "replicate"], 2, 6, p="b"),
        s.lambdas([*k, "replicate"], p="b"),
    )


def preset_slices(spark, sf):
    out = presets.apply_presets(cellsets.order_value_cells(spark, sf), _SLICES)
    return out.groupBy("matrix_id", "preset").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n_obs").alias("n_orders"))


SLICES = s.with_(s.CA, _SWEPT) + "SELECT matrix_id, preset, count(*) AS n_cells, CAST(sum(n_obs) AS BIGINT) AS n_orders FROM sw GROUP BY matrix_id, preset"


def preset_sweep(spark, sf):
    t = _sweep(spark, sf)
    return t.summary.select(
        "matrix_id", "preset", "ndof_rank1", "ndof_rank2", "k", F.round("lambda_stat", 4).alias("lambda_stat"),
        F.round("p_value", 9).alias("p_value"),
    )


SWEEP = _sweep_sql() + """
SELECT matrix_id, preset, any_value(f_lam.n_obs - (f_lam.n_rows + f_lam.n_cols - 1)) AS ndof_rank1, any_value(f_lam.n_obs - 2 * (f_lam.n_rows + f_lam.n_cols)) AS ndof_rank2,
 count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) AS k, round(any_value(f_lam.lambda_stat), 4) AS lambda_stat,
 round((count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) + 1.0) / (count(*) + 1.0), 9) AS p_value
FROM b_lam JOIN f_lam USING (matrix_id, preset) GROUP BY matrix_id, preset"""


def global_p(spark, sf):
    t = _sweep(spark, sf)
    out, _ = presets.global_significance(t.observed.summary, t.null, presets=presets.preset_table(spark, _SLICES))
    return out.select("matrix_id", "best_preset", "n_presets", "k", F.round("t_obs", 4).alias("t_obs"), F.round("p_global", 9).alias("p_global"))


GLOBAL = _sweep_sql() + """, o AS (SELECT matrix_id, max(lambda_stat) AS t, arg_min(preset, (-round(lambda_stat, 9), CASE preset WHEN 'baseline' THEN 0 WHEN 'loo_building' THEN 1 WHEN 'first_rows' THEN 2 ELSE 3 END)) AS best, count(*) AS n FROM f_lam GROUP BY matrix_id),
z AS (SELECT matrix_id, replicate, max(lambda_stat) AS t FROM b_lam GROUP BY matrix_id, replicate)
SELECT matrix_id, any_value(best) AS best_preset, any_value(n) AS n_presets, count(*) FILTER (z.t >= o.t) AS k, round(any_value(o.t), 4) AS t_obs,
 round((count(*) FILTER (z.t >= o.t) + 1.0) / (count(*) + 1.0), 9) AS p_global FROM z JOIN o USING (matrix_id) GROUP BY matrix_id"""


def sweep_summary(spark, sf):
    t = _sweep(spark, sf)
    order = presets.preset_table(spark, _SLICES).select("preset", "ord")
    peaks = mode.peak(mode.residual_modes(t.observed).filter(F.col("axis") == "col")).select(
        "matrix_id", "preset", F.col("peak_index").alias("v2_peak_index")
    )
    res = t.summary.join(order, "preset").join(peaks, ["matrix_id", "preset"])
    res = res.withColumnRenamed("p_value", "p_local").withColumn("fit_converged", F.lit(True))
    out = presets.sweep_summary(res)
    return out.select(
        "matrix_id", "n_total", "n_converged", "best_preset", "all_agree_significance", "peak_mode",
        *[F.round(c, 4).alias(c) for c in ("lambda_min", "lambda_max", "lambda_std", "p_local_min", "p_local_max", "p_local_std", "peak_consistency")],
    )


SUMMARY = _sweep_sql() + """, p AS (SELECT matrix_id, preset, any_value(f_lam.lambda_stat) AS lam, (count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) + 1.0) / (count(*) + 1.0) AS p
 FROM b_lam JOIN f_lam USING (matrix_id, preset) GROUP BY matrix_id, preset),
pk AS (SELECT matrix_id, preset, any_value(ord) AS ord, arg_max(col_idx, (abs(v2), -col_idx)) AS peak FROM f_vv JOIN (SELECT DISTINCT preset, ord FROM sw) USING (preset) GROUP BY matrix_id, preset),
pc AS (SELECT matrix_id, peak, count(*) AS n, min(ord) AS first FROM pk GROUP BY matrix_id, peak),
pm AS (SELECT matrix_id, arg_max(peak, (n, -first)) AS mode, max(n) / sum(n) AS share FROM pc GROUP BY matrix_id)
SELECT matrix_id, count(*) AS n_total, count(*) AS n_converged, arg_max(preset, (round(lam, 6), -ord)) AS best_preset, count(DISTINCT p < 0.05) <= 1 AS all_agree_significance,
 any_value(mode) AS peak_mode, round(min(lam), 4) AS lambda_min, round(max(lam), 4) AS lambda_max, round(stddev_pop(lam), 4) AS lambda_std, round(min(p), 4) AS p_local_min,
 round(max(p), 4) AS p_local_max, round(stddev_pop(p), 4) AS p_local_std, round(any_value(share), 4) AS peak_consistency
FROM p JOIN pm USING (matrix_id) JOIN (SELECT DISTINCT preset, ord FROM sw) USING (preset) GROUP BY matrix_id"""


ENTRIES = {
    "mode_sign_norm": (mode_sign_norm, SIGN_NORM),
    "sign_conventions": (sign_conventions, SIGN_CONV),
    "topk_mass": (topk_mass, TOPK),
    "gini": (gini, GINI),
    "entropy": (entropy, ENTROPY),
    "window_share": (window_share, WINDOW),
    "peak": (peak, PEAK),
    "localization": (localization, LOCALIZATION),
    "residual_pulls": (residual_pulls, PULLS),
    "chi2_gain": (chi2_gain, GAIN),
    "explained_variance": (explained_variance, EXPLAINED),
    "frobenius": (frobenius, FROBENIUS),
    "predicted_matrix": (predicted_matrix, PREDICTED),
    "residual_mode_vectors": (residual_mode_vectors, MODE_VECTORS),
    "stability_replicates": (stability_replicates, STABILITY),
    "preset_slices": (preset_slices, SLICES),
    "preset_sweep": (preset_sweep, SWEEP),
    "global_p": (global_p, GLOBAL),
    "sweep_summary": (sweep_summary, SUMMARY),
}
