"""Queries on fits, null distributions and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfactor.operators import fit as fitops, ranktest, resample, spectrum
from crossfactor.operators.fit import FitOptions
from crossfactor.plans import cellsets
from crossfactor.registry import sqltext as s
from crossfactor.registry.spectra import _SHIFTED, _gram, _leading

#: Fixed rounds, so that the check engine can follow.
FIXED = FitOptions(max_iter=6, tol=0.0, start_rounds=2)
FIXED1 = FitOptions(max_iter=6, tol=0.0, start_rounds=2, rank=1)
B = 20


def rank1_chi2(spark, sf):
    t = fitops.fit(cellsets.order_value_cells(spark, sf), FIXED1, unique=True)
    return t.summary.select("matrix_id", "n_obs", "n_rows", "n_cols", "ndof_rank1", F.round("chi2_rank1", 6).alias("chi2_rank1"))


RANK1_CHI2 = s.with_(s.CA, s.als("ca", ["matrix_id"], 2, 6, 1)) + """
SELECT matrix_id, count(*) AS n_obs, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_cols,
       count(*) - (count(DISTINCT row_idx) + count(DISTINCT col_idx) - 1) AS ndof_rank1,
       round(sum(wc * r * r), 6) AS chi2_rank1
FROM f_r1 GROUP BY matrix_id"""


def rank1_row_factors(spark, sf):
    t = fitops.fit(cellsets.priority_cells(spark, sf), FIXED1, unique=True)
    return t.rows.select("matrix_id", "row_idx", F.round(F.col("u") / 1000, 6).alias("u_thousands"))


RANK1_ROWS = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6, 1)) + """
SELECT matrix_id, row_idx, round(u * s / 1000, 6) AS u_thousands FROM f_u JOIN f_s USING (matrix_id)"""


def rank1_col_factors(spark, sf):
    t = fitops.fit(cellsets.priority_cells(spark, sf), FIXED1, unique=True)
    return t.cols.select("matrix_id", "col_idx", F.round("v", 8).alias("v"))


RANK1_COLS = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6, 1)) + """
SELECT matrix_id, col_idx, round(v, 8) AS v FROM f_v"""


def lambda_by_matrix(spark, sf):
    t = fitops.fit(cellsets.priority_cells(spark, sf), FIXED, unique=True)
    return t.summary.select(
        "matrix_id", "n_obs", "ndof_rank1", "ndof_rank2",
        *[F.round(c, 5).alias(c) for c in ("chi2_rank1", "chi2_rank2", "lambda_stat")],
    )


_NDOF = "n_obs - (n_rows + n_cols - 1) AS ndof_rank1, n_obs - (2 * n_rows + 2 * n_cols) AS ndof_rank2"
LAMBDA = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6), s.lambdas(["matrix_id"])) + f"""
SELECT matrix_id, n_obs, {_NDOF}, round(chi2_rank1, 5) AS chi2_rank1, round(chi2_rank2, 5) AS chi2_rank2,
       round(lambda_stat, 5) AS lambda_stat FROM f_lam"""


def lambda_many_matrices(spark, sf):
    t = fitops.fit(cellsets.supplier_cells(spark, sf), FIXED, unique=True)
    return t.summary.select(
        "matrix_id", "n_obs", "ndof_rank1", "ndof_rank2",
        *[F.round(c, 4).alias(c) for c in ("chi2_rank1", "chi2_rank2")],
    )


LAMBDA_MANY = s.with_(s.CS, s.als("cs", ["matrix_id"], 2, 6), s.lambdas(["matrix_id"])) + f"""
SELECT matrix_id, n_obs, {_NDOF}, round(chi2_rank1, 4) AS chi2_rank1, round(chi2_rank2, 4) AS chi2_rank2 FROM f_lam"""


def rank2_factors(spark, sf):
    t = fitops.fit(cellsets.order_value_cells(spark, sf), FIXED, unique=True)
    return t.cols.select("matrix_id", "col_idx", F.round("v1", 6).alias("v1"), F.round("v2", 6).alias("v2"))


RANK2_FACTORS = s.with_(s.CA, s.als("ca", ["matrix_id"], 2, 6)) + """
SELECT matrix_id, col_idx, round(v1, 6) AS v1, round(v2, 6) AS v2 FROM f_vv"""

LARGE = FitOptions(max_iter=4, tol=0.0, start_rounds=2, group_max_cells=20_000)


def large_matrix_fit(spark, sf):
    """Every order line of the part x nation matrix, through the relational form whenever it has over 20,000 cells."""
    t = fitops.fit(cellsets.line_observations(spark, sf), LARGE)
    return t.summary.select(
        "matrix_id", "n_obs", "n_rows", "n_cols", "ndof_rank1",
        F.round("chi2_rank1", 3).alias("chi2_rank1"), F.round("chi2_rank2", 3).alias("chi2_rank2"),
    )


LARGE_SQL = s.with_(
    s.CP,
    s.cte(
        "cpc",
        "SELECT matrix_id, row_idx, col_idx, sum(value / (total_err * total_err)) / sum(1.0 / (total_err * total_err)) AS value, "
        "1.0 / sqrt(sum(1.0 / (total_err * total_err))) AS total_err FROM cp GROUP BY matrix_id, row_idx, col_idx",
    ),
    s.als("cpc", ["matrix_id"], 2, 4),
    s.cte("pr", "SELECT matrix_id, row_idx, col_idx, p1 * s AS p1, p2 * s AS p2 FROM f_r1 JOIN f_r2 USING (matrix_id, row_idx, col_idx) JOIN f_s USING (matrix_id)"),
) + """
SELECT matrix_id, count(*) AS n_obs, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_cols,
       count(*) - (count(DISTINCT row_idx) + count(DISTINCT col_idx) - 1) AS ndof_rank1,
       round(sum(((value - p1) / total_err) * ((value - p1) / total_err)), 3) AS chi2_rank1,
       round(sum(((value - p2) / total_err) * ((value - p2) / total_err)), 3) AS chi2_rank2
FROM cp JOIN pr USING (matrix_id, row_idx, col_idx) GROUP BY matrix_id"""


#: To the fixed point, in place of so many rounds.
_AHEAD = FitOptions(max_iter=60, tol=1e-11, start_rounds=2, rank=1, group_max_cells=20_000, accelerate=True)


def large_accelerated_fit(spark, sf):
    """The part x nation matrix of all order lines, fitted by joins until it has settled, with extrapolated rounds."""
    t = fitops.fit(cellsets.line_observations(spark, sf), _AHEAD, form="relational")
    return t.summary.select(
        "matrix_id", "n_obs", "n_rows", "n_cols", F.round(F.col("chi2_rank1") / F.col("n_obs"), 5).alias("chi2_per_line"),
        F.col("converged_rank1").alias("settled"),
    )


# plain rounds, many enough to reach the same point
ACCELERATED = s.with_(
    s.CP,
    s.cte(
        "cpc",
        "SELECT matrix_id, row_idx, col_idx, sum(value / (total_err * total_err)) / sum(1.0 / (total_err * total_err)) AS value, "
        "1.0 / sqrt(sum(1.0 / (total_err * total_err))) AS total_err FROM cp GROUP BY matrix_id, row_idx, col_idx",
    ),
    s.als("cpc", ["matrix_id"], 2, 80, 1),
    s.cte("pr", "SELECT matrix_id, row_idx, col_idx, p1 * s AS p1 FROM f_r1 JOIN f_s USING (matrix_id)"),
) + """
SELECT matrix_id, count(*) AS n_obs, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_cols,
       round(sum(((value - p1) / total_err) * ((value - p1) / total_err)) / count(*), 5) AS chi2_per_line, true AS settled
FROM cp JOIN pr USING (matrix_id, row_idx, col_idx) GROUP BY matrix_id"""


def pseudo_data(spark, sf):
    cells = cellsets.order_value_cells(spark, sf)
    t = fitops.fit(cells, FIXED1, unique=True)
    many = resample.pseudo_data(fitops.predict(cells, t, 1), "pred1", B)
    return many.groupBy("matrix_id", "replicate").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("value") / 1000), 6).alias("mean_thousands"),
        F.round(F.max(F.col("value") / 1000), 6).alias("max_thousands"),
    )


PSEUDO = s.with_(s.CA, s.als("ca", ["matrix_id"], 2, 6, 1), s.pseudo("ca", ["matrix_id"], B, 42)) + """
SELECT matrix_id, CAST(replicate AS BIGINT) AS replicate, count(*) AS n, round(avg(value / 1000), 6) AS mean_thousands,
       round(max(value / 1000), 6) AS max_thousands FROM ps GROUP BY matrix_id, replicate"""


def _null(spark, sf, n=B):
    cells = cellsets.order_value_cells(spark, sf)
    t = fitops.fit(cells, FIXED, unique=True)
    return t, ranktest.null_distribution(cells, t, n, 42, FIXED)


def _null_sql(n=B):
    return s.with_(
        s.CA, s.als("ca", ["matrix_id"], 2, 6), s.lambdas(["matrix_id"]), s.pseudo("ca", ["matrix_id"], n, 42),
        s.als("ps", ["matrix_id", "replicate"], 2, 6, p="b"), s.lambdas(["matrix_id", "replicate"], p="b"),
    )


def lambda_null(spark, sf):
    _, null = _null(spark, sf)
    return null.select("matrix_id", "replicate", F.round("lambda_stat", 4).alias("lambda_stat"), F.round("chi2_rank1", 4).alias("chi2_rank1"))


LAMBDA_NULL = _null_sql() + """
SELECT matrix_id, CAST(replicate AS BIGINT) AS replicate, round(lambda_stat, 4) AS lambda_stat, round(chi2_rank1, 4) AS chi2_rank1 FROM b_lam"""


def p_value(spark, sf):
    t, null = _null(spark, sf)
    p = ranktest.p_values(t.summary, null)
    return p.select("matrix_id", "k", "n_used", "n_failed", F.round("p_value", 9).alias("p_value"))


P_VALUE = _null_sql() + """
SELECT matrix_id, count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) AS k, count(*) AS n_used, CAST(0 AS BIGINT) AS n_failed,
       round((count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) + 1.0) / (count(*) + 1.0), 9) AS p_value
FROM b_lam JOIN f_lam USING (matrix_id) GROUP BY matrix_id"""


def null_histogram(spark, sf):
    _, null = _null(spark, sf)
    h = ranktest.null_histogram(null, bins=10)
    return h.select("matrix_id", "bin", "n_in_bin", F.round("left_edge", 4).alias("left_edge"), F.round("density", 6).alias("density"))


NULL_HIST = _null_sql() + """, e AS (SELECT matrix_id, min(lambda_stat) AS lo, max(lambda_stat) AS hi, count(*) AS n FROM b_lam GROUP BY matrix_id),
b AS (SELECT matrix_id, lo, n, (hi - lo) / 10 AS width, CAST(least(floor((lambda_stat - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin FROM b_lam JOIN e USING (matrix_id))
SELECT matrix_id, bin, count(*) AS n_in_bin, round(any_value(lo) + bin * any_value(width), 4) AS left_edge,
       round(count(*) / (any_value(n) * any_value(width)), 6) AS density FROM b GROUP BY matrix_id, bin"""


def null_percentiles(spark, sf):
    _, null = _null(spark, sf)
    out = ranktest.null_percentiles(null)
    return out.select("matrix_id", *[F.round(c, 4).alias(c) for c in ("p50", "p90", "p95", "p99")])


NULL_PCT = _null_sql() + """
SELECT matrix_id, round(quantile_cont(lambda_stat, 0.5), 4) AS p50, round(quantile_cont(lambda_stat, 0.9), 4) AS p90,
       round(quantile_cont(lambda_stat, 0.95), 4) AS p95, round(quantile_cont(lambda_stat, 0.99), 4) AS p99
FROM b_lam GROUP BY matrix_id"""


def injection(spark, sf):
    """A separable table with the observed cells and errors, then its own rank test."""
    cells = cellsets.order_value_cells(spark, sf).withColumn("total_err", F.col("total_err") / 1e6)
    rows, cols = resample.smooth_effects(cells)
    inj = resample.inject(cells, rows, cols)
    t = fitops.fit(inj, FIXED, unique=True)
    null = ranktest.null_distribution(inj, t, B, 42, FIXED)
    p = ranktest.p_values(t.summary, null)
    return p.select("matrix_id", "k", F.round("p_value", 9).alias("p_value"), (F.col("p_value") > 0.05).alias("passed"))


_INJ_KEY = "'12345|' || matrix_id || '|inject|' || CAST(row_idx AS VARCHAR) || '|' || CAST(col_idx AS VARCHAR) || '|inject'"
INJECTION = s.with_(
    s.CA,
    s.cte("hc", "SELECT matrix_id, col_idx, h / sqrt(sum(h * h) OVER (PARTITION BY matrix_id)) AS h FROM (SELECT DISTINCT matrix_id, col_idx, 1.0 + 0.2 * cos(1.0 + col_idx) AS h FROM ca)"),
    s.cte("inj", f"SELECT matrix_id, row_idx, col_idx, (1.0 + 0.2 * sin(1.0 + row_idx)) * h + total_err / 1e6 * ({s.normal(_INJ_KEY)}) AS value, total_err / 1e6 AS total_err FROM ca JOIN hc USING (matrix_id, col_idx)"),
    s.als("inj", ["matrix_id"], 2, 6), s.lambdas(["matrix_id"]), s.pseudo("inj", ["matrix_id"], B, 42),
    s.als("ps", ["matrix_id", "replicate"], 2, 6, p="b"), s.lambdas(["matrix_id", "replicate"], p="b"),
) + """
SELECT matrix_id, count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) AS k,
       round((count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) + 1.0) / (count(*) + 1.0), 9) AS p_value,
       (count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) + 1.0) / (count(*) + 1.0) > 0.05 AS passed
FROM b_lam JOIN f_lam USING (matrix_id) GROUP BY matrix_id"""


def verdict(spark, sf):
    """Gates on fits with the default stopping rule are checked by tests; here the rounds are fixed and count as settled."""
    t, null = _null(spark, sf)
    p = ranktest.p_values(t.summary, null)
    result = t.summary.drop("replicate").join(p, "matrix_id")
    result = result.withColumn("converged_rank1", F.lit(True)).withColumn("converged_rank2", F.lit(True))
    return ranktest.verdict(result).select("matrix_id", "verdict", "verdict_reason")


VERDICT = _null_sql() + """, p AS (SELECT matrix_id, (count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) + 1.0) / (count(*) + 1.0) AS p_value
 FROM b_lam JOIN f_lam USING (matrix_id) GROUP BY matrix_id)
SELECT matrix_id,
 CASE WHEN n_obs - (n_rows + n_cols - 1) <= 0 OR n_obs - 2 * (n_rows + n_cols) <= 0 OR lambda_stat < -1 THEN 'INCONCLUSIVE'
      WHEN p_value < 0.05 THEN 'REJECTED' ELSE 'NOT_REJECTED' END AS verdict,
 'p-value = ' || printf('%.4f', p_value) || CASE WHEN p_value < 0.05 THEN ' < 0.05' ELSE ' >= 0.05' END AS verdict_reason
FROM p JOIN f_lam USING (matrix_id)"""


#: Three rounds with a tolerance that some matrices meet by then and others do not.
_HEALTH = FitOptions(max_iter=3, tol=2e-7, start_rounds=2, rank=1)


def fit_health(spark, sf):
    """Health of rank-one fits that stop early: flags from the fit itself, with gradient and condition."""
    cells = cellsets.priority_cells(spark, sf)
    t = fitops.fit(cells, _HEALTH, unique=True)
    condition = spectrum.condition_number(spectrum.singular_values(cells, 7))
    h = ranktest.fit_health(t.summary, t, gradient=ranktest.gradient_norm(cells, t), condition=condition)
    return h.select(
        "matrix_id", F.round("chi2_ndof", 6).alias("chi2_ndof"), F.round(F.log10("gradient_norm"), 4).alias("log_gradient"),
        F.round("condition_number", 4).alias("condition_number"), "converged", "is_underconstrained", "is_catastrophically_bad",
        "is_gradient_ok", "passed", "passed_strict", "severity", F.concat_ws("; ", "messages").alias("messages"),
        F.concat_ws("; ", "warnings").alias("warnings"),
    )


_NOTES = "array_to_string(list_filter([{}], lambda m: m IS NOT NULL), '; ')"
FIT_HEALTH = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 3, 1), _gram("cc", "value / total_err"), _leading("g0", "top", 14), _SHIFTED, _leading("sh", "low", 24)) + """,
big AS (SELECT matrix_id, max(mp) AS mp FROM (SELECT matrix_id, abs(u * s) AS mp FROM f_u JOIN f_s USING (matrix_id) UNION ALL SELECT matrix_id, abs(v) FROM f_v) GROUP BY matrix_id),
c0 AS (SELECT matrix_id, sum(w * (y - a.u * b.v) * (y - a.u * b.v)) AS c0 FROM f_c JOIN f_u2 a USING (matrix_id, row_idx) JOIN f_v2 b USING (matrix_id, col_idx) GROUP BY matrix_id),
c1 AS (SELECT matrix_id, sum(w * r * r) AS c1, sum(wc * r * r) / (count(*) - (count(DISTINCT row_idx) + count(DISTINCT col_idx) - 1)) AS x FROM f_r1 GROUP BY matrix_id),
gr AS (SELECT matrix_id, sqrt(sum(g * g)) AS g FROM (
 SELECT matrix_id, sum(-2 * wc * r * v / s) AS g FROM f_r1 JOIN f_v USING (matrix_id, col_idx) JOIN f_s USING (matrix_id) GROUP BY matrix_id, row_idx
 UNION ALL SELECT matrix_id, sum(-2 * wc * r * u) FROM f_r1 JOIN f_u USING (matrix_id, row_idx) GROUP BY matrix_id, col_idx) GROUP BY matrix_id),
h AS (SELECT matrix_id, x, g, mp, sqrt(t.l / (t.l - b.l)) AS c, abs(c0 - c1) < 2e-7 * greatest(1.0, c1) AS converged
 FROM c0 JOIN c1 USING (matrix_id) JOIN gr USING (matrix_id) JOIN big USING (matrix_id) JOIN topl t USING (matrix_id) JOIN lowl b USING (matrix_id)),
n AS (SELECT *, converged AND NOT (x < 0.1 OR x > 10 OR c > 1e10) AS passed, """ + _NOTES.format(
    "CASE WHEN NOT converged THEN 'fit did not converge' END, CASE WHEN x < 0.1 THEN printf('chi2/ndof = %.3f is suspiciously low', x) END, "
    "CASE WHEN x > 10 THEN printf('chi2/ndof = %.3f is far too high', x) END, CASE WHEN c > 1e10 THEN 'problem is ill-conditioned' END, "
    "CASE WHEN g > 1e-3 THEN 'gradient does not vanish' END"
) + " AS messages, " + _NOTES.format(
    "CASE WHEN x > 0.1 AND x < 0.3 THEN printf('chi2/ndof = %.3f is low', x) END, CASE WHEN x > 3 AND x < 10 THEN printf('chi2/ndof = %.3f is elevated', x) END, "
    "CASE WHEN c > 1e6 AND c <= 1e10 THEN 'condition is elevated' END, CASE WHEN g > 1e-6 AND g <= 1e-3 THEN 'gradient is elevated' END, "
    "CASE WHEN mp > 1e6 THEN 'very large parameters' END"
) + """ AS warnings FROM h)
SELECT matrix_id, round(x, 6) AS chi2_ndof, round(log10(g), 4) AS log_gradient, round(c, 4) AS condition_number, converged, x < 0.1 OR c > 1e10 AS is_underconstrained,
 x > 10 AS is_catastrophically_bad, g <= 1e-3 AS is_gradient_ok, passed, passed AND g <= 1e-3 AND warnings = '' AS passed_strict,
 CASE WHEN NOT passed THEN 'error' WHEN warnings <> '' THEN 'warning' ELSE 'ok' END AS severity, messages, warnings FROM n"""


def multistart_best(spark, sf):
    opt = FitOptions(max_iter=6, tol=0.0, rank=1)
    t = fitops.multistart(cellsets.priority_cells(spark, sf), 3, 42, opt, unique=True)
    best = fitops.best_start(t.summary, 1)
    return best.select("matrix_id", F.round("chi2_rank1", 5).alias("chi2_rank1"))


def _random_rounds() -> list[str]:
    key = "'42|' || matrix_id || '|' || CAST(start AS VARCHAR) || '|' || CAST(col_idx AS VARCHAR) || '|start1'"
    k, out = "matrix_id, start", []
    out.append(s.cte("ms", "SELECT * FROM cc, (SELECT unnest(range(3)) AS start)"))
    out.append(s.cte("sc", "SELECT matrix_id, sqrt(avg(value * value)) AS s FROM cc GROUP BY matrix_id"))
    out.append(s.cte("c", f"SELECT {k}, row_idx, col_idx, value / s AS y, 1.0 / ((total_err / s) * (total_err / s) + 1e-8) AS w, 1.0 / ((total_err / s) * (total_err / s)) AS wc FROM ms JOIN sc USING (matrix_id)"))
    out.append(s.cte("v0", f"SELECT {k}, col_idx, z / sqrt(sum(z * z) OVER (PARTITION BY {k})) AS v FROM (SELECT DISTINCT {k}, col_idx, {s.normal(key)} AS z FROM ms)"))
    for i in range(1, 7):
        out.append(s.cte(f"u{i}", f"SELECT {k}, row_idx, sum(w * v * y) / (sum(w * v * v) + 1e-8) AS u FROM c JOIN v{i - 1} USING ({k}, col_idx) GROUP BY {k}, row_idx"))
        out.append(s.cte(f"v{i}", f"SELECT {k}, col_idx, sum(w * u * y) / (sum(w * u * u) + 1e-8) AS v FROM c JOIN u{i} USING ({k}, row_idx) GROUP BY {k}, col_idx"))
    return out


MULTISTART = s.with_(s.CC, _random_rounds()) + """,
x AS (SELECT matrix_id, start, sum(wc * (y - u * v) * (y - u * v)) AS chi2 FROM c JOIN u6 USING (matrix_id, start, row_idx) JOIN v6 USING (matrix_id, start, col_idx) GROUP BY matrix_id, start)
SELECT matrix_id, round(min(chi2), 5) AS chi2_rank1 FROM x GROUP BY matrix_id"""


ENTRIES = {
    "rank1_chi2": (rank1_chi2, RANK1_CHI2),
    "rank1_row_factors": (rank1_row_factors, RANK1_ROWS),
    "rank1_col_factors": (rank1_col_factors, RANK1_COLS),
    "rank2_factors": (rank2_factors, RANK2_FACTORS),
    "lambda_by_matrix": (lambda_by_matrix, LAMBDA),
    "lambda_many_matrices": (lambda_many_matrices, LAMBDA_MANY),
    "large_matrix_fit": (large_matrix_fit, LARGE_SQL),
    "large_accelerated_fit": (large_accelerated_fit, ACCELERATED),
    "pseudo_data": (pseudo_data, PSEUDO),
    "lambda_null": (lambda_null, LAMBDA_NULL),
    "p_value": (p_value, P_VALUE),
    "null_histogram": (null_histogram, NULL_HIST),
    "null_percentiles": (null_percentiles, NULL_PCT),
    "injection": (injection, INJECTION),
    "verdict": (verdict, VERDICT),
    "fit_health": (fit_health, FIT_HEALTH),
    "multistart_best": (multistart_best, MULTISTART),
}
