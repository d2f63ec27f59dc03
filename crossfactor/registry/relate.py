"""Queries on replication, validation, covariance and tail probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfactor.functions.special import chi2_pvalue, clopper_pearson as cp_udf, posterior_interval
from crossfactor.operators import covariance as cov, fit as fitops, mode, replicate, spectrum, validate
from crossfactor.operators.fit import FitOptions
from crossfactor.plans import cellsets
from crossfactor.registry import sqltext as s
from crossfactor.registry.fits import FIXED
from crossfactor.session import cut, keep


# ---------------------------------------------------------------- replication
def _embedding_pairs(spark, sf):
    """Every embedding against the mean embedding of its label."""
    em = keep(cellsets.embedding_modes(spark, sf))
    mean = em.groupBy("label", "idx").agg(F.avg("val").alias("val"))
    mean = mean.select(F.concat(F.lit("label "), "label").alias("mode_id"), F.lit("col").alias("axis"), "idx", "val")
    own = em.select(F.col("matrix_id").alias("mode_id"), F.lit("col").alias("axis"), "idx", "val")
    pairs = em.select(F.concat(F.lit("label "), "label").alias("source_a"), F.col("matrix_id").alias("source_b")).distinct()
    return replicate._joined(own.unionByName(mean), pairs)


_EMJ = s.with_(s.EM) + """, j AS (SELECT 'label ' || label AS source_a, matrix_id AS source_b, m AS a, val AS b FROM em JOIN (SELECT label, idx, avg(val) AS m FROM em GROUP BY label, idx) USING (label, idx))
"""


def mode_cosine_pairs(spark, sf):
    return replicate.cosines(_embedding_pairs(spark, sf), replicate.PAIR).select(*replicate.PAIR, "n", F.round("cosine", 8).alias("cosine"))


COSINE = _EMJ + "SELECT source_a, source_b, count(*) AS n, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 8) AS cosine FROM j GROUP BY 1, 2"


def spearman_pairs(spark, sf):
    out = replicate.spearman(_embedding_pairs(spark, sf), replicate.PAIR)
    return out.select(*replicate.PAIR, F.round("spearman", 8).alias("spearman"), F.round("spearman_p", 8).alias("spearman_p"))


SPEARMAN = _EMJ + """, r AS (SELECT source_a, source_b, rank() OVER (PARTITION BY source_a, source_b ORDER BY abs(a)) + (count(*) OVER (PARTITION BY source_a, source_b, abs(a)) - 1) / 2 AS ra,
 rank() OVER (PARTITION BY source_a, source_b ORDER BY abs(b)) + (count(*) OVER (PARTITION BY source_a, source_b, abs(b)) - 1) / 2 AS rb FROM j)
SELECT source_a, source_b, round(c, 8) AS spearman,
 round(1 - abs(c) * list_sum(list_transform(range(n // 2 - 1), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4.0) + k * ln(1 - c * c)))), 8) AS spearman_p
FROM (SELECT source_a, source_b, corr(ra, rb) AS c, count(*) AS n FROM r GROUP BY source_a, source_b)"""


def vector_cosines(spark, sf):
    """Cosine of whole array columns: every embedding against the embedding with the lowest number of its label."""
    em = cellsets.table(spark, sf, "embeddings")
    ref = em.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return em.join(ref, "label").select("vec_id", F.round(replicate.vector_cosine(F.col("embedding"), F.col("ref")), 7).alias("cosine"))


VECTOR = s.with_(s.EM) + """, r AS (SELECT label, min(CAST(matrix_id AS BIGINT)) AS ref FROM em GROUP BY label)
SELECT CAST(e.matrix_id AS BIGINT) AS vec_id, round(sum(e.val * b.val) / sqrt(sum(e.val * e.val) * sum(b.val * b.val)), 7) AS cosine
FROM em e JOIN r USING (label) JOIN em b ON CAST(b.matrix_id AS BIGINT) = r.ref AND b.idx = e.idx GROUP BY e.matrix_id"""


def _priority_modes(spark, sf):
    t = fitops.fit(cellsets.priority_cells(spark, sf), FIXED, unique=True)
    m = mode.residual_modes(t).withColumnRenamed("matrix_id", "mode_id")
    return m.select("mode_id", "axis", "idx", "val", F.when(F.col("axis") == "col", F.col("idx").cast("double")).alias("grid"))


def modes_sql(base: str, src: str, pairs: str) -> str:
    """Modes of ``src`` and their comparisons, for the pairs that ``pairs`` admits."""
    return s.with_(base, s.als(src, ["matrix_id"], 2, 6)) + f""", ids AS (SELECT matrix_id AS id, count(DISTINCT col_idx) AS nv, count(DISTINCT row_idx) AS nu FROM {src} GROUP BY 1),
al AS (SELECT a.id AS source_a, b.id AS source_b, a.nv = b.nv AND a.nu = b.nu AS comparable FROM ids a JOIN ids b ON {pairs}), pr AS (SELECT * FROM al WHERE comparable),
jv AS (SELECT source_a, source_b, x.col_idx AS idx, x.v2 AS a, y.v2 AS b FROM pr JOIN f_vv x ON x.matrix_id = source_a JOIN f_vv y ON y.matrix_id = source_b AND y.col_idx = x.col_idx),
ju AS (SELECT source_a, source_b, x.u2 AS a, y.u2 AS b FROM pr JOIN f_uu x ON x.matrix_id = source_a JOIN f_uu y ON y.matrix_id = source_b AND y.row_idx = x.row_idx),
cv AS (SELECT source_a, source_b, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS v, arg_max(idx, (abs(a), -idx)) AS pa, arg_max(idx, (abs(b), -idx)) AS pb, count(*) AS n FROM jv GROUP BY 1, 2),
cu AS (SELECT source_a, source_b, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS u FROM ju GROUP BY 1, 2),
cmp AS (SELECT source_a, source_b, abs(v) AS v2_cosine, CASE WHEN v < 0 THEN -u ELSE u END AS u2_cosine, pa, pb, v >= 0 AS sign_aligned,
 0.5 * abs(v) + 0.3 * abs(u) + 0.2 * CASE WHEN pa = pb THEN 1.0 ELSE greatest(0.0, 1 - abs(pa - pb) / n) END AS score FROM cv JOIN cu USING (source_a, source_b))
"""


_MODES_SQL = modes_sql(s.CC, "cc", "a.id < b.id")


def compare_direct(spark, sf):
    m = _priority_modes(spark, sf)
    out = replicate.compare_direct(m, replicate.unordered_pairs(m))
    return out.select(
        "source_a", "source_b", "comparable", "sign_aligned", "v2_peak_a", "v2_peak_b", "replication_grade",
        *[F.round(c, 4).alias(c) for c in ("v2_cosine", "u2_cosine", "replication_score")],
    )


_GRADE = "CASE WHEN score > 0.9 THEN 'excellent' WHEN score > 0.75 THEN 'good' WHEN score > 0.5 THEN 'moderate' ELSE 'poor' END"
DIRECT = _MODES_SQL + f"""SELECT source_a, source_b, comparable, sign_aligned, pa AS v2_peak_a, pb AS v2_peak_b, CASE WHEN comparable THEN {_GRADE} ELSE 'incompatible' END AS replication_grade,
 round(v2_cosine, 4) AS v2_cosine, round(u2_cosine, 4) AS u2_cosine, round(score, 4) AS replication_score FROM al LEFT JOIN cmp USING (source_a, source_b)"""


def replication_report(spark, sf):
    m = _priority_modes(spark, sf)
    out = replicate.compare_direct(m, replicate.unordered_pairs(m)).withColumn("dataset", F.lit("orders"))
    return replicate.replication_report(out, ["dataset"]).select(
        "dataset", "n_comparisons", "all_replicate", "best_comparison", "worst_comparison",
        F.round("mean_v2_cosine", 4).alias("mean_v2_cosine"), F.round("mean_replication_score", 4).alias("mean_replication_score"),
    )


def report_sql(modes: str, dataset: str) -> str:
    return modes + f"""SELECT '{dataset}' AS dataset, (SELECT count(*) FROM al) AS n_comparisons, bool_and({_GRADE} IN ('excellent', 'good')) AS all_replicate,
 arg_max(source_a || ' vs ' || source_b, score) AS best_comparison, arg_min(source_a || ' vs ' || source_b, score) AS worst_comparison,
 round(avg(v2_cosine), 4) AS mean_v2_cosine, round(avg(score), 4) AS mean_replication_score FROM cmp"""


REPORT = report_sql(_MODES_SQL, "orders")


def compare_interpolated(spark, sf):
    """Event curves of different types as modes on their own day grids, compared over their overlap."""
    cv = cellsets.event_curves(spark, sf)
    m = cv.select(F.col("matrix_id").alias("mode_id"), F.lit("col").alias("axis"), F.col("t").cast("int").alias("idx"), F.col("y").alias("val"), F.col("t").alias("grid"))
    out = replicate.compare_interpolated(m, replicate.unordered_pairs(m), 40)
    return out.select(
        "source_a", "source_b", "comparable", "v2_peak_a", "v2_peak_b", "replication_grade",
        *[F.round(c, 6).alias(c) for c in ("v2_cosine", "v2_spearman", "replication_score")],
    )


INTERPOLATED = s.with_(s.CV) + """, e AS (SELECT matrix_id AS id, min(t) AS lo, max(t) AS hi FROM cv GROUP BY matrix_id),
pr AS (SELECT a.id AS source_a, b.id AS source_b, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM e a JOIN e b ON a.id < b.id),
g AS (SELECT source_a, source_b, i, CASE WHEN i = 39 THEN hi ELSE lo + i * ((hi - lo) / 39) END AS t FROM pr, (SELECT unnest(range(40)) AS i)),
sg AS (SELECT matrix_id, t AS t0, lead(t) OVER w AS t1, y AS y0, lead(y) OVER w AS y1 FROM cv WINDOW w AS (PARTITION BY matrix_id ORDER BY t)),
ia AS (SELECT source_a, source_b, i, y0 + (t - t0) / (t1 - t0) * (y1 - y0) AS a FROM g JOIN sg ON matrix_id = source_a AND t BETWEEN t0 AND t1 QUALIFY row_number() OVER (PARTITION BY source_a, source_b, i ORDER BY t0) = 1),
ib AS (SELECT source_a, source_b, i, y0 + (t - t0) / (t1 - t0) * (y1 - y0) AS b FROM g JOIN sg ON matrix_id = source_b AND t BETWEEN t0 AND t1 QUALIFY row_number() OVER (PARTITION BY source_a, source_b, i ORDER BY t0) = 1),
j AS (SELECT * FROM ia JOIN ib USING (source_a, source_b, i)),
r AS (SELECT *, rank() OVER (PARTITION BY source_a, source_b ORDER BY abs(a)) AS ra, rank() OVER (PARTITION BY source_a, source_b ORDER BY abs(b)) AS rb FROM j),
m AS (SELECT source_a, source_b, abs(sum(a * b) / sqrt(sum(a * a) * sum(b * b))) AS c, corr(ra, rb) AS sp, arg_max(i, (abs(a), -i)) AS pa, arg_max(i, (abs(b), -i)) AS pb, count(*) AS n FROM r GROUP BY 1, 2),
q AS (SELECT *, 0.6 * c + 0.2 * CASE WHEN pa = pb THEN 1.0 ELSE greatest(0.0, 1 - abs(pa - pb) / n) END AS score FROM m)
SELECT source_a, source_b, TRUE AS comparable, CAST(pa AS INTEGER) AS v2_peak_a, CAST(pb AS INTEGER) AS v2_peak_b, """ + _GRADE + """ AS replication_grade, round(c, 6) AS v2_cosine,
 round(sp, 6) AS v2_spearman, round(score, 6) AS replication_score FROM q"""


# ----------------------------------------------------------------- validation
def spot_checks(spark, sf):
    """Checks written as half the exact labels, some by fragment, some missing, against every cell."""
    c = cellsets.order_value_cells(spark, sf).withColumn("seq", F.col("row_idx") * 1000 + F.col("col_idx"))
    want = c.select(
        F.col("seq").alias("check_id"),
        F.when(F.col("row_idx") % 5 == 4, F.lit("NOWHERE")).when(F.col("row_idx") % 2 == 0, F.col("row_label")).otherwise(F.substring("row_label", 1, 8)).alias("row_label"),
        F.when(F.col("row_idx") % 2 == 0, F.col("col_label")).otherwise(F.substring("col_label", 1, 4)).alias("col_label"),
        (F.floor(F.col("value") / 50000) * 50000).alias("expected"), F.lit(0.1).alias("tolerance"), F.lit(False).alias("is_log"),
    )
    out = validate.spot_checks(c, want.withColumn("expected", F.col("expected").cast("double")))
    return out.select("check_id", "matched_row", "matched_col", F.coalesce("tier", F.lit(-1)).alias("tier"), F.round("relative_diff", 7).alias("relative_diff"), "passed")


SPOT = s.with_(s.CA) + """, w AS (SELECT row_idx * 1000 + col_idx AS check_id, CASE WHEN row_idx % 5 = 4 THEN 'NOWHERE' WHEN row_idx % 2 = 0 THEN row_label ELSE substr(row_label, 1, 8) END AS wr,
 CASE WHEN row_idx % 2 = 0 THEN col_label ELSE substr(col_label, 1, 4) END AS wc, floor(value / 50000) * 50000 AS expected FROM ca),
j AS (SELECT check_id, expected, row_label, col_label, value, CASE WHEN wr = row_label AND wc = col_label THEN 0 WHEN contains(row_label, wr) AND contains(col_label, wc) THEN 1 ELSE 2 END AS tier, row_idx * 1000 + col_idx AS seq
 FROM w JOIN ca ON (wr = row_label AND wc = col_label) OR (contains(row_label, wr) AND contains(col_label, wc))
 OR (len(list_filter(string_split(wr, '_'), lambda x: contains(row_label, x))) > 0 AND len(list_filter(string_split(wc, '='), lambda x: contains(col_label, x))) > 0)
 QUALIFY row_number() OVER (PARTITION BY check_id ORDER BY tier, seq) = 1)
SELECT check_id, row_label AS matched_row, col_label AS matched_col, coalesce(tier, -1) AS tier, round(abs(value - w.expected) / abs(w.expected), 7) AS relative_diff,
 coalesce(abs(value - w.expected) / abs(w.expected) <= 0.1, FALSE) AS passed FROM w LEFT JOIN j USING (check_id)"""


def identity_report(spark, sf):
    """Report per nation over its spot checks, with one provenance warning for every one with thin cells."""
    c = cut(spot_checks(spark, sf)).withColumn("row_idx", F.floor(F.col("check_id") / 1000).cast("int"))
    warn = cellsets.order_value_cells(spark, sf).filter(F.col("n_obs") < 60).select("row_idx")
    return validate.identity_report(c, warn, ["row_idx"]).select("row_idx", "n_checks", "n_passed", F.col("n_warnings").cast("bigint").alias("n_warnings"), "all_passed")


IDENTITY = SPOT.replace("SELECT check_id, row_label AS matched_row", ", o AS (SELECT check_id, row_label AS matched_row") + """), t AS (SELECT row_idx, count(*) AS nw FROM ca WHERE n_obs < 60 GROUP BY row_idx),
g AS (SELECT CAST(check_id // 1000 AS INTEGER) AS row_idx, count(*) AS n_checks, count(*) FILTER (passed) AS n_passed FROM o GROUP BY 1)
SELECT row_idx, n_checks, n_passed, coalesce(nw, 0) AS n_warnings, n_passed = n_checks AND coalesce(nw, 0) = 0 AS all_passed FROM g LEFT JOIN t USING (row_idx)"""


def rerun_compare(spark, sf):
    """Customer totals from two passes that differ: the second rounds to tens and has lost every open order."""
    o = cellsets.table(spark, sf, "orders")
    a = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    b = o.filter("o_orderstatus <> 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("o_totalprice", -1)).alias("total"))
    d = validate.compare_runs(a, b, ["o_custkey"], rtol=1e-6, atol=1e-6)
    return d.groupBy(F.concat_ws(",", "mismatches").alias("mismatch")).agg(F.count(F.lit(1)).alias("n_rows"))


RERUN = """WITH a AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1),
b AS (SELECT o_custkey, count(*) AS n, sum(round(o_totalprice, -1)) AS t FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT CASE WHEN a.n IS NULL THEN 'missing in first' WHEN b.n IS NULL THEN 'missing in second' ELSE
 array_to_string(list_filter([CASE WHEN a.n <> b.n THEN 'n' END, CASE WHEN abs(a.t - b.t) > 1e-6 + 1e-6 * abs(b.t) THEN 'total' END], lambda x: x IS NOT NULL), ',') END AS mismatch, count(*) AS n_rows
FROM a FULL OUTER JOIN b USING (o_custkey) GROUP BY 1"""


def ks_uniform(spark, sf):
    out = validate.ks_uniform(cellsets.event_pvalues(spark, sf), ["calibration_id"])
    return out.select("calibration_id", "n", F.round("ks_statistic", 9).alias("ks_statistic"), F.round("ks_pvalue", 6).alias("ks_pvalue"))


_PV = s.cte("pv", f"SELECT event_type AS calibration_id, user_id, {s.uniform(chr(39) + 'p|' + chr(39) + ' || CAST(event_id AS VARCHAR) || ' + chr(39) + '|' + chr(39) + ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)')} AS p FROM events")
_KS = """, r AS (SELECT calibration_id, p, row_number() OVER (PARTITION BY calibration_id ORDER BY p) AS i, count(*) OVER (PARTITION BY calibration_id) AS n FROM pv),
d AS (SELECT calibration_id, any_value(n) AS n, max(greatest(i / n - p, p - (i - 1) / n)) AS d FROM r GROUP BY 1),
k AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS lam FROM d),
kp AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda j: power(-1.0, j - 1) * exp(-2.0 * j * j * lam * lam))))) END AS ksp FROM k)
"""
KS = s.with_(_PV) + _KS + "SELECT calibration_id, n, round(d, 9) AS ks_statistic, round(ksp, 6) AS ks_pvalue FROM kp"


def rejection_rate(spark, sf):
    out = validate.rejection_rate(cellsets.event_pvalues(spark, sf), ["calibration_id"])
    return out.select("calibration_id", "n", F.round("rejection_rate", 9).alias("rejection_rate"), F.round("rate_se", 9).alias("rate_se"), "rate_calibrated")


REJECT = s.with_(_PV) + """
SELECT calibration_id, count(*) AS n, round(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END), 9) AS rejection_rate, round(sqrt(0.05 * 0.95 / count(*)), 9) AS rate_se,
 abs(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) - 0.05) < 3 * sqrt(0.05 * 0.95 / count(*)) AS rate_calibrated FROM pv GROUP BY 1"""


def power_curve(spark, sf):
    """Power by strength, where the strength of a user's p-values is the last digit of the user number over ten."""
    p = cellsets.event_pvalues(spark, sf).withColumn("strength", (F.col("user_id") % 10) / 10.0)
    p = p.withColumn("p", F.pow("p", 1.0 + 20 * F.col("strength")))
    curve, adequate = validate.power_curve(p, ["calibration_id"])
    out = curve.join(adequate, "calibration_id")
    return out.select("calibration_id", F.round("strength", 2).alias("strength"), "n_successful", F.round("power", 9).alias("power"), F.round("power_se", 9).alias("power_se"), "power_adequate")


POWER = s.with_(_PV) + """, q AS (SELECT calibration_id, (user_id % 10) / 10.0::DOUBLE AS st, power(p, 1.0 + 20 * ((user_id % 10) / 10.0::DOUBLE)) AS p FROM pv),
c AS (SELECT calibration_id, st, count(*) AS n, avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) AS pw FROM q GROUP BY 1, 2),
a AS (SELECT calibration_id, arg_min(pw, (abs(st - 0.3), st)) > 0.5 AS ok FROM c GROUP BY 1)
SELECT calibration_id, round(st, 2) AS strength, n AS n_successful, round(pw, 9) AS power, round(sqrt(pw * (1 - pw) / n), 9) AS power_se, ok AS power_adequate FROM c JOIN a USING (calibration_id)"""


def calibration_report(spark, sf):
    out = validate.calibration_report(cellsets.event_pvalues(spark, sf), ["calibration_id"], 200)
    return out.select("calibration_id", "n", F.round("ks_statistic", 9).alias("ks_statistic"), "rate_calibrated", "null_passed")


CALIBRATION = s.with_(_PV) + _KS + """, rr AS (SELECT calibration_id, abs(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) - 0.05) < 3 * sqrt(0.05 * 0.95 / count(*)) AS ok FROM pv GROUP BY 1)
SELECT calibration_id, n, round(d, 9) AS ks_statistic, ok AS rate_calibrated, n >= 100 AND ksp > 0.01 AND ok AS null_passed FROM kp JOIN rr USING (calibration_id)"""


def robust_seeds(spark, sf):
    """Spread of the rank-test p-value over three seeds."""
    from crossfactor.operators import presets, ranktest

    c = cellsets.order_value_cells(spark, sf)
    t = fitops.fit(c, FIXED, unique=True)
    runs = None
    for seed in (42, 123, 456):
        p = ranktest.p_values(t.summary, ranktest.null_distribution(c, t, 10, seed, FIXED)).withColumn("seed", F.lit(seed))
        runs = p if runs is None else runs.unionByName(p)
    return presets.seed_robustness(runs).select("matrix_id", "n_seeds", F.round("p_mean", 8).alias("p_mean"), F.round("p_std", 8).alias("p_std"), "robust")


_SEEDED = [
    x for i, seed in enumerate((42, 123, 456))
    for x in (
        s.pseudo("ca", ["matrix_id"], 10, seed, name=f"ps{i}"), s.als(f"ps{i}", ["matrix_id", "replicate"], 2, 6, p=f"b{i}"),
        s.lambdas(["matrix_id", "replicate"], p=f"b{i}"),
        s.cte(f"p{i}", f"SELECT matrix_id, (count(*) FILTER (b{i}_lam.lambda_stat >= f_lam.lambda_stat) + 1.0) / (count(*) + 1.0) AS p FROM b{i}_lam JOIN f_lam USING (matrix_id) GROUP BY matrix_id"),
    )
]
SEEDS = s.with_(s.CA, s.als("ca", ["matrix_id"], 2, 6), s.lambdas(["matrix_id"]), *_SEEDED) + """
SELECT matrix_id, count(*) AS n_seeds, round(avg(p), 8) AS p_mean, round(stddev_pop(p), 8) AS p_std, stddev_pop(p) < 0.05 AS robust
FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY matrix_id"""


# ----------------------------------------------------------------- covariance
def _numbered(spark, sf):
    return cellsets.priority_cells(spark, sf).withColumn("seq", F.col("row_idx").cast("long") * 1000 + F.col("col_idx"))


def _ar1(c):
    """Correlation 0.5^|difference of columns| inside each matrix row, as a covariance keyed by ``seq``."""
    a = c.select("matrix_id", "row_idx", F.col("seq").alias("i"), F.col("col_idx").alias("ci"), F.col("total_err").alias("ei"))
    b = c.select("matrix_id", "row_idx", F.col("seq").alias("j"), F.col("col_idx").alias("cj"), F.col("total_err").alias("ej"))
    rho = F.pow(F.lit(0.5), F.abs(F.col("ci") - F.col("cj")))
    return a.join(b, ["matrix_id", "row_idx"]).select("matrix_id", "i", "j", (rho * F.col("ei") * F.col("ej")).alias("c"))


_AR1 = s.cte("ar", "SELECT matrix_id, a.row_idx * 1000 + a.col_idx AS i, b.row_idx * 1000 + b.col_idx AS j, power(0.5, abs(a.col_idx - b.col_idx)) AS rho, a.total_err AS ei, b.total_err AS ej FROM cc a JOIN cc b USING (matrix_id, row_idx)")


def corr_parse(spark, sf):
    """A correlation block per matrix row, flattened row by row and read back."""
    c = _numbered(spark, sf)
    a = c.select("matrix_id", "row_idx", F.col("col_idx").alias("ci"))
    b = c.select("matrix_id", "row_idx", F.col("col_idx").alias("cj"))
    flat = a.join(b, ["matrix_id", "row_idx"]).select("matrix_id", "row_idx", (F.col("ci") * 7 + F.col("cj")).alias("pos"), F.pow(F.lit(0.5), F.abs(F.col("ci") - F.col("cj"))).alias("value"))
    return cov.from_flat(flat, ["matrix_id", "row_idx"])


CORR_PARSE = s.with_(s.CC) + """, n AS (SELECT matrix_id, row_idx FROM cc GROUP BY 1, 2)
SELECT a.matrix_id, a.row_idx, CAST((a.col_idx * 7 + b.col_idx) // k AS BIGINT) AS i, CAST((a.col_idx * 7 + b.col_idx) % k AS BIGINT) AS j, power(0.5, abs(a.col_idx - b.col_idx)) AS c
FROM cc a JOIN cc b USING (matrix_id, row_idx) JOIN (SELECT matrix_id, row_idx, count(*) AS k FROM cc GROUP BY 1, 2) USING (matrix_id, row_idx)"""


def cov_to_corr(spark, sf):
    out = cov.to_correlation(_ar1(_numbered(spark, sf)))
    return out.select("matrix_id", "i", "j", F.round(F.log("std_i"), 8).alias("log_std_i"), F.round("rho", 9).alias("rho"))


COV_CORR = s.with_(s.CC, _AR1) + "SELECT matrix_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(ln(ei), 8) AS log_std_i, round(rho, 9) AS rho FROM ar"


def gls_chi2(spark, sf):
    """Rank-one residuals under row-wise correlated errors: r' P r with P inverted from the covariance table."""
    c = _numbered(spark, sf)
    t = fitops.fit(c, FIXED, unique=True)
    res = fitops.predict(c, t, 1).select("matrix_id", "seq", (F.col("value") - F.col("pred1")).alias("r"))
    return cov.full_chi2(res, cov.precision(_ar1(c))).select("matrix_id", F.round("chi2", 4).alias("chi2"))


GLS = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6, 1)) + """, z AS (SELECT matrix_id, row_idx, col_idx, r * sqrt(wc) AS z FROM f_r1),
w AS (SELECT matrix_id, z, lag(z) OVER p AS zp, power(0.5, col_idx - lag(col_idx) OVER p) AS g FROM z WINDOW p AS (PARTITION BY matrix_id, row_idx ORDER BY col_idx))
SELECT matrix_id, round(sum(CASE WHEN zp IS NULL THEN z * z ELSE (z - g * zp) * (z - g * zp) / (1 - g * g) END), 4) AS chi2 FROM w GROUP BY matrix_id"""


def gls_fit(spark, sf):
    """Full-covariance fit of both ranks with a diagonal covariance, which must equal the weighted fit."""
    c = _numbered(spark, sf)
    diag = c.select("matrix_id", F.col("seq").alias("i"), F.col("seq").alias("j"), (F.col("total_err") * F.col("total_err")).alias("c"))
    out = cov.gls_fit(c, cov.precision(diag), FitOptions(max_iter=6, tol=0.0))
    return out.select("matrix_id", "n_obs", "n_rows", "n_cols", F.round("chi2_rank1", 4).alias("chi2_rank1"), F.round("chi2_rank2", 3).alias("chi2_rank2"))


GLS_FIT = s.with_(s.CC, s.als("cc", ["matrix_id"], 0, 6), s.lambdas(["matrix_id"])) + """
SELECT matrix_id, n_obs, n_rows, n_cols, round(chi2_rank1, 4) AS chi2_rank1, round(chi2_rank2, 3) AS chi2_rank2 FROM f_lam"""


def correlated_noise(spark, sf):
    c = _numbered(spark, sf)
    noise = cov.correlated_noise(cov.lower_factor(_ar1(c)), 3)
    return noise.groupBy("matrix_id", "replicate").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("noise") / 1000), 5).alias("total_thousands"))


_CN = "'42|' || matrix_id || '|' || CAST(replicate AS VARCHAR) || '|' || CAST(j AS VARCHAR) || '|corr'"
CORR_NOISE = s.with_(s.CC) + f""", o AS (SELECT matrix_id, row_idx, col_idx, row_idx * 1000 + col_idx AS j, total_err, lag(col_idx) OVER (PARTITION BY matrix_id, row_idx ORDER BY col_idx) AS pc FROM cc),
z AS (SELECT o.*, replicate, ({s.normal(_CN)}) * CASE WHEN pc IS NULL THEN 1.0 ELSE sqrt(1 - power(0.5, 2 * (col_idx - pc))) END AS z FROM o, (SELECT unnest(range(3)) AS replicate))
SELECT matrix_id, CAST(replicate AS BIGINT) AS replicate, count(DISTINCT o.j) AS n, round(sum(power(0.5, o.col_idx - z.col_idx) * o.total_err * z.z / 1000), 5) AS total_thousands
FROM o JOIN z USING (matrix_id, row_idx) WHERE z.col_idx <= o.col_idx GROUP BY matrix_id, replicate"""


def singular_values(spark, sf):
    """Two largest singular values of the weighted matrices; the second engine iterates."""
    sv = spectrum.singular_values(cellsets.priority_cells(spark, sf), 7)
    top = sv.filter(F.col("k") == 1).select("matrix_id", F.round("s", 4).alias("s1"))
    tot = sv.groupBy("matrix_id").agg(F.round(F.sqrt(F.sum(F.col("s") * F.col("s"))), 5).alias("frobenius"))
    ex = spectrum.explained_ratio(sv, 1).select("matrix_id", F.round("explained", 6).alias("explained"))
    return top.join(tot, "matrix_id").join(ex, "matrix_id")


def _power_sql(rounds: int) -> list[str]:
    out = [s.cte("x", "SELECT matrix_id, row_idx, col_idx, value / total_err AS x FROM cc"), s.cte("v0", "SELECT DISTINCT matrix_id, col_idx, 1.0 AS v FROM cc")]
    for i in range(1, rounds + 1):
        out.append(s.cte(f"u{i}", f"SELECT matrix_id, row_idx, sum(x * v) AS u FROM x JOIN v{i - 1} USING (matrix_id, col_idx) GROUP BY 1, 2"))
        out.append(s.cte(f"v{i}", f"SELECT matrix_id, col_idx, t / sqrt(sum(t * t) OVER (PARTITION BY matrix_id)) AS v, sqrt(sum(t * t) OVER (PARTITION BY matrix_id)) AS n FROM (SELECT matrix_id, col_idx, sum(x * u) AS t FROM x JOIN u{i} USING (matrix_id, row_idx) GROUP BY 1, 2)"))
    return out


SINGULAR = s.with_(s.CC, _power_sql(24)) + """, a AS (SELECT matrix_id, sqrt(max(n)) AS s1 FROM v24 GROUP BY 1), b AS (SELECT matrix_id, sum(x * x) AS f FROM x GROUP BY 1)
SELECT matrix_id, round(s1, 4) AS s1, round(sqrt(f), 5) AS frobenius, round(s1 * s1 / f, 6) AS explained FROM a JOIN b USING (matrix_id)"""


# ------------------------------------------------------------ tail functions
def chi2_tail(spark, sf):
    """Chi-square tail of every event value with 2, 4 or 6 degrees of freedom, which have closed forms."""
    ev = cellsets.table(spark, sf, "events")
    nd = 2 + 2 * (F.col("user_id") % 3)
    return ev.select("event_id", F.round(chi2_pvalue(F.col("value"), nd.cast("int")), 9).alias("p"))


CHI2 = """WITH e AS (SELECT event_id, value / 2 AS h, user_id % 3 AS m FROM events)
SELECT event_id, round(CASE WHEN h <= 0 THEN 1.0 ELSE exp(-h) * (1 + CASE WHEN m >= 1 THEN h ELSE 0 END + CASE WHEN m >= 2 THEN h * h / 2 ELSE 0 END) END, 9) AS p FROM e"""


def clopper_pearson(spark, sf):
    """Interval of the share of finished orders per nation."""
    o = cellsets.table(spark, sf, "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    c = cellsets.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    g = per.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    ci, post = cp_udf("k", "n", F.lit(0.05)), posterior_interval("k", "n", F.lit(0.05))
    return g.withColumn("ci", ci).withColumn("post", post).select(
        "c_nationkey", "k", "n", F.round("ci.lower", 7).alias("lower"), F.round("ci.upper", 7).alias("upper"),
        F.round("post.lower", 7).alias("post_lower"), F.round("post.upper", 7).alias("post_upper"),
    )


def _bisect() -> str:
    """Beta quantiles as roots of binomial tails: I_p(a, b) = P(X >= a) for X binomial with a + b - 1 trials."""
    tail = "list_sum(list_transform(range(a, a + b), lambda i: exp(lgamma(a + b) - lgamma(i + 1) - lgamma(a + b - i) + i * ln((lo + hi) / 2) + (a + b - 1 - i) * ln(1 - (lo + hi) / 2))))"
    return f"""WITH RECURSIVE g AS (SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
t AS (SELECT c_nationkey, 'lower' AS w, k AS a, n - k + 1 AS b, 0.025 AS q FROM g UNION ALL SELECT c_nationkey, 'upper', k + 1, n - k, 0.975 FROM g
 UNION ALL SELECT c_nationkey, 'post_lower', k + 1, n - k + 1, 0.025 FROM g UNION ALL SELECT c_nationkey, 'post_upper', k + 1, n - k + 1, 0.975 FROM g),
r AS (SELECT c_nationkey, w, a, b, CAST(q AS DOUBLE) AS q, CAST(0.0 AS DOUBLE) AS lo, CAST(1.0 AS DOUBLE) AS hi, 0 AS it FROM t
 UNION ALL SELECT c_nationkey, w, a, b, q, CASE WHEN {tail} < q THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {tail} < q THEN hi ELSE (lo + hi) / 2 END, it + 1 FROM r WHERE it < 45)
SELECT c_nationkey, any_value(k) AS k, any_value(n) AS n, """ + ", ".join(
        f"round(max((lo + hi) / 2) FILTER (w = '{w}'), 7) AS {w}" for w in ("lower", "upper", "post_lower", "post_upper")
    ) + " FROM r JOIN g USING (c_nationkey) WHERE it = 45 GROUP BY c_nationkey"


ENTRIES = {
    "mode_cosine_pairs": (mode_cosine_pairs, COSINE),
    "spearman_pairs": (spearman_pairs, SPEARMAN),
    "vector_cosines": (vector_cosines, VECTOR),
    "compare_direct": (compare_direct, DIRECT),
    "replication_report": (replication_report, REPORT),
    "compare_interpolated": (compare_interpolated, INTERPOLATED),
    "spot_checks": (spot_checks, SPOT),
    "identity_report": (identity_report, IDENTITY),
    "rerun_compare": (rerun_compare, RERUN),
    "ks_uniform": (ks_uniform, KS),
    "rejection_rate": (rejection_rate, REJECT),
    "power_curve": (power_curve, POWER),
    "calibration_report": (calibration_report, CALIBRATION),
    "robust_seeds": (robust_seeds, SEEDS),
    "corr_parse": (corr_parse, CORR_PARSE),
    "cov_to_corr": (cov_to_corr, COV_CORR),
    "gls_chi2": (gls_chi2, GLS),
    "gls_fit": (gls_fit, GLS_FIT),
    "correlated_noise": (correlated_noise, CORR_NOISE),
    "singular_values": (singular_values, SINGULAR),
    "chi2_tail": (chi2_tail, CHI2),
    "clopper_pearson": (clopper_pearson, _bisect()),
}
