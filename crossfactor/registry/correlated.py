"""Queries on observations with correlated errors, against SQL that whitens by hand and eliminates unknown by unknown."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfactor.operators import fit as fitops, ranktest
from crossfactor.operators.fit import FitOptions
from crossfactor.plans import cellsets
from crossfactor.registry import sqltext as s
from crossfactor.session import keep

ROUNDS, B = 3, 8
#: Fixed rounds, so that the check engine can follow.
FIXED = FitOptions(max_iter=ROUNDS, tol=0.0)
#: Columns of the matrices of order values by year.
YEARS = 7


def _numbered(spark, sf):
    return keep(cellsets.priority_cells(spark, sf).withColumn("seq", (F.col("row_idx") * 1000 + F.col("col_idx")).cast("long")))


def _row_wise(c, related):
    """Covariance of the cells of each row, correlation 0.5 to the power of their distance where ``related`` holds."""
    a = c.select("matrix_id", "row_idx", F.col("seq").alias("i"), F.col("col_idx").alias("ci"), F.col("total_err").alias("ei"))
    b = c.select("matrix_id", "row_idx", F.col("seq").alias("j"), F.col("col_idx").alias("cj"), F.col("total_err").alias("ej"))
    rho = F.when(F.col("i") == F.col("j"), 1.0).when(related, F.pow(F.lit(0.5), F.abs(F.col("ci") - F.col("cj")))).otherwise(0.0)
    return a.join(b, ["matrix_id", "row_idx"]).select("matrix_id", "i", "j", (rho * F.col("ei") * F.col("ej")).alias("c"))


def correlated_rank_test(spark, sf):
    """Both ranks, the statistic and its p-value when errors within a row are correlated from year to year."""
    c = _numbered(spark, sf)
    test = ranktest.rank_test(c, B, 42, FIXED, cov=_row_wise(c, F.lit(True)))
    return test.summary.select(
        "matrix_id", "n_obs", "ndof_rank1", "ndof_rank2", "k", "n_used", F.round("p_value", 9).alias("p_value"),
        *[F.round(x, 4).alias(x) for x in ("chi2_rank1", "chi2_rank2", "lambda_stat")],
    )


def correlated_null(spark, sf):
    """The null statistics behind that p-value, replicate by replicate."""
    c = _numbered(spark, sf)
    null = ranktest.rank_test(c, B, 42, FIXED, cov=_row_wise(c, F.lit(True))).null
    return null.select("matrix_id", "replicate", F.round("chi2_rank1", 4).alias("chi2_rank1"), F.round("lambda_stat", 4).alias("lambda_stat"))


def gls_blocks(spark, sf):
    """Blocks of all sizes in one covariance: every third row uncorrelated, every third in pairs of years, the rest whole."""
    c = _numbered(spark, sf)
    row = F.col("row_idx") % 3
    pairs = F.floor(F.col("ci") / 2) == F.floor(F.col("cj") / 2)
    t = fitops.fit(c, FIXED, cov=_row_wise(c, (row == 1) | ((row == 2) & pairs)))
    return t.summary.select("matrix_id", "n_obs", "n_rows", "n_cols", *[F.round(x, 4).alias(x) for x in ("chi2_rank1", "chi2_rank2")])


def correlated_prediction(spark, sf):
    """What the generalised rank-two fit says of every cell, in pulls of its own error."""
    c = _numbered(spark, sf)
    t = fitops.fit(c, FIXED, cov=_row_wise(c, F.lit(True)))
    p = fitops.predict(c.select("matrix_id", "row_idx", "col_idx", "value", "total_err"), t, 2)
    pull = lambda n: F.round((F.col("value") - F.col(n)) / F.col("total_err"), 5)
    return p.select("matrix_id", "row_idx", "col_idx", pull("pred1").alias("pull1"), pull("pred2").alias("pull2"))


# ------------------------------------------------------------------------- SQL
def _white(src: str, linked: str = "TRUE") -> str:
    """Cells with the two coefficients of their whitened form: ``a1`` on the own column, ``a0`` on the one before it."""
    return s.cte(
        "w",
        f"SELECT matrix_id, row_idx, col_idx, total_err, pc, CASE WHEN g IS NULL THEN 1.0 / total_err ELSE 1.0 / (total_err * sqrt(1 - g * g)) END AS a1, "
        f"CASE WHEN g IS NULL THEN 0.0 ELSE -g / (pe * sqrt(1 - g * g)) END AS a0, "
        f"CASE WHEN g IS NULL THEN value / total_err ELSE (value / total_err - g * pv / pe) / sqrt(1 - g * g) END AS z FROM ("
        f"SELECT *, CASE WHEN pc IS NOT NULL AND ({linked}) THEN power(0.5, col_idx - pc) END AS g FROM ("
        f"SELECT matrix_id, row_idx, col_idx, value, total_err, lag(col_idx) OVER p AS pc, lag(total_err) OVER p AS pe, lag(value) OVER p AS pv "
        f"FROM {src} WINDOW p AS (PARTITION BY matrix_id, row_idx ORDER BY col_idx)))",
    )


def _rounds(src: str, keys: list[str], p: str) -> list[str]:
    """Alternation on whitened cells ``src(keys, row_idx, col_idx, pc, a1, a0, z)``; leaves ``{p}1`` and ``{p}2`` with the
    whitened residual ``r``, and the last factors ``{p}{rank}u``, ``{p}{rank}v`` (columns ``x0``, and ``x1`` for rank two)."""
    k = ", ".join(keys)
    eq = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    out, v = [s.cte(f"{p}v0", f"SELECT DISTINCT {k}, col_idx, 1.0 AS x0 FROM {src}")], f"{p}v0"
    for rank in (1, 2):
        if rank == 2:
            out.append(s.cte(f"{p}w0", f"SELECT *, sin(1.0 + col_idx) AS x1 FROM {v}"))
            v = f"{p}w0"
        xs = [f"x{q}" for q in range(rank)]
        for n in range(1, ROUNDS + 1):
            t = f"{p}{rank}_{n}"
            q = ", ".join(f"a1 * a.{x} + a0 * coalesce(b.{x}, 0) AS {x}" for x in xs)
            out.append(s.cte(f"{t}q", f"SELECT src.{', src.'.join(keys)}, src.row_idx, src.col_idx, src.pc, src.a1, src.a0, src.z, {q} FROM {src} src JOIN {v} a ON {eq('src', 'a')} AND src.col_idx = a.col_idx LEFT JOIN {v} b ON {eq('src', 'b')} AND src.pc = b.col_idx"))
            if rank == 1:
                u = f"SELECT {k}, row_idx, sum(x0 * z) / sum(x0 * x0) AS x0 FROM {t}q GROUP BY {k}, row_idx"
            else:
                u = (
                    f"SELECT {k}, row_idx, (e * d - f * c) / (a * d - c * c) AS x0, (f * a - e * c) / (a * d - c * c) AS x1 FROM (SELECT {k}, row_idx, sum(x0 * x0) AS a, sum(x0 * x1) AS c, "
                    f"sum(x1 * x1) AS d, sum(x0 * z) AS e, sum(x1 * z) AS f FROM {t}q GROUP BY {k}, row_idx)"
                )
            out.append(s.cte(f"{t}u", u))
            # unknowns of the other side: rank * column + component; a cell names its own column and the one before
            parts = [f"SELECT {k}, row_idx, col_idx, z, {rank} * {c} + {i} AS n, {a} * {x} AS d FROM {src} JOIN {t}u USING ({k}, row_idx) WHERE {c} IS NOT NULL" for i, x in enumerate(xs) for c, a in (("col_idx", "a1"), ("pc", "a0"))]
            out.append(s.cte(f"{t}d", " UNION ALL ".join(parts)))
            full = f"SELECT a.*, b.n AS j FROM (SELECT DISTINCT {k}, n FROM {t}d) a JOIN (SELECT DISTINCT {k}, n FROM {t}d) b USING ({k})"
            met = f"SELECT a.{', a.'.join(keys)}, a.n, b.n AS j, sum(a.d * b.d) AS m FROM {t}d a JOIN {t}d b USING ({k}, row_idx, col_idx) GROUP BY ALL"
            right = f"SELECT {k}, n, -1 AS j, sum(d * z) AS m FROM {t}d GROUP BY {k}, n"
            out.append(s.cte(f"{t}e0", f"SELECT {k}, n, j, coalesce(m, 0) AS m FROM ({full}) LEFT JOIN ({met}) USING ({k}, n, j) UNION ALL {right}"))
            for c in range(rank * YEARS):
                e = f"{t}e{c}"
                out.append(s.cte(
                    f"{t}e{c + 1}",
                    f"SELECT e.{', e.'.join(keys)}, e.n, e.j, CASE WHEN pp.m IS NULL THEN e.m WHEN e.n = {c} THEN e.m / pp.m ELSE e.m - ip.m * pj.m / pp.m END AS m FROM {e} e "
                    f"LEFT JOIN (SELECT * FROM {e} WHERE n = {c} AND j = {c}) pp ON {eq('e', 'pp')} LEFT JOIN (SELECT * FROM {e} WHERE n = {c}) pj ON {eq('e', 'pj')} AND e.j = pj.j "
                    f"LEFT JOIN (SELECT * FROM {e} WHERE j = {c}) ip ON {eq('e', 'ip')} AND e.n = ip.n",
                ))
            v = f"{t}v"
            sums = ", ".join(f"max(m) FILTER (n % {rank} = {i}) AS {x}" for i, x in enumerate(xs))
            out.append(s.cte(v, f"SELECT {k}, n // {rank} AS col_idx, {sums} FROM {t}e{rank * YEARS} WHERE j = -1 GROUP BY {k}, n // {rank}"))
        out.append(s.cte(f"{p}{rank}u", f"SELECT * FROM {t}u"))
        out.append(s.cte(f"{p}{rank}v", f"SELECT * FROM {v}"))
        m = " + ".join(f"u.{x} * (a1 * a.{x} + a0 * coalesce(b.{x}, 0))" for x in xs)
        out.append(s.cte(f"{p}{rank}", f"SELECT src.*, {m} AS f, z - ({m}) AS r FROM {src} src JOIN {t}u u ON {eq('src', 'u')} AND src.row_idx = u.row_idx JOIN {v} a ON {eq('src', 'a')} AND src.col_idx = a.col_idx LEFT JOIN {v} b ON {eq('src', 'b')} AND src.pc = b.col_idx"))
    both = " JOIN ".join(f"(SELECT {k}, sum(r * r) AS chi2_rank{x}{extra} FROM {p}{x} GROUP BY {k})" for x, extra in ((1, ", count(*) AS n_obs, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_cols"), (2, "")))
    out.append(s.cte(f"{p}_lam", f"SELECT *, chi2_rank1 - chi2_rank2 AS lambda_stat FROM {both} USING ({k})"))
    return out


_KEY = "'42|' || matrix_id || '|' || CAST(replicate AS VARCHAR) || '|' || CAST(row_idx * 1000 + col_idx AS VARCHAR) || '|corr'"
_TEST = s.with_(
    s.CC, _white("cc"), _rounds("w", ["matrix_id"], "f"),
    s.cte("ps", f"SELECT matrix_id, replicate, row_idx, col_idx, pc, a1, a0, f + ({s.normal(_KEY)}) AS z FROM f1, (SELECT unnest(range({B})) AS replicate)"),
    _rounds("ps", ["matrix_id", "replicate"], "b"),
)
CORRELATED_TEST = _TEST + """
SELECT matrix_id, n_obs, n_obs - (n_rows + n_cols - 1) AS ndof_rank1, n_obs - 2 * (n_rows + n_cols) AS ndof_rank2, k, n_used, round((k + 1.0) / (n_used + 1.0), 9) AS p_value,
       round(chi2_rank1, 4) AS chi2_rank1, round(chi2_rank2, 4) AS chi2_rank2, round(lambda_stat, 4) AS lambda_stat
FROM f_lam JOIN (SELECT matrix_id, count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) AS k, count(*) AS n_used FROM b_lam JOIN f_lam USING (matrix_id) GROUP BY matrix_id) USING (matrix_id)"""
CORRELATED_NULL = _TEST + "SELECT matrix_id, CAST(replicate AS BIGINT) AS replicate, round(chi2_rank1, 4) AS chi2_rank1, round(lambda_stat, 4) AS lambda_stat FROM b_lam"
GLS_BLOCKS = s.with_(s.CC, _white("cc", "row_idx % 3 = 1 OR row_idx % 3 = 2 AND col_idx // 2 = pc // 2"), _rounds("w", ["matrix_id"], "f")) + """
SELECT matrix_id, n_obs, n_rows, n_cols, round(chi2_rank1, 4) AS chi2_rank1, round(chi2_rank2, 4) AS chi2_rank2 FROM f_lam"""
PREDICTION = s.with_(s.CC, _white("cc"), _rounds("w", ["matrix_id"], "f")) + """
SELECT matrix_id, row_idx, col_idx, round((value - a.x0 * b.x0) / total_err, 5) AS pull1, round((value - c.x0 * d.x0 - c.x1 * d.x1) / total_err, 5) AS pull2
FROM cc JOIN f1u a USING (matrix_id, row_idx) JOIN f1v b USING (matrix_id, col_idx) JOIN f2u c USING (matrix_id, row_idx) JOIN f2v d USING (matrix_id, col_idx)"""

ENTRIES = {
    "correlated_rank_test": (correlated_rank_test, CORRELATED_TEST),
    "correlated_null": (correlated_null, CORRELATED_NULL),
    "gls_blocks": (gls_blocks, GLS_BLOCKS),
    "correlated_prediction": (correlated_prediction, PREDICTION),
}
