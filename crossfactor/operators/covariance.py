"""Correlated errors: covariance tables, full-covariance chi-square, generalised fits, correlated pseudo-data.

A covariance is long: ``(matrix_id, i, j, c)`` with i and j the ``seq`` of two observations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from crossfactor.functions.noise import hashed_normal
from crossfactor.operators.fit import FitOptions, split_by_size
from crossfactor.session import cut, keep


# ---------------------------------------------------------------- conversions
def from_flat(flat: DataFrame, by: list[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """Row-major flat values to ``(i, j, c)``; groups whose length is not a perfect square are dropped."""
    n = flat.groupBy(*by).agg(F.count(F.lit(1)).alias("_len")).withColumn("n", F.round(F.sqrt("_len")).cast("long"))
    square = n.filter(F.col("n") * F.col("n") == F.col("_len")).drop("_len")
    return flat.join(square, by).select(
        *by, F.floor(F.col(pos) / F.col("n")).cast("long").alias("i"), F.pmod(F.col(pos), F.col("n")).cast("long").alias("j"),
        F.col(value).cast("double").alias("c"),
    )


def correlation_columns(columns: list[str]) -> str | None:
    """First column that looks like correlation values."""
    return next((c for c in columns if "corr" in c.lower() or "rho" in c.lower()), None)


def to_correlation(cov: DataFrame) -> DataFrame:
    """Standard deviations and correlations: 0 where a deviation is 0, 1 on the diagonal."""
    diag = cov.filter(F.col("i") == F.col("j")).select("matrix_id", F.col("i").alias("k"), F.sqrt("c").alias("s"))
    j = cov.join(diag.withColumnsRenamed({"k": "i", "s": "si"}), ["matrix_id", "i"]).join(
        diag.withColumnsRenamed({"k": "j", "s": "sj"}), ["matrix_id", "j"]
    )
    prod = F.col("si") * F.col("sj")
    rho = F.when(F.col("i") == F.col("j"), 1.0).when(prod > 0, F.col("c") / prod).otherwise(0.0)
    return j.select("matrix_id", "i", "j", F.col("si").alias("std_i"), F.col("sj").alias("std_j"), rho.alias("rho"))


def from_correlation(rho: DataFrame, errors: DataFrame) -> DataFrame:
    """Covariance from correlations and the errors ``(matrix_id, seq, total_err)`` of the observations."""
    e = lambda a, b: errors.select("matrix_id", F.col("seq").alias(a), F.col("total_err").alias(b))
    j = rho.join(e("i", "ei"), ["matrix_id", "i"]).join(e("j", "ej"), ["matrix_id", "j"])
    return j.select("matrix_id", "i", "j", (F.col("rho") * F.col("ei") * F.col("ej")).alias("c"))


def pick_correlation_table(tables: DataFrame, resources: DataFrame, target: str) -> DataFrame:
    """Which table of a record holds the correlations of ``target``: known names in order, then resource texts."""
    names = [
        f"Correlation {target}", f"Correlation matrix {target}", f"{target} correlation", f"{target}_correlation", "Correlation matrix",
    ]
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    named = tables.filter(rank > 0).select("record_id", "name", rank.cast("int").alias("rank"), F.lit("table").alias("kind"))
    res = resources.filter(F.contains(F.lower("description"), F.lit("correlation"))).select(
        "record_id", F.col("location").alias("name"), F.lit(len(names) + 1).alias("rank"), F.lit("resource").alias("kind")
    )
    w = Window.partitionBy("record_id").orderBy("rank", "name")
    return named.unionByName(res).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


# ------------------------------------------------------------ inverse, factor
_IJC = T.StructType(
    [
        T.StructField("matrix_id", T.StringType()), T.StructField("i", T.LongType()), T.StructField("j", T.LongType()),
        T.StructField("c", T.DoubleType()),
    ]
)


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate([pdf["i"], pdf["j"]]), return_inverse=True)
    m = np.zeros((len(ids), len(ids)))
    n = len(pdf)
    m[at[:n], at[n:]] = pdf["c"]
    return ids, m


def _long(matrix_id: str, ids: np.ndarray, m: np.ndarray) -> pd.DataFrame:
    a, b = np.nonzero(m)
    return pd.DataFrame({"matrix_id": matrix_id, "i": ids[a], "j": ids[b], "c": m[a, b]})


def _bounded(cov: DataFrame, limit: int, what: str) -> DataFrame:
    small, large, _ = split_by_size(keep(cov), limit)
    if large is not None:
        raise ValueError(f"{what} needs at most {limit} covariance entries per matrix; use blocks of observations")
    return small


def precision(cov: DataFrame, limit: int = 4_000_000) -> DataFrame:
    """Inverse of each covariance as a long table; a covariance of n observations has n^2 entries, and the size is checked."""

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = _dense(pdf)
        return _long(pdf["matrix_id"].iloc[0], ids, np.linalg.inv(m))

    return _bounded(cov, limit, "precision()").groupBy("matrix_id").applyInPandas(invert, _IJC).withColumnRenamed("c", "p")


def lower_factor(cov: DataFrame, limit: int = 4_000_000) -> DataFrame:
    """Cholesky factor of each covariance as a long table."""

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = _dense(pdf)
        return _long(pdf["matrix_id"].iloc[0], ids, np.linalg.cholesky(m))

    return _bounded(cov, limit, "lower_factor()").groupBy("matrix_id").applyInPandas(factor, _IJC).withColumnRenamed("c", "l")


# ----------------------------------------------------------------- chi-square
def full_chi2(residuals: DataFrame, prec: DataFrame) -> DataFrame:
    """r' P r per matrix from ``residuals(matrix_id, seq, r)``; the inner sum combines before the second join."""
    r = residuals.select("matrix_id", F.col("seq").alias("j"), F.col("r").alias("rj"))
    pr = prec.join(r, ["matrix_id", "j"]).groupBy("matrix_id", "i").agg(F.sum(F.col("p") * F.col("rj")).alias("pr"))
    left = residuals.select("matrix_id", F.col("seq").alias("i"), F.col("r").alias("ri"))
    return left.join(pr, ["matrix_id", "i"]).groupBy("matrix_id").agg(F.sum(F.col("ri") * F.col("pr")).alias("chi2"))


def correlated_noise(factor: DataFrame, n: int, seed: int = 42, stream: str = "corr") -> DataFrame:
    """Noise with the covariance whose lower factor is given: sum_j L_ij z_j per replicate."""
    nums = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    z = factor.select("matrix_id", "j").distinct().withColumn("replicate", nums)
    z = z.withColumn("z", hashed_normal(seed, F.col("matrix_id"), F.col("replicate"), F.col("j"), stream))
    return factor.join(z, ["matrix_id", "j"]).groupBy("matrix_id", "replicate", F.col("i").alias("seq")).agg(
        F.sum(F.col("l") * F.col("z")).alias("noise")
    )


def correlated_pseudo_data(obs: DataFrame, pred: str, factor: DataFrame, n: int, seed: int = 42) -> DataFrame:
    noise = correlated_noise(factor, n, seed)
    return obs.drop("replicate").join(noise, ["matrix_id", "seq"]).withColumn("value", F.col(pred) + F.col("noise")).drop("noise")


# ---------------------------------------------------------- generalised fit
def _cg(matvec, rhs: DataFrame, keys: list[str], idx: str, rounds: int) -> DataFrame:
    """Conjugate gradients for one symmetric positive system per key, all keys together.

    State is one row per unknown; a round costs one application of the system and two scalars per key.
    """
    state = cut(rhs.select(*keys, idx, F.lit(0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("d")))
    for _ in range(rounds):
        q = matvec(state.select(*keys, idx, F.col("d").alias("f")))
        s = cut(state.join(q, [*keys, idx]))
        a = s.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("d") * F.col("q")).alias("dq"))
        a = a.withColumn("alpha", F.when(F.col("dq") > 0, F.col("rr") / F.col("dq")).otherwise(0.0))
        s = s.join(a, keys).select(
            *keys, idx, (F.col("x") + F.col("alpha") * F.col("d")).alias("x"), (F.col("r") - F.col("alpha") * F.col("q")).alias("r"), "d", "rr"
        )
        s = keep(s)
        nb = s.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r")).alias("rr1"), F.max("rr").alias("rr0"))
        nb = nb.select(*keys, F.when(F.col("rr0") > 0, F.col("rr1") / F.col("rr0")).otherwise(0.0).alias("beta"))
        state = cut(s.join(nb, keys).select(*keys, idx, "x", "r", (F.col("r") + F.col("beta") * F.col("d")).alias("d")))
        s.unpersist()
    return state.select(*keys, idx, "x")


def gls_rank1(obs: DataFrame, prec: DataFrame, rounds: int = 5, inner: int = 10, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rank-one fit minimising (y - u.v)' P (y - u.v) by alternating generalised least squares.

    With one factor fixed the other solves a symmetric system A'PA x = A'Py. The system is never formed: it is applied
    through joins with the precision table, inside conjugate gradients, so neither observations nor unknowns have to
    fit one task. Returns row factors, column factors and chi-square. ``obs`` needs ``seq, row_idx, col_idx, value``.
    """
    keys = ["matrix_id"]
    obs = keep(obs.select("matrix_id", "seq", "row_idx", "col_idx", "value"))
    prec = keep(prec)

    def weigh(values: DataFrame) -> DataFrame:
        right = values.select("matrix_id", F.col("seq").alias("j"), "g")
        return prec.join(right, ["matrix_id", "j"]).groupBy("matrix_id", F.col("i").alias("seq")).agg(
            F.sum(F.col("p") * F.col("g")).alias("h")
        )

    def solve(fixed: DataFrame, known: str, wanted: str) -> DataFrame:
        a = keep(obs.join(fixed.select(*keys, known, F.col("x").alias("a")), [*keys, known]).select(*keys, "seq", wanted, "a", "value"))

        def back(h: DataFrame, out: str) -> DataFrame:
            return a.join(h, [*keys, "seq"]).groupBy(*keys, wanted).agg(F.sum(F.col("a") * F.col("h")).alias(out))

        def matvec(f: DataFrame) -> DataFrame:
            g = a.join(f, [*keys, wanted]).select(*keys, "seq", (F.col("a") * F.col("f")).alias("g"))
            return back(weigh(g), "q")

        rhs = back(weigh(a.select(*keys, "seq", F.col("value").alias("g"))), "b")
        out = _cg(matvec, rhs, keys, wanted, inner)
        a.unpersist()
        return out

    v = start.select(*keys, "col_idx", F.col("v").alias("x")) if start is not None else (
        obs.groupBy(*keys, "col_idx").agg(F.lit(1.0).alias("x"))
    )
    for _ in range(rounds):
        u = solve(v, "col_idx", "row_idx")
        v = solve(u, "row_idx", "col_idx")
    norm = v.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    u = cut(u.join(norm, keys).select(*keys, "row_idx", (F.col("x") * F.col("n")).alias("u")))
    v = cut(v.join(norm, keys).select(*keys, "col_idx", (F.col("x") / F.col("n")).alias("v")))
    res = obs.join(u, [*keys, "row_idx"]).join(v, [*keys, "col_idx"]).select(
        *keys, "seq", (F.col("value") - F.col("u") * F.col("v")).alias("r")
    )
    return u, v, full_chi2(res, prec)


def _gls_group(pdf: pd.DataFrame, pp: pd.DataFrame, opt: FitOptions) -> pd.DataFrame:
    """Both ranks for one bounded matrix: whitened alternating least squares."""
    pdf = pdf.sort_values("seq")
    seq = pdf["seq"].to_numpy()
    at = pd.Series(np.arange(len(seq)), index=seq)
    p = np.zeros((len(seq), len(seq)))
    ok = pp["i"].isin(seq) & pp["j"].isin(seq)
    p[at[pp["i"][ok]].to_numpy(), at[pp["j"][ok]].to_numpy()] = pp["p"][ok]
    w = np.linalg.cholesky(p).T
    rl, r = np.unique(pdf["row_idx"], return_inverse=True)
    cl, c = np.unique(pdf["col_idx"], return_inverse=True)
    y = pdf["value"].to_numpy(float)
    wy = w @ y

    def half(known: np.ndarray, k: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
        rank = known.shape[1]
        a = np.zeros((len(y), size * rank))
        for q in range(rank):
            a[np.arange(len(y)), g * rank + q] = known[k, q]
        sol = np.linalg.lstsq(w @ a, wy, rcond=None)[0]
        return sol.reshape(size, rank)

    out = {"matrix_id": [pdf["matrix_id"].iloc[0]], "n_obs": [len(y)], "n_rows": [len(rl)], "n_cols": [len(cl)]}
    v = np.ones((len(cl), 1))
    for rank in (1, 2)[: opt.rank]:
        if rank == 2:
            v = np.concatenate([v, np.sin(1.0 + cl)[:, None]], axis=1)
        prev, done = np.inf, False
        for it in range(1, opt.max_iter + 1):
            u = half(v, c, r, len(rl))
            v = half(u, r, c, len(cl))
            res = w @ (y - np.sum(u[r] * v[c], axis=1))
            cost = float(res @ res)
            if abs(prev - cost) < opt.tol * max(1.0, cost):
                done = True
                break
            prev = cost
        out |= {f"chi2_rank{rank}": [cost], f"n_iter_rank{rank}": [it], f"converged_rank{rank}": [done]}
    return pd.DataFrame(out)


def gls_fit(obs: DataFrame, prec: DataFrame, opt: FitOptions = FitOptions(), limit: int = 4_000_000) -> DataFrame:
    """Full-covariance fits of both ranks for matrices whose precision table has at most ``limit`` entries.

    Larger ones go through ``gls_rank1``, which has no bound.
    """
    small = _bounded(prec, limit, "gls_fit()")
    fields = "matrix_id string, n_obs long, n_rows long, n_cols long"
    for rank in range(1, opt.rank + 1):
        fields += f", chi2_rank{rank} double, n_iter_rank{rank} long, converged_rank{rank} boolean"
    cols = ["matrix_id", "seq", "row_idx", "col_idx", "value"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _gls_group(a, b, opt)

    return obs.select(*cols).groupBy("matrix_id").cogroup(small.groupBy("matrix_id")).applyInPandas(run, fields)
