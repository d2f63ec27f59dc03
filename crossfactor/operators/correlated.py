"""Fits, pseudo-data and the rank test for observations with correlated errors.

A covariance is long, ``(matrix_id, i, j, c)`` with i and j the ``seq`` of two observations. It is split into the connected
blocks of its graph, and only a block has to fit one task: each observation carries its row of the inverse Cholesky factor
of its block (``wrow``), so whitening is a product inside a block and no inverse of a whole covariance is ever formed.
Observations that are not in a fit leave the covariance before it is factored, so what is used is their marginal covariance.

Small matrices are solved in groups, all replicates of a block of replicates together. Matrices of any size go through
joins: a half-step of the alternation solves its normal equations by conjugate gradients.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from crossfactor.functions.noise import hashed_normal
from crossfactor.operators.cells import usable
from crossfactor.operators.fit import (
    FitOptions, FitTables, _ARRAYS, _block_schema, _canonical, _explode_factors, merge, summarise,
)
from crossfactor.session import cut, keep

#: Entries of one block of a covariance, and of one whitened design of the grouped form, that a task may hold.
BLOCK_ENTRIES, GROUPED_ENTRIES = 4_000_000, 1_000_000


# --------------------------------------------------------------------- blocks
def connected(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(matrix_id, seq, block)``: the least ``seq`` that each node reaches through ``edges(matrix_id, i, j)``.

    Each round every node takes the least label among its own, its neighbours' and its label's label, and is stored; a
    path of n nodes takes about log n rounds. No component has to fit one task.
    """
    both = edges.filter("i <> j").select("matrix_id", "i", "j")
    both = cut(both.unionByName(both.select("matrix_id", F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    label = cut(nodes.select("matrix_id", "seq", F.col("seq").alias("block")))
    for _ in range(max_rounds):
        near = both.join(label.select("matrix_id", F.col("seq").alias("j"), F.col("block").alias("b")), ["matrix_id", "j"])
        # a node offers its best label to itself and to the node that its label names
        low = near.groupBy("matrix_id", F.col("i").alias("seq")).agg(F.min("b").alias("b"))
        offer = label.join(low, ["matrix_id", "seq"], "left").select("matrix_id", "seq", "block", F.least("block", F.coalesce("b", "block")).alias("m"))
        offer = keep(offer)
        hooked = offer.filter("m < block").groupBy("matrix_id", F.col("block").alias("seq")).agg(F.min("m").alias("h"))
        new = offer.join(hooked, ["matrix_id", "seq"], "left").select("matrix_id", "seq", "block", F.least("m", F.coalesce("h", "m")).alias("m"))
        up = new.select("matrix_id", F.col("seq").alias("m"), F.col("m").alias("mm"))
        new = cut(new.join(up, ["matrix_id", "m"]).select("matrix_id", "seq", F.least("m", "mm").alias("block"), (F.least("m", "mm") < F.col("block")).alias("moved")))
        offer.unpersist()
        label = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return label
    raise RuntimeError(f"blocks of a covariance: no fixed point in {max_rounds} rounds")


def whitening(obs: DataFrame, cov: DataFrame, block_entries: int = BLOCK_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """``(matrix_id, seq, block, wrow)`` of the observations, and ``(matrix_id, problem)`` of the matrices without one.

    ``wrow`` is the observation's row of the inverse lower Cholesky factor, over the block's members in order of ``seq``.
    A covariance that is not positive definite, lacks a variance, or has a block above ``block_entries`` puts its own
    matrix on the list of problems and leaves the others alone.
    """
    nodes = keep(obs.select("matrix_id", "seq").distinct())
    side = lambda k: nodes.select("matrix_id", F.col("seq").alias(k))
    entries = cov.select("matrix_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("c").cast("double").alias("c"))
    entries = cut(entries.filter("c <> 0 OR i = j").join(side("i"), ["matrix_id", "i"]).join(side("j"), ["matrix_id", "j"]))
    label = connected(nodes, entries)
    entries = entries.join(label.withColumnRenamed("seq", "i"), ["matrix_id", "i"])
    size = cut(label.groupBy("matrix_id", "block").agg(F.count(F.lit(1)).alias("m")))
    wide = size.filter(F.col("m") * F.col("m") > block_entries)
    groups = max(64, nodes.sparkSession.sparkContext.defaultParallelism * 8)

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (mid, block), part in pdf.groupby(["matrix_id", "block"], sort=False):
            n = int(part["m"].iloc[0])
            ids = np.unique(part["i"].to_numpy())
            m = np.zeros((len(ids), len(ids)))
            m[np.searchsorted(ids, part["i"]), np.searchsorted(ids, part["j"])] = part["c"]
            try:
                if len(ids) < n or not np.allclose(m, m.T, rtol=1e-9, atol=0):
                    raise np.linalg.LinAlgError
                rows = np.linalg.inv(np.linalg.cholesky(m))
                out += [(mid, int(s), int(block), r.tolist(), True) for s, r in zip(ids, rows)]
            except np.linalg.LinAlgError:
                out.append((mid, int(block), int(block), None, False))
        return pd.DataFrame(out, columns=["matrix_id", "seq", "block", "wrow", "ok"])

    schema = f"matrix_id {nodes.schema['matrix_id'].dataType.simpleString()}, seq long, block long, wrow array<double>, ok boolean"
    spread = entries.join(size.filter(F.col("m") * F.col("m") <= block_entries), ["matrix_id", "block"])
    spread = spread.withColumn("_g", F.pmod(F.xxhash64("matrix_id", "block"), F.lit(groups)))
    rows = cut(spread.groupBy("_g").applyInPandas(factor, schema))
    bare = nodes.join(entries.filter("i = j").select("matrix_id", F.col("i").alias("seq")), ["matrix_id", "seq"], "left_anti")
    problems = rows.filter("NOT ok").select("matrix_id", F.lit("a block of the covariance is not positive definite").alias("problem"))
    problems = problems.unionByName(bare.select("matrix_id", F.lit("an observation has no variance").alias("problem")))
    problems = problems.unionByName(wide.select("matrix_id", F.format_string("a block of the covariance has %d observations", "m").alias("problem")))
    problems = cut(problems.groupBy("matrix_id").agg(F.min("problem").alias("problem")))
    nodes.unpersist()
    return rows.filter("ok").drop("ok").join(problems, "matrix_id", "left_anti"), problems


# --------------------------------------------------------------- grouped form
class _Matrix:
    """One matrix with a block of replicates, whitened: ``y`` is replicates x observations."""

    def __init__(self, key: tuple, part: pd.DataFrame):
        part = part.sort_values(["block", "seq"], kind="stable")
        self.key, self.rep0 = key, int(part["rep0"].iloc[0])
        self.rows, self.r = np.unique(part["row_idx"].to_numpy(), return_inverse=True)
        self.cols, self.c = np.unique(part["col_idx"].to_numpy(), return_inverse=True)
        n = len(part)
        self.w = np.zeros((n, n))
        at = 0
        for size in np.diff(np.r_[0, np.flatnonzero(np.diff(part["block"])) + 1, n]).tolist():
            self.w[at : at + size, at : at + size] = np.stack(part["wrow"].iloc[at : at + size].to_numpy())
            at += size
        noise = np.stack(part["zs"].to_numpy()).T.astype(float)
        self.y = self.w @ part["base"].to_numpy(float) + noise
        self.start = part[["s1", "s2"]].to_numpy(float)[np.unique(self.c, return_index=True)[1]] if "s1" in part else None

    def half(self, known: np.ndarray, k: np.ndarray, g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Factors of one side given those of the other, for all replicates, and the whitened residuals."""
        rank, n = known.shape[2], len(k)
        a = np.zeros((len(known), n, size, rank))
        a[:, np.arange(n), g] = known[:, k]
        a = (self.w @ a.reshape(len(known), n, -1)).reshape(len(known), n, size * rank)
        at = np.swapaxes(a, 1, 2)
        normal, right = at @ a, at @ self.live[..., None]
        scale = np.trace(normal, axis1=1, axis2=2)[:, None, None] / normal.shape[1]
        try:
            x = np.linalg.solve(normal, right)
        except np.linalg.LinAlgError:  # a side that the observations leave open
            x = np.linalg.solve(normal + 1e-12 * scale * np.eye(normal.shape[1]), right)
        return x.reshape(len(known), size, rank), self.live - (a @ x)[..., 0]

    def alternate(self, v: np.ndarray, opt: FitOptions):
        reps, rank = len(self.y), v.shape[2]
        u_all, v_all = np.zeros((reps, len(self.rows), rank)), v.copy()
        cost_all, n_iter, done = np.zeros(reps), np.zeros(reps, int), np.zeros(reps, bool)
        open_, prev, self.live = np.arange(reps), np.full(reps, np.inf), self.y
        for it in range(1, opt.max_iter + 1):
            u, _ = self.half(v, self.c, self.r, len(self.rows))
            v, res = self.half(u, self.r, self.c, len(self.cols))
            cost = (res * res).sum(axis=1)
            look = it % opt.check_every == 0 or it == opt.max_iter
            settled = look & (np.abs(prev - cost) < opt.tol * np.maximum(1.0, cost))
            leave = settled | (it == opt.max_iter)
            prev = cost
            if leave.any():
                gone, stay = open_[leave], ~leave
                u_all[gone], v_all[gone], cost_all[gone], n_iter[gone], done[gone] = u[leave], v[leave], cost[leave], it, settled[leave]
                open_, v, prev, self.live = open_[stay], v[stay], prev[stay], self.live[stay]
                if not len(open_):
                    break
        return u_all, v_all, cost_all, n_iter, done

    def fit(self, keys: list[str], opt: FitOptions, factors: bool) -> pd.DataFrame:
        reps = len(self.y)
        out = {k: [x] * reps for k, x in zip(keys, self.key)}
        out |= {"replicate": self.rep0 + np.arange(reps), "n_obs": len(self.r), "n_rows": len(self.rows), "n_cols": len(self.cols)}
        x = np.ones((reps, len(self.cols), 1)) if self.start is None else np.repeat(self.start[None, :, :1], reps, axis=0)
        for rank in range(1, opt.rank + 1):
            if rank == 2:
                second = np.sin(1.0 + self.cols) if self.start is None else self.start[:, 1]
                x = np.concatenate([x, np.repeat(second[None, :, None], reps, axis=0)], axis=2)
            u, x, cost, n_iter, done = self.alternate(x, opt)
            out[f"chi2_rank{rank}"], out[f"n_iter_rank{rank}"], out[f"converged_rank{rank}"] = cost, n_iter, done
            if rank == 1:
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                norm[norm == 0] = 1.0
                x, u = x / norm, u * norm
            if factors:
                fu, fv = (u, x) if rank == 1 else _canonical(u, x)
                for k in range(rank):
                    out[f"u{rank}{k + 1}"], out[f"v{rank}{k + 1}"] = list(fu[..., k]), list(fv[..., k])
        if factors:
            out["row_ids"], out["col_ids"] = [self.rows.astype(np.int32)] * reps, [self.cols.astype(np.int32)] * reps
        return pd.DataFrame(out)


def _fit_grouped(cells: DataFrame, opt: FitOptions, factors: bool) -> DataFrame:
    """``cells``: ``matrix_id, rep0, seq, row_idx, col_idx, block, wrow, base, zs`` (noise in whitened units, one number a
    replicate), and ``s1, s2`` where starts are given. One task holds one matrix with one block of replicates."""
    keys = ["matrix_id"]
    schema = _block_schema(cells, keys, opt, factors)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _Matrix(key[:1], pdf).fit(keys, opt, factors)

    return cells.groupBy("matrix_id", "rep0").applyInPandas(run, schema)


# ------------------------------------------------------------ relational form
def _solve(a: DataFrame, prec: DataFrame, keys: list[str], wanted: str, inner: int, near: DataFrame | None) -> DataFrame:
    """Conjugate gradients on A'PA x = A'Py for every key at once; ``a``: ``keys, seq, wanted, k, a, value``.

    ``x`` has one row per unknown ``(wanted, k)``. Nothing is formed: a round is four joins and two sums.
    """
    at = [*keys, wanted, "k"]

    def weigh(g: DataFrame) -> DataFrame:
        right = g.select(*keys, F.col("seq").alias("j"), "g")
        return prec.join(right, ["matrix_id", "j"]).groupBy(*keys, F.col("i").alias("seq")).agg(F.sum(F.col("p") * F.col("g")).alias("h"))

    def back(h: DataFrame) -> DataFrame:
        return a.join(h, [*keys, "seq"]).groupBy(*at).agg(F.sum(F.col("a") * F.col("h")).alias("q"))

    def apply(x: DataFrame, column: str) -> DataFrame:
        g = a.join(x.select(*at, F.col(column).alias("f")), at).groupBy(*keys, "seq").agg(F.sum(F.col("a") * F.col("f")).alias("g"))
        return back(weigh(g))

    rhs = back(weigh(a.select(*keys, "seq", F.col("value").alias("g")).distinct())).withColumnRenamed("q", "b")
    if near is None:
        state = rhs.select(*at, F.lit(0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("d"))
    else:
        near = cut(rhs.join(near, at, "left").withColumn("x", F.coalesce("x", F.lit(0.0))))
        r = F.col("b") - F.col("q")
        state = near.join(apply(near, "x"), at).select(*at, "x", r.alias("r"), r.alias("d"))
    state = cut(state)
    for _ in range(inner):
        s = cut(state.join(apply(state, "d"), at))
        sums = s.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("d") * F.col("q")).alias("dq"))
        alpha = F.when(F.col("dq") > 0, F.col("rr") / F.col("dq")).otherwise(0.0)
        s = cut(s.join(sums, keys).select(*at, (F.col("x") + alpha * F.col("d")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "d", "rr"))
        beta = s.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r")).alias("r1"), F.max("rr").alias("r0"))
        beta = beta.select(*keys, F.when(F.col("r0") > 0, F.col("r1") / F.col("r0")).otherwise(0.0).alias("beta"))
        state = cut(s.join(beta, keys).select(*at, "x", "r", (F.col("r") + F.col("beta") * F.col("d")).alias("d")))
    return state.select(*at, "x")


def _fit_relational(obs: DataFrame, white: DataFrame, opt: FitOptions, inner: int = 12) -> FitTables:
    """Both ranks for matrices of any size by joins; matrices whose cost has settled leave the loop.

    ``obs``: ``matrix_id, replicate, seq, row_idx, col_idx, value``.
    """
    keys = ["matrix_id", "replicate"]
    obs = cut(obs.select(*keys, "seq", "row_idx", "col_idx", "value"))
    long = cut(
        white.select("matrix_id", "block", "seq", F.posexplode("wrow").alias("pos", "w")).filter("w <> 0")
        .join(_members(white), ["matrix_id", "block", "pos"]).select("matrix_id", F.col("seq").alias("i"), "j", "w")
    )
    other = long.select("matrix_id", "i", F.col("j").alias("k"), F.col("w").alias("w2"))
    prec = long.join(other, ["matrix_id", "i"]).groupBy("matrix_id", F.col("j").alias("i"), F.col("k").alias("j"))
    prec = cut(prec.agg(F.sum(F.col("w") * F.col("w2")).alias("p")))

    def design(cells: DataFrame, factors: DataFrame, known: str, wanted: str) -> DataFrame:
        return keep(cells.join(factors, [*keys, known]).select(*keys, "seq", wanted, "k", F.col("x").alias("a"), "value"))

    def cost(cells: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
        pred = cells.join(u.withColumnRenamed("x", "u"), [*keys, "row_idx"]).join(v.withColumnRenamed("x", "v"), [*keys, "col_idx", "k"])
        r = pred.groupBy(*keys, "seq").agg((F.first("value") - F.sum(F.col("u") * F.col("v"))).alias("r"))
        r = r.select(*keys, F.col("seq").alias("j"), "r")
        z = long.join(r, ["matrix_id", "j"]).groupBy(*keys, "i").agg(F.sum(F.col("w") * F.col("r")).alias("z"))
        return z.groupBy(*keys).agg(F.sum(F.col("z") * F.col("z")).alias("cost"))

    summary = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), F.countDistinct("row_idx").alias("n_rows"), F.countDistinct("col_idx").alias("n_cols"))
    v = obs.select(*keys, "col_idx").distinct().select(*keys, "col_idx", F.lit(0).alias("k"), F.lit(1.0).alias("x"))
    sides = []
    for rank in range(1, opt.rank + 1):
        if rank == 2:
            second = v.select(*keys, "col_idx", F.lit(1).alias("k"), F.sin(1.0 + F.col("col_idx")).alias("x"))
            v = v.unionByName(second)
        v, u, live, ends, done_u, done_v, prev = cut(v), None, obs, None, None, None, None
        for it in range(1, opt.max_iter + 1):
            a = design(live, v, "col_idx", "row_idx")
            u = _solve(a, prec, keys, "row_idx", inner, u)
            a.unpersist()
            a = design(live, u, "row_idx", "col_idx")
            v = _solve(a, prec, keys, "col_idx", inner, v)
            a.unpersist()
            if it % opt.check_every and it != opt.max_iter and (it + 1) % opt.check_every:
                continue  # the cost counts where it is looked at, and the round before
            now = cost(live, u, v)
            look = it % opt.check_every == 0 or it == opt.max_iter
            settled = F.lit(False)
            if prev is not None:
                now = now.join(prev.withColumnRenamed("cost", "before"), keys, "left")
                settled = F.coalesce(F.abs(F.col("before") - F.col("cost")) < opt.tol * F.greatest(F.lit(1.0), F.col("cost")), F.lit(False))
            now = cut(now.select(*keys, "cost", (settled if look else F.lit(False)).alias("done"), F.lit(it).cast("long").alias("n_iter")))
            prev = now.select(*keys, "cost")
            leave = now if it == opt.max_iter else now.filter("done")
            if look and (it == opt.max_iter or leave.limit(1).count()):
                gone = leave.select(*keys)
                add = lambda old, new: new if old is None else old.unionByName(new)
                ends, done_u, done_v = add(ends, leave), add(done_u, u.join(gone, keys, "left_semi")), add(done_v, v.join(gone, keys, "left_semi"))
                if it == opt.max_iter:
                    break
                live, u, v = (cut(x.join(gone, keys, "left_anti")) for x in (live, u, v))
                prev = prev.join(gone, keys, "left_anti")
                if not live.limit(1).count():
                    break
        u, v = cut(done_u), cut(done_v)
        summary = summary.join(ends.select(*keys, F.col("cost").alias(f"chi2_rank{rank}"), F.col("n_iter").alias(f"n_iter_rank{rank}"), F.col("done").alias(f"converged_rank{rank}")), keys)
        sides.append(_singular_order(u, v, keys, rank))
    rows, cols = sides[0]
    if opt.rank == 2:
        rows, cols = rows.join(sides[1][0], [*keys, "row_idx"]), cols.join(sides[1][1], [*keys, "col_idx"])
    return FitTables(cut(summarise(summary, opt)), cut(rows), cut(cols))


def _members(white: DataFrame) -> DataFrame:
    """``(matrix_id, block, pos, j)``: the place of every observation within its block, by its own factor row's length."""
    return white.groupBy("matrix_id", "block").agg(F.array_sort(F.collect_list("seq")).alias("m")).select("matrix_id", "block", F.posexplode("m").alias("pos", "j"))


def _singular_order(u: DataFrame, v: DataFrame, keys: list[str], rank: int) -> tuple[DataFrame, DataFrame]:
    """Factors from long form: columns of v orthonormal, in singular order, largest entry positive."""
    if rank == 1:
        n = v.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
        return (
            u.join(n, keys).select(*keys, "row_idx", (F.col("x") * F.col("n")).alias("u")),
            v.join(n, keys).select(*keys, "col_idx", (F.col("x") / F.col("n")).alias("v")),
        )
    wide = lambda d, idx: d.groupBy(*keys, idx).agg(*[F.sum(F.when(F.col("k") == k, F.col("x"))).alias(f"x{k + 1}") for k in (0, 1)])
    u, v = cut(wide(u, "row_idx")), cut(wide(v, "col_idx"))
    gram = lambda d, p: d.groupBy(*keys).agg(*[F.sum(F.col(f"x{a}") * F.col(f"x{b}")).alias(f"{p}{a}{b}") for a, b in ((1, 1), (1, 2), (2, 2))])
    turn = "array<double>"

    @F.pandas_udf(f"b {turn}, a {turn}")
    def rotation(g11: pd.Series, g12: pd.Series, g22: pd.Series, h11: pd.Series, h12: pd.Series, h22: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, d, e, f in zip(g11, g12, g22, h11, h12, h22):
            r = np.linalg.cholesky(np.array([[a, b], [b, c]]) + 1e-300 * np.eye(2)).T  # v = q r
            w, t = np.linalg.eigh(r @ np.array([[d, e], [e, f]]) @ r.T)
            t = t[:, np.argsort(-w)]
            out.append(((np.linalg.solve(r, t)).ravel().tolist(), (r.T @ t).ravel().tolist()))  # v b and u a
        return pd.DataFrame(out, columns=["b", "a"])

    t = gram(v, "g").join(gram(u, "h"), keys).select(*keys, rotation("g11", "g12", "g22", "h11", "h12", "h22").alias("t"))
    mix = lambda c, k: F.col("x1") * F.col(f"t.{c}")[k] + F.col("x2") * F.col(f"t.{c}")[k + 2]
    v = cut(v.join(t, keys).select(*keys, "col_idx", mix("b", 0).alias("v1"), mix("b", 1).alias("v2")))
    peak = lambda c: F.signum(F.max_by(c, F.struct(F.abs(c), -F.col("col_idx"))))
    sign = v.groupBy(*keys).agg(peak("v1").alias("s1"), peak("v2").alias("s2"))
    u = u.join(t, keys).select(*keys, "row_idx", mix("a", 0).alias("u1"), mix("a", 1).alias("u2"))
    signed = lambda d, idx, n: d.join(sign, keys).select(*keys, idx, *[(F.col(f"{n}{k}") * F.col(f"s{k}")).alias(f"{n}{k}") for k in (1, 2)])
    return signed(u, "row_idx", "u"), signed(v, "col_idx", "v")


# ------------------------------------------------------------------- dispatch
def _split(cells: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Cells of matrices whose whitened design fits one task, and of the others."""
    size = cells.groupBy("matrix_id").agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("n2"))
    big = cut(size.filter(F.col("n2") > limit).select("matrix_id"))
    if not big.limit(1).count():
        return cells, None
    return cells.join(big, "matrix_id", "left_anti"), cells.join(big, "matrix_id", "left_semi")


def _with_start(cells: DataFrame, start: DataFrame | None) -> DataFrame:
    return cells if start is None else cells.join(start.select("matrix_id", "col_idx", "s1", "s2"), ["matrix_id", "col_idx"])


def fit_correlated(
    obs: DataFrame, cov: DataFrame, opt: FitOptions = FitOptions(), start: DataFrame | None = None, grouped_entries: int = GROUPED_ENTRIES
) -> FitTables:
    """Generalised fits of both ranks: (y - u.v)' C^-1 (y - u.v) is least.

    ``obs`` needs ``matrix_id, seq, row_idx, col_idx, value``; one observation or more per cell. ``start``: ``(matrix_id,
    col_idx, s1, s2)``, used by matrices of the grouped form. Matrices without a usable covariance are in
    ``extra["problems"]`` with the reason, and in no other table. A fit that cannot be improved by more than the tolerance
    is converged; no ridge is used.
    """
    obs = obs if "total_err" not in obs.columns else usable(obs)
    obs = obs.select("matrix_id", F.col("seq").cast("long").alias("seq"), "row_idx", "col_idx", F.col("value").cast("double").alias("value"))
    obs = cut(obs)
    white, problems = whitening(obs, cov)
    white = cut(white)
    cells = obs.join(white, ["matrix_id", "seq"]).withColumn("rep0", F.lit(-1).cast("long"))
    small, large = _split(cells, grouped_entries)
    small = _with_start(small.withColumn("base", F.col("value")).withColumn("zs", F.array(F.lit(0.0))), start)
    fits = cut(_fit_grouped(small, opt, True))
    tables = FitTables(summarise(fits.drop(*_ARRAYS), opt), _explode_factors(fits, opt, "row"), _explode_factors(fits, opt, "col"))
    extra = {"problems": problems, "white": white, "obs": obs}
    if large is not None:
        ids = cut(large.select("matrix_id").distinct())
        other = _fit_relational(large.withColumn("replicate", F.col("rep0")), white.join(ids, "matrix_id", "left_semi"), opt)
        tables = merge(tables, other)
        extra["large"] = ids
    tables.extra.update(extra)
    return tables


def null_correlated(
    observed: FitTables, n: int, seed: int = 42, opt: FitOptions = FitOptions(), stream: str = "corr", grouped_entries: int = GROUPED_ENTRIES
) -> DataFrame:
    """Fits of ``n`` pseudo-tables per matrix: the rank-one fit plus noise with the covariance of the observations.

    In whitened units that noise is one standard normal an observation, a function of seed, matrix, replicate and ``seq``, so
    a draw is made where its block of replicates is solved and is never shuffled.
    """
    white, obs = observed.extra["white"], observed.extra["obs"]
    factors = observed.rows.select("matrix_id", "row_idx", "u"), observed.cols.select("matrix_id", "col_idx", "v")
    cells = obs.join(factors[0], ["matrix_id", "row_idx"]).join(factors[1], ["matrix_id", "col_idx"])
    cells = cells.select("matrix_id", "seq", "row_idx", "col_idx", (F.col("u") * F.col("v")).alias("base")).join(white, ["matrix_id", "seq"])
    small, large = _split(cut(cells), grouped_entries)
    count = small.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("_n"))
    size = F.greatest(F.lit(1), F.least(F.lit(n), F.floor(F.lit(float(opt.block_values)) / (F.col("_n") * F.col("_n"))))).cast("long")
    small = small.join(count.select("matrix_id", size.alias("_size")), "matrix_id")
    small = small.withColumn("rep0", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.col("_size"))))
    reps = F.sequence(F.col("rep0"), F.least(F.col("rep0") + F.col("_size") - 1, F.lit(n - 1).cast("long")))
    # dealt out first, so that noise is drawn next to the fit
    small = small.repartition("matrix_id", "rep0").withColumn("zs", F.transform(reps, lambda b: hashed_normal(seed, F.col("matrix_id"), b, F.col("seq"), stream)))
    out = cut(summarise(_fit_grouped(small.drop("_size"), opt, False), opt))
    if large is None:
        return out
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    many = large.select("matrix_id", "seq", "row_idx", "col_idx", "block", "base", numbers.alias("replicate"))
    # noise in the units of the values: the lower factor times the draws, solved block by block from the inverse's rows
    draws = pseudo_noise(large, n, seed, stream)
    many = many.join(draws, ["matrix_id", "replicate", "seq"]).withColumn("value", F.col("base") + F.col("noise"))
    ids = observed.extra["large"]
    other = _fit_relational(many, white.join(ids, "matrix_id", "left_semi"), opt)
    return out.unionByName(other.summary)


def pseudo_noise(white: DataFrame, n: int, seed: int = 42, stream: str = "corr") -> DataFrame:
    """``(matrix_id, replicate, seq, noise)``: noise with the covariance whose inverse factor's rows are ``wrow``."""
    groups = max(64, white.sparkSession.sparkContext.defaultParallelism * 8)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (mid, _), part in pdf.groupby(["matrix_id", "block"], sort=False):
            part = part.sort_values("seq")
            noise = np.linalg.solve(np.stack(part["wrow"].to_numpy()), np.stack(part["zs"].to_numpy()))
            out.append(pd.DataFrame({"matrix_id": mid, "replicate": np.tile(np.arange(noise.shape[1]), len(part)), "seq": np.repeat(part["seq"].to_numpy(), noise.shape[1]), "noise": noise.ravel()}))
        return pd.concat(out)

    zs = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda b: hashed_normal(seed, F.col("matrix_id"), b, F.col("seq"), stream))
    spread = white.select("matrix_id", "block", "seq", "wrow").withColumn("_g", F.pmod(F.xxhash64("matrix_id", "block"), F.lit(groups)))
    kind = white.schema["matrix_id"].dataType.simpleString()
    return spread.repartition("_g").withColumn("zs", zs).groupBy("_g").applyInPandas(draw, f"matrix_id {kind}, replicate long, seq long, noise double")
