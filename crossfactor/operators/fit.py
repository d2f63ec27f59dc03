"""Rank-one and rank-two weighted alternating least squares over many matrices at once.

Two physical forms share one contract and give the same numbers for the same options:

* grouped - many small matrices and blocks of replicates per task, each as a small dense array; for matrices whose
  rows x columns are at most ``group_max_cells``. Rounds cost no shuffle.
* relational - joins and aggregations per half-step; for matrices of any size. A round shuffles factor vectors and
  partial sums only, because the cells are kept twice, laid out by row and by column, with hot rows or columns salted.

``fit`` measures the matrices first and sends each to the form that can hold it.

A fit minimises sum w (y - u.v)^2 with w = 1/(err^2 + ridge) after dividing each matrix by its RMS value, so the ridge
means the same in every unit. Rank two starts from the rank-one fit plus the leading pair of its residual, hence never
does worse than rank one. Factors are reported in singular order with orthonormal columns and a fixed sign.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from crossfactor.functions.noise import hashed_normal
from crossfactor.operators.cells import collapse, usable
from crossfactor.schemas import key_columns
from crossfactor.session import cut, keep


@dataclass(frozen=True)
class FitOptions:
    """``tol=0`` runs exactly ``max_iter`` rounds."""

    max_iter: int = 1000
    tol: float = 1e-8
    ridge: float = 1e-8
    start_rounds: int = 20
    rank: int = 2
    ndof: str = "reference"  # or "free": do not count the four gauge directions of rank two
    group_max_cells: int = 1_000_000
    block_values: int = 100_000
    check_every: int = 5  # rounds between looks at the cost; the same for every size
    salt: int = 0  # pieces of a row or column in the relational form; 0: as many as the heaviest one needs
    relational_rows: int = 2_000_000_000  # pseudo-cells kept at once for matrices in the relational form
    accelerate: bool = False  # extrapolate between rounds of the relational form: same fixed point, fewer rounds


@dataclass
class FitTables:
    """``summary``: one row per key. ``rows`` and ``cols``: factors, one row per key and index."""

    summary: DataFrame
    rows: DataFrame
    cols: DataFrame
    extra: dict = field(default_factory=dict)

    @property
    def has_large(self) -> bool:
        """Whether some matrix was too large for one task, so that its vectors need the spread forms."""
        return "large" in self.extra


# ------------------------------------------------------------------ the kernel
# Arrays are (replicates of all matrices in the batch) x rows x columns; a missing cell has weight and value zero.
def _solve(w: np.ndarray, wy: np.ndarray, x: np.ndarray, ridge: float) -> np.ndarray:
    """Row factors that minimise the weighted squares given column factors ``x`` (replicates x columns x rank)."""
    p = wy @ x
    if x.shape[-1] == 1:
        return p / (w @ (x * x) + ridge)
    m = w @ np.stack([x[..., 0] ** 2, x[..., 0] * x[..., 1], x[..., 1] ** 2], axis=-1)
    a, c, d = m[..., 0] + ridge, m[..., 1], m[..., 2] + ridge
    det = a * d - c * c
    return np.stack([(p[..., 0] * d - p[..., 1] * c) / det, (p[..., 1] * a - p[..., 0] * c) / det], axis=-1)


def _product(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u @ np.swapaxes(v, 1, 2)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def _leading(y: np.ndarray, v: np.ndarray, rounds: int) -> np.ndarray:
    """Power iteration for the leading right vector of the zero-filled matrix."""
    v = v[..., None]
    for _ in range(rounds):
        v = _unit_rows(np.swapaxes(y, 1, 2) @ (y @ v))
    return v[..., 0]


def _alternate(w: np.ndarray, y: np.ndarray, v: np.ndarray, opt: FitOptions):
    """Alternate until the cost settles; replicates that have settled leave the batch."""
    n_rep = len(y)
    u_all, v_all = np.zeros((n_rep, y.shape[1], v.shape[-1])), v.copy()
    n_iter, done = np.zeros(n_rep, int), np.zeros(n_rep, bool)
    live, prev, wy = np.arange(n_rep), np.full(n_rep, np.inf), w * y
    for it in range(1, opt.max_iter + 1):
        u = _solve(w, wy, v, opt.ridge)
        v = _solve(np.swapaxes(w, 1, 2), np.swapaxes(wy, 1, 2), u, opt.ridge)
        res = y - _product(u, v)
        cost = np.einsum("rij,rij,rij->r", w, res, res)
        look = it % opt.check_every == 0 or it == opt.max_iter
        settled = look & (np.abs(prev - cost) < opt.tol * np.maximum(1.0, np.abs(cost)))
        leave = settled | (it == opt.max_iter)
        prev = cost
        if leave.any():
            gone, stay = live[leave], ~leave
            u_all[gone], v_all[gone], n_iter[gone], done[gone] = u[leave], v[leave], it, settled[leave]
            live, y, v, w, wy, prev = live[stay], y[stay], v[stay], w[stay], wy[stay], prev[stay]
            if not len(live):
                break
    return u_all, v_all, n_iter, done


def _canonical(u: np.ndarray, v: np.ndarray):
    """Orthonormal columns of v in singular order; the largest entry of each column positive, lowest index on ties."""
    q, r = np.linalg.qr(v)
    b, s, wt = np.linalg.svd(u @ np.swapaxes(r, 1, 2), full_matrices=False)
    nu, nv = np.zeros_like(u), np.zeros_like(v)  # a single row or column has no second component
    nu[..., : s.shape[1]] = b * s[:, None, :]
    nv[..., : s.shape[1]] = q @ np.swapaxes(wt, 1, 2)
    peak = np.take_along_axis(nv, np.argmax(np.abs(nv), axis=1)[:, None, :], axis=1)
    sign = np.where(peak < 0, -1.0, 1.0)
    return nu * sign, nv * sign


class _Item:
    """One matrix of a task with its block of replicates; rows and columns renumbered from 0."""

    def __init__(self, key: tuple, part: pd.DataFrame, starts: bool):
        part = part.sort_values(["row_idx", "col_idx"], kind="stable")
        self.key, self.rep0 = key, int(part["rep0"].iloc[0])
        self.rows, self.r = np.unique(part["row_idx"].to_numpy(), return_inverse=True)
        self.cols, self.c = np.unique(part["col_idx"].to_numpy(), return_inverse=True)
        self.shape = (len(self.rows), len(self.cols))
        self.y = np.stack(part["ys"].to_numpy()).T.astype(float)
        self.err = part["total_err"].to_numpy(float)
        self.within, self.n_obs = float(part["within_chi2"].sum()), int(part["n_dup"].sum())
        first = np.unique(self.c, return_index=True)[1]
        self.starts = [part[s].to_numpy(float)[first] for s in ("s1", "s2")] if starts else None


def _batches(items: list[_Item], room: int = 2_000_000) -> list[list[_Item]]:
    """Matrices of equal shape together, up to a number of array elements."""
    by_shape: dict[tuple, list[_Item]] = {}
    for it in items:
        by_shape.setdefault(it.shape, []).append(it)
    out = []
    for (n_rows, n_cols), group in by_shape.items():
        used = room
        for it in group:
            if used + len(it.y) * n_rows * n_cols > room:
                out.append([])
                used = 0
            out[-1].append(it)
            used += len(it.y) * n_rows * n_cols
    return out


def _fit_batch(items: list[_Item], keys: list[str], opt: FitOptions, factors: bool) -> pd.DataFrame:
    """Fit all replicates of all matrices of one shape."""
    n_rows, n_cols = items[0].shape
    size = [len(it.y) for it in items]
    y = np.zeros((sum(size), n_rows, n_cols))
    w, wc, at, scales = np.zeros_like(y), np.zeros_like(y), 0, []
    for it, k in zip(items, size):
        scale = np.sqrt(np.mean(it.y * it.y, axis=1, keepdims=True))
        scale[scale == 0] = 1.0
        e = it.err[None, :] / scale
        y[at : at + k, it.r, it.c] = it.y / scale
        w[at : at + k, it.r, it.c], wc[at : at + k, it.r, it.c] = 1.0 / (e * e + opt.ridge), 1.0 / (e * e)
        scales.append(scale)
        at += k
    scale = np.concatenate(scales)
    per_item = lambda f: np.repeat([f(it) for it in items], size, axis=0)
    out = {k: [x for it, n in zip(items, size) for x in [it.key[i]] * n] for i, k in enumerate(keys)}
    out["replicate"] = np.concatenate([it.rep0 + np.arange(n) for it, n in zip(items, size)])
    out["n_obs"], out["n_rows"], out["n_cols"] = per_item(lambda it: it.n_obs), n_rows, n_cols
    within, given = per_item(lambda it: it.within), items[0].starts is not None
    if given:
        first = _unit_rows(per_item(lambda it: it.starts[0]))
    else:
        first = _leading(y, np.ones((len(y), n_cols)), opt.start_rounds)
    x = first[..., None]
    for rank in range(1, opt.rank + 1):
        if rank == 2:
            if given:
                second, lead = per_item(lambda it: it.starts[1]), first[..., None]
            else:
                res = np.where(w > 0, y - _product(u, x), 0.0)
                second, lead = _leading(res, per_item(lambda it: np.sin(1.0 + it.cols)), opt.start_rounds), x
            x = np.concatenate([lead, _unit_rows(second)[..., None]], axis=-1)
        u, x, n_iter, done = _alternate(w, y, x, opt)
        if rank == 1:
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            norm[norm == 0] = 1.0
            x, u = x / norm, u * norm
        res = y - _product(u, x)
        out[f"chi2_rank{rank}"] = np.einsum("rij,rij,rij->r", wc, res, res) + within
        out[f"n_iter_rank{rank}"], out[f"converged_rank{rank}"] = n_iter, done
        if factors:
            fu, fv = (u, x) if rank == 1 else _canonical(u, x)
            fu = fu * scale[..., None]
            for k in range(rank):
                out[f"u{rank}{k + 1}"], out[f"v{rank}{k + 1}"] = list(fu[..., k]), list(fv[..., k])
    if factors:
        for name, ids in (("row_ids", "rows"), ("col_ids", "cols")):
            out[name] = [a for it, n in zip(items, size) for a in [getattr(it, ids).astype(np.int32)] * n]
    return pd.DataFrame(out)


def _fit_task(pdf: pd.DataFrame, keys: list[str], opt: FitOptions, factors: bool, starts: bool) -> pd.DataFrame:
    groups = pdf.groupby([*keys, "rep0"], sort=False, dropna=False)
    items = [_Item(key[:-1], part, starts) for key, part in groups]
    return pd.concat([_fit_batch(b, keys, opt, factors) for b in _batches(items)], ignore_index=True)


def _block_schema(df: DataFrame, keys: list[str], opt: FitOptions, factors: bool) -> T.StructType:
    fields = [df.schema[k] for k in keys] + [T.StructField("replicate", T.LongType())]
    fields += [T.StructField(c, T.LongType()) for c in ("n_obs", "n_rows", "n_cols")]
    arr = T.ArrayType(T.DoubleType())
    for rank in range(1, opt.rank + 1):
        fields += [
            T.StructField(f"chi2_rank{rank}", T.DoubleType()),
            T.StructField(f"n_iter_rank{rank}", T.LongType()),
            T.StructField(f"converged_rank{rank}", T.BooleanType()),
        ]
        if factors:
            for k in range(rank):
                fields += [T.StructField(f"u{rank}{k + 1}", arr), T.StructField(f"v{rank}{k + 1}", arr)]
    if factors:
        ids = T.ArrayType(T.IntegerType())
        fields += [T.StructField("row_ids", ids), T.StructField("col_ids", ids)]
    return T.StructType(fields)


def fit_blocks(
    cells: DataFrame, opt: FitOptions, factors: bool, n_values: int, values: Column | None = None, starts: bool = False
) -> DataFrame:
    """Grouped form. ``values`` gives the values of consecutive replicates as an array (default: the one observed value)
    and is evaluated after the rows have been spread; ``rep0`` is the number of the first replicate.

    Matrices and blocks are hashed into enough groups that one holds about ``block_values`` of the ``n_values`` numbers,
    so that many small matrices share a task and its vector operations.
    """
    keys = [k for k in key_columns(cells) if k != "replicate"]
    spark = cells.sparkSession
    cores = spark.sparkContext.defaultParallelism
    groups = max(2 * cores, -(-n_values // opt.block_values))
    tasks = min(groups, max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    need = [*keys, "rep0", "row_idx", "col_idx", "total_err", "n_dup", "within_chi2"]
    need += ["s1", "s2"] if starts else []
    schema = _block_schema(cells, keys, opt, factors)
    group = F.pmod(F.xxhash64(*keys, "rep0"), F.lit(groups))
    values = values if values is not None else F.array("value")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fit_task(pdf, keys, opt, factors, starts)

    # the count is explicit because these rows are few and costly: partitions must not be merged by their bytes
    spread = cells.withColumn("_group", group).repartition(tasks, "_group")
    return spread.select(*need, values.alias("ys"), "_group").groupBy("_group").applyInPandas(run, schema)


# --------------------------------------------------------------- result tables
def _ndof(opt: FitOptions) -> list[Column]:
    r, c, n = F.col("n_rows"), F.col("n_cols"), F.col("n_obs")
    out = [(n - (r + c - 1)).alias("ndof_rank1")]
    if opt.rank == 2:
        out.append((n - (2 * r + 2 * c - (4 if opt.ndof == "free" else 0))).alias("ndof_rank2"))
    return out


def summarise(fits: DataFrame, opt: FitOptions) -> DataFrame:
    """Add degrees of freedom and the test statistic."""
    out = fits.select("*", *_ndof(opt))
    if opt.rank == 2:
        out = out.withColumn("lambda_stat", F.col("chi2_rank1") - F.col("chi2_rank2"))
    return out


def _explode_factors(fits: DataFrame, opt: FitOptions, side: str) -> DataFrame:
    keys = key_columns(fits)
    letter, ids, idx = ("u", "row_ids", "row_idx") if side == "row" else ("v", "col_ids", "col_idx")
    names = [f"{letter}11"] + ([f"{letter}21", f"{letter}22"] if opt.rank == 2 else [])
    zipped = fits.select(*keys, F.explode(F.arrays_zip(ids, *names)).alias("z"))
    nice = {f"{letter}11": letter, f"{letter}21": f"{letter}1", f"{letter}22": f"{letter}2"}
    return zipped.select(*keys, F.col(f"z.{ids}").alias(idx), *[F.col(f"z.{n}").alias(nice[n]) for n in names])


_ARRAYS = ["u11", "v11", "u21", "v21", "u22", "v22", "row_ids", "col_ids"]


def tables_from_blocks(fits: DataFrame, opt: FitOptions) -> FitTables:
    summary = summarise(fits.drop(*_ARRAYS), opt)
    return FitTables(summary, _explode_factors(fits, opt, "row"), _explode_factors(fits, opt, "col"))


# ------------------------------------------------------------- relational form
def _normal_sums(vec: list[str], extra: list[Column]) -> list[Column]:
    w, y = F.col("w"), F.col("y")
    if len(vec) == 1:
        x = F.col(vec[0])
        return [F.sum(w * x * x).alias("a"), F.sum(w * x * y).alias("p"), *extra]
    x1, x2 = F.col(vec[0]), F.col(vec[1])
    return [
        F.sum(w * x1 * x1).alias("a"),
        F.sum(w * x1 * x2).alias("c"),
        F.sum(w * x2 * x2).alias("d"),
        F.sum(w * x1 * y).alias("p"),
        F.sum(w * x2 * y).alias("q"),
        *extra,
    ]


def _solution(names: list[str], ridge: float) -> list[Column]:
    a, p = F.col("a") + ridge, F.col("p")
    if len(names) == 1:
        return [(p / a).alias(names[0])]
    d, c, q = F.col("d") + ridge, F.col("c"), F.col("q")
    det = a * d - c * c
    return [((p * d - q * c) / det).alias(names[0]), ((q * a - p * c) / det).alias(names[1])]


def _cost_share(names: list[str]) -> Column:
    """Cost of one column from its normal sums: syy - 2 v.p + v'Av."""
    v1 = F.col(names[0])
    if len(names) == 1:
        return F.col("syy") - 2 * v1 * F.col("p") + v1 * v1 * F.col("a")
    v2 = F.col(names[1])
    cross = 2 * v1 * v2 * F.col("c")
    return (
        F.col("syy") - 2 * (v1 * F.col("p") + v2 * F.col("q"))
        + v1 * v1 * F.col("a") + cross + v2 * v2 * F.col("d")
    )


#: Rows of a frame up to which it is counted as small and sent to every task instead of being hashed.
SENT = 100_000


def per_key(df: DataFrame, n_keys: int, most: int | None = None) -> DataFrame:
    """A frame with a row per key, marked to be sent to every task when there are few keys: hashed by key, all rows of a
    large matrix would meet in one task."""
    return F.broadcast(df) if n_keys <= (SENT if most is None else most) else df


class _Layout:
    """The cells of large matrices, stored so that half-steps move factors only.

    Factors of a side that is counted as small (few columns, say) are sent to every task and meet the cells as they are
    stored by the other side, whose sums are then complete in their task; so are the cells stored once for such matrices.
    Cells are stored by a side, in its order, when factors of a large side have to meet them: rows (or columns) are then
    spread over as many pieces as the heaviest one needs to stay below a quarter of an even share of the cells; the factor
    side is replicated to match, and the partial sums are combined by the aggregation that follows. Where no row is that
    heavy, nothing is replicated.
    """

    def __init__(self, cells: DataFrame, keys: list[str], salt: int, like: _Layout | None = None):
        self.keys, self.cells, self.stored = keys, cells, {}
        if like is not None:  # other values in the same cells
            self.n_keys, self.count, self.salt = like.n_keys, like.count, like.salt
            return
        self.n_keys, self.count, self.salt = 0, {}, {}
        for idx in ("row_idx", "col_idx"):
            self.count[idx], pieces = self._sizes(idx)
            self.salt[idx] = salt or pieces

    def _sizes(self, idx: str) -> tuple[int, int]:
        """Factors of a side, and the pieces its heaviest one needs."""
        per = self.cells.groupBy(*self.keys, idx).agg(F.count(F.lit(1)).alias("n"))
        per = per.groupBy(*self.keys).agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("factors"))
        heaviest, total, factors, self.n_keys = per.agg(F.max("most"), F.sum("n"), F.sum("factors"), F.count(F.lit(1))).first()
        share = (total or 1) / (4 * int(self.cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return factors or 0, max(1, int(-(-(heaviest or 1) // max(1.0, share))))

    def side(self, idx: str) -> DataFrame:
        """The cells by row or by column, stored when first asked for."""
        if idx not in self.stored:
            other = "col_idx" if idx == "row_idx" else "row_idx"
            salted = self.cells.withColumn("salt", F.pmod(F.hash(other), F.lit(self.salt[idx])))
            by = [*self.keys, idx, *(["salt"] if self.salt[idx] > 1 else [])]
            self.stored[idx] = keep(salted.repartition(*by).sortWithinPartitions(*by))
        return self.stored[idx]

    def per_key(self, df: DataFrame) -> DataFrame:
        return per_key(df, self.n_keys)

    def gather(self, factors: DataFrame, known: str) -> DataFrame:
        """Every cell with the factor of its row or column (``known``)."""
        if self.count[known] <= SENT:
            other = "col_idx" if known == "row_idx" else "row_idx"
            return self.side(other).join(F.broadcast(factors), [*self.keys, known])
        if self.salt[known] == 1:
            return self.side(known).join(factors, [*self.keys, known])
        salted = factors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salt[known] - 1))))
        return self.side(known).join(salted, [*self.keys, known, "salt"])

    def half_step(self, factors: DataFrame, known: str, wanted: str, vec: list[str], extra=()) -> DataFrame:
        return self.gather(factors, known).groupBy(*self.keys, wanted).agg(*_normal_sums(vec, list(extra)))

    def apply(self, factors: DataFrame, known: str, wanted: str, vec: str, value: str, out: str) -> DataFrame:
        """Matrix times vector over the observed cells."""
        g = self.gather(factors, known)
        return g.groupBy(*self.keys, wanted).agg(F.sum(F.col(value) * F.col(vec)).alias(out))

    def release(self) -> None:
        for df in self.stored.values():
            df.unpersist()


def _unit(df: DataFrame, keys: list[str], col: str, n_keys: int) -> DataFrame:
    norm = df.groupBy(*keys).agg(F.sqrt(F.sum(F.col(col) * F.col(col))).alias("_norm"))
    scaled = F.when(F.col("_norm") > 0, F.col(col) / F.col("_norm")).otherwise(F.col(col))
    return df.join(per_key(norm, n_keys), keys).withColumn(col, scaled).drop("_norm")


def _power(layout: _Layout, cols: DataFrame, vec: str, value: str, rounds: int) -> DataFrame:
    for _ in range(rounds):
        u = layout.apply(cols.select(*layout.keys, "col_idx", vec), "col_idx", "row_idx", vec, value, "_u")
        new = layout.apply(u, "row_idx", "col_idx", "_u", value, vec)
        cols = cut(_unit(new, layout.keys, vec, layout.n_keys))
    return cols


def _extrapolated(v0: DataFrame, v1: DataFrame, v2: DataFrame, layout: _Layout, vn: list[str]) -> DataFrame:
    """Column factors ahead of three successive ones, by the squared extrapolation of fixed-point iterations (SQUAREM): with
    r = v1 - v0, s = v2 - 2 v1 + v0 and a step a = max(1, |r| / |s|) of each key, v0 + 2 a r + a^2 s. A step of one gives v2."""
    keys = layout.keys
    pick = lambda d, p: d.select(*keys, "col_idx", *[F.col(n).alias(f"{p}{n}") for n in vn])
    on = [*keys, "col_idx"]
    j = pick(v0, "_0").join(pick(v1, "_1"), on).join(pick(v2, "_2"), on)
    r = {n: F.col(f"_1{n}") - F.col(f"_0{n}") for n in vn}
    s = {n: F.col(f"_2{n}") - 2 * F.col(f"_1{n}") + F.col(f"_0{n}") for n in vn}
    square = lambda x: F.sum(sum((x[n] * x[n] for n in vn), F.lit(0.0)))
    step = j.groupBy(*keys).agg(square(r).alias("_rr"), square(s).alias("_ss"))
    a = F.when(F.col("_ss") > 0, F.greatest(F.lit(1.0), F.sqrt(F.col("_rr") / F.col("_ss")))).otherwise(1.0)
    step = step.select(*keys, a.alias("_a"))
    a = F.col("_a")
    return j.join(layout.per_key(step), keys).select(*on, *[(F.col(f"_0{n}") + 2 * a * r[n] + a * a * s[n]).alias(n) for n in vn])


def _not_worse(new: DataFrame, old: DataFrame, layout: _Layout) -> DataFrame:
    """The new column factors of the keys whose cost has not risen, the old ones of the others."""
    keys = layout.keys
    cost = lambda d, name: d.groupBy(*keys).agg(F.sum("share").alias(name))
    both = cost(old, "_c0").join(cost(new, "_c1"), keys, "left")
    fine = cut(both.select(*keys, F.coalesce((F.col("_c1") <= F.col("_c0")) & ~F.isnan("_c1"), F.lit(False)).alias("_ok")))
    good, bad = (layout.per_key(fine.filter(c).select(*keys)) for c in (F.col("_ok"), ~F.col("_ok")))
    return new.join(good, keys, "left_semi").unionByName(old.join(bad, keys, "left_semi"))


def _relational_loop(layout: _Layout, cols: DataFrame, rank: int, opt: FitOptions):
    """Rounds until every key has settled. With ``accelerate`` each two plain rounds are followed by one from factors
    extrapolated ahead of them, which a key keeps only if its cost has not risen; the stopping rule compares the two plain
    rounds, and a loop that may not finish three more ends with plain ones."""
    keys = layout.keys
    in_cycle, ahead = 0, False
    un, vn = (["u"], ["v"]) if rank == 1 else (["u1", "u2"], ["v1", "v2"])
    done_rows, done_cols, done_status = [], [], []
    for it in range(1, opt.max_iter + 1):
        # one stored frame per round: row factors follow from the column factors before it and are rebuilt on leaving
        sums = layout.half_step(cols.select(*keys, "col_idx", *vn), "col_idx", "row_idx", vn)
        rows = sums.select(*keys, "row_idx", *_solution(un, opt.ridge))
        syy = F.sum(F.col("w") * F.col("y") * F.col("y")).alias("syy")
        back = layout.half_step(rows, "row_idx", "col_idx", un, [syy])
        back = back.select("*", *_solution(vn, opt.ridge))
        before, cols = cols, cut(back.select(*keys, "col_idx", *vn, _cost_share(vn).alias("share")))
        last = it == opt.max_iter
        if opt.accelerate:
            in_cycle += 1
            if ahead:
                cols, in_cycle, ahead = cut(_not_worse(cols, plain, layout)), 0, False
                continue
            if in_cycle == 1:
                earlier = before
            if not last and in_cycle < 2:
                continue
        elif not last and (opt.tol == 0 or it % opt.check_every):
            continue
        cost = lambda df, name: df.groupBy(*keys).agg(F.sum("share").alias(name))
        new = cost(cols, "new_cost")
        if "share" in before.columns:
            new = new.join(cost(before, "cost"), keys)
        else:
            new = new.withColumn("cost", F.lit(float("inf")))
        settled = F.abs(F.col("cost") - F.col("new_cost")) < opt.tol * F.greatest(F.lit(1.0), F.abs("new_cost"))
        status = cut(new.select(*keys, settled.alias("settled")))
        leave = status.filter(F.lit(last) | F.col("settled"))
        n_leave, n_all = status.agg(F.count_if(F.lit(last) | F.col("settled")), F.count(F.lit(1))).first()
        if n_leave:
            gone = layout.per_key(leave.select(*keys))
            done_rows.append(rows.join(gone, keys, "left_semi"))
            done_cols.append(cols.drop("share").join(gone, keys, "left_semi"))
            done_status.append(
                leave.select(*keys, F.lit(it).cast("long").alias("n_iter"), F.col("settled").alias("converged"))
            )
        if n_leave == n_all:
            break
        if n_leave:
            cols = cols.join(layout.per_key(leave.select(*keys)), keys, "left_anti")
        if opt.accelerate:
            in_cycle = 0
            if it + 3 <= opt.max_iter:
                plain, ahead = cols, True
                cols = cut(_extrapolated(earlier, before, cols, layout, vn))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cut(out)

    return union(done_rows), union(done_cols), union(done_status)


def _rotate(rows: DataFrame, cols: DataFrame, layout: _Layout) -> tuple[DataFrame, DataFrame]:
    """Canonical rank-two factors from 2x2 Gram matrices: orthonormal v, components in singular order, fixed sign."""
    keys = layout.keys
    g = cols.groupBy(*keys).agg(
        F.sum(F.col("v1") * F.col("v1")).alias("g11"),
        F.sum(F.col("v1") * F.col("v2")).alias("g12"),
        F.sum(F.col("v2") * F.col("v2")).alias("g22"),
    )
    # Gram-Schmidt: v = q r with upper-triangular r, so u moves to u r'
    g = (
        g.withColumn("r11", F.sqrt("g11"))
        .withColumn("r12", F.col("g12") / F.col("r11"))
        .withColumn("r22", F.sqrt(F.greatest(F.col("g22") - F.col("r12") * F.col("r12"), F.lit(1e-300))))
    )
    g = layout.per_key(cut(g))
    q1 = F.col("v1") / F.col("r11")
    v = cols.join(g, keys).select(
        *keys, "col_idx", q1.alias("q1"), ((F.col("v2") - F.col("r12") * q1) / F.col("r22")).alias("q2")
    )
    u = rows.join(g, keys).select(
        *keys,
        "row_idx",
        (F.col("u1") * F.col("r11") + F.col("u2") * F.col("r12")).alias("b1"),
        (F.col("u2") * F.col("r22")).alias("b2"),
    )
    h = u.groupBy(*keys).agg(
        F.sum(F.col("b1") * F.col("b1")).alias("h11"),
        F.sum(F.col("b1") * F.col("b2")).alias("h12"),
        F.sum(F.col("b2") * F.col("b2")).alias("h22"),
    )
    angle = 0.5 * F.atan2(2 * F.col("h12"), F.col("h11") - F.col("h22"))
    h = layout.per_key(cut(h.select(*keys, F.cos(angle).alias("cs"), F.sin(angle).alias("sn"))))
    cs, sn = F.col("cs"), F.col("sn")
    v = v.join(h, keys).select(
        *keys, "col_idx",
        (cs * F.col("q1") + sn * F.col("q2")).alias("v1"),
        (cs * F.col("q2") - sn * F.col("q1")).alias("v2"),
    )
    u = u.join(h, keys).select(
        *keys, "row_idx",
        (cs * F.col("b1") + sn * F.col("b2")).alias("u1"),
        (cs * F.col("b2") - sn * F.col("b1")).alias("u2"),
    )

    def sign(name: str) -> Column:
        best = F.max_by(F.col(name), F.struct(F.abs(name), -F.col("col_idx")))
        return F.when(best < 0, -1.0).otherwise(1.0)

    s = layout.per_key(cut(v.groupBy(*keys).agg(sign("v1").alias("s1"), sign("v2").alias("s2"))))
    flip = lambda df, idx, a: df.join(s, keys).select(
        *keys, idx, (F.col(f"{a}1") * F.col("s1")).alias(f"{a}1"), (F.col(f"{a}2") * F.col("s2")).alias(f"{a}2")
    )
    return flip(u, "row_idx", "u"), flip(v, "col_idx", "v")


def fit_relational(cells: DataFrame, opt: FitOptions, starts: bool = False) -> FitTables:
    """Relational form for collapsed ``cells``; every key present is fitted in the same rounds.

    With ``starts`` the first vectors are the columns ``s1`` and ``s2`` of the cells (one value per key and column).
    """
    keys = key_columns(cells)
    scale = cut(
        cells.groupBy(*keys).agg(
            F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("scale"),
            F.sum("n_dup").alias("n_obs"),
            F.sum("within_chi2").alias("within_chi2"),
        )
    )
    n_keys = scale.count()
    e = F.col("total_err") / F.col("scale")
    scaled = cells.join(per_key(scale.select(*keys, "scale"), n_keys), keys).select(
        *keys, "row_idx", "col_idx", (F.col("value") / F.col("scale")).alias("y"),
        (1.0 / (e * e + opt.ridge)).alias("w"), (1.0 / (e * e)).alias("wc"),
    )
    layout = _Layout(scaled, keys, opt.salt)
    if starts:
        given = cells.groupBy(*keys, "col_idx").agg(F.max("s1").alias("s1"), F.max("s2").alias("s2"))
        col_ids = cut(_unit(_unit(given, keys, "s1", n_keys), keys, "s2", n_keys))
        cols = col_ids.select(*keys, "col_idx", F.col("s1").alias("v"))
    else:
        col_ids = cut(scaled.select(*keys, "col_idx").distinct())
        cols = _power(layout, col_ids.withColumn("v", F.lit(1.0)), "v", "y", opt.start_rounds)
    rows, cols, status = _relational_loop(layout, cols, 1, opt)
    norm = per_key(cols.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_n")), n_keys)
    rows = cut(rows.join(norm, keys).select(*keys, "row_idx", (F.col("u") * F.col("_n")).alias("u")))
    cols = cut(cols.join(norm, keys).select(*keys, "col_idx", (F.col("v") / F.col("_n")).alias("v")))
    all_rows, all_cols, states = rows, cols, [(1, status)]

    def residual(layout_: _Layout, r: DataFrame, c: DataFrame, pred: Column) -> DataFrame:
        # the side with fewer factors is sent or hashed, the other one meets the cells where they are stored
        both = [(r, "row_idx"), (c, "col_idx")]
        (f, idx), (g, other) = sorted(both, key=lambda x: layout_.count[x[1]], reverse=True)
        g = F.broadcast(g) if layout_.count[other] <= SENT else g
        return layout_.gather(f, idx).join(g, [*keys, other]).withColumn("r", F.col("y") - pred)

    chi2 = residual(layout, rows, cols, F.col("u") * F.col("v"))
    chi2s = [chi2.groupBy(*keys).agg(F.sum(F.col("wc") * F.col("r") * F.col("r")).alias("chi2_rank1"))]
    if opt.rank == 2:
        if starts:
            both = col_ids.select(*keys, "col_idx", F.col("s1").alias("v1"), F.col("s2").alias("v2"))
        else:
            res = residual(layout, rows, cols, F.col("u") * F.col("v"))
            second = _Layout(cut(res.select(*keys, "row_idx", "col_idx", "r")), keys, opt.salt, layout)
            start = _power(second, col_ids.withColumn("v", F.sin(1.0 + F.col("col_idx"))), "v", "r", opt.start_rounds)
            second.release()
            both = cut(cols.withColumnRenamed("v", "v1").join(start.withColumnRenamed("v", "v2"), [*keys, "col_idx"]))
        rows2, cols2, status2 = _relational_loop(layout, both, 2, opt)
        pred = F.col("u1") * F.col("v1") + F.col("u2") * F.col("v2")
        chi2 = residual(layout, rows2, cols2, pred)
        chi2s.append(chi2.groupBy(*keys).agg(F.sum(F.col("wc") * F.col("r") * F.col("r")).alias("chi2_rank2")))
        states.append((2, status2))
        rows2, cols2 = _rotate(rows2, cols2, layout)
        all_rows, all_cols = rows.join(rows2, [*keys, "row_idx"]), cols.join(cols2, [*keys, "col_idx"])
    dims = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).join(
        cols.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cols")), keys
    )
    summary = scale.join(dims, keys)
    for (rank, st), c in zip(states, chi2s):
        st = st.withColumnRenamed("n_iter", f"n_iter_rank{rank}").withColumnRenamed("converged", f"converged_rank{rank}")
        summary = summary.join(st, keys).join(c, keys).withColumn(
            f"chi2_rank{rank}", F.col(f"chi2_rank{rank}") + F.col("within_chi2")
        )
    summary = cut(summarise(summary.drop("within_chi2", "scale"), opt))
    us = ["u"] + (["u1", "u2"] if opt.rank == 2 else [])
    all_rows = all_rows.join(per_key(scale.select(*keys, "scale"), n_keys), keys)
    all_rows = all_rows.select(*keys, "row_idx", *[(F.col(c) * F.col("scale")).alias(c) for c in us])
    out = FitTables(summary, cut(all_rows), cut(all_cols))
    layout.release()
    return out


# -------------------------------------------------------------------- dispatch
def _with_replicate(df: DataFrame) -> DataFrame:
    return df if "replicate" in df.columns else df.withColumn("replicate", F.lit(-1).cast("long"))


def split_by_size(cells: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Cells of the keys that fit one task, those of the keys that do not, and the array elements of the former.

    The size of a matrix is bounded by both the square of its cell count and the span of its indices; a frame without
    indices counts its rows.
    """
    keys = key_columns(cells)
    n, size = F.count(F.lit(1)).cast("double"), F.count(F.lit(1)).cast("double")
    if "row_idx" in cells.columns:
        span = lambda c: (F.max(c) - F.min(c) + 1).cast("double")
        size = F.least(n * n, span("row_idx") * span("col_idx"))
    sizes = cells.groupBy(*keys).agg(size.alias("size"))
    fits = F.col("size") <= limit
    total, n_big = sizes.agg(F.sum(F.when(fits, F.col("size"))), F.count_if(~fits)).first()
    if not n_big:
        return cells, None, int(total or 0)
    big = per_key(cut(sizes.filter(~fits).select(*keys)), n_big)
    return cells.join(big, keys, "left_anti"), cells.join(big, keys, "left_semi"), int(total or 0)


def fit(
    obs: DataFrame, opt: FitOptions = FitOptions(), unique: bool = False, form: str = "auto", cov: DataFrame | None = None,
    start: DataFrame | None = None,
) -> FitTables:
    """Fit every key of ``obs`` with rank one and, if asked, rank two. ``unique`` promises one observation per cell.

    ``cov``: covariance ``(matrix_id, i, j, c)`` of the observations by their ``seq``, for a generalised fit. ``start``:
    ``(matrix_id, col_idx, s1, s2)``, column vectors to start from in place of the default ones (see ``start_from``).
    """
    if cov is not None:
        from crossfactor.operators.correlated import fit_correlated

        return fit_correlated(obs, cov, opt, start)
    obs = usable(_with_replicate(obs))
    if unique:
        cells = obs.select(
            *key_columns(obs), "row_idx", "col_idx", "value", "total_err",
            F.lit(1).cast("long").alias("n_dup"), F.lit(0.0).alias("within_chi2"),
        )
    else:
        cells = keep(collapse(obs))
    if start is not None:
        cells = cells.join(start.select("matrix_id", "col_idx", "s1", "s2"), ["matrix_id", "col_idx"])
    given = start is not None
    if form == "relational":
        tables = fit_relational(cells, opt, given)
        tables.extra["large"] = cut(cells.select(*key_columns(cells)).distinct())
        cells.unpersist()
        return tables
    small, large, total = split_by_size(cells, opt.group_max_cells if form == "auto" else 2**62)
    blocks = small.withColumn("rep0", F.col("replicate"))
    tables = tables_from_blocks(cut(fit_blocks(blocks, opt, True, total, starts=given)), opt) if total else None
    tables = _with_large(tables, large, opt, given)
    cells.unpersist()  # what the result needs of it is stored
    return tables


def start_from(tables: FitTables) -> DataFrame:
    """Starting vectors from an earlier fit: the column factor of rank one, and the second one of rank two."""
    second = F.col("v2") if "v2" in tables.cols.columns else F.sin(1.0 + F.col("col_idx"))
    return tables.cols.select("matrix_id", "col_idx", F.col("v").alias("s1"), second.alias("s2"))


def _with_large(tables: FitTables | None, large: DataFrame | None, opt: FitOptions, starts: bool = False) -> FitTables:
    """Add the matrices that went through the relational form, and remember which they were."""
    if large is not None:
        other = fit_relational(large, opt, starts)
        tables = other if tables is None else merge(tables, other)
        tables.extra["large"] = cut(large.select(*key_columns(large)).distinct())
    if tables is None:
        raise ValueError("no cells to fit")
    return tables


def merge(a: FitTables, b: FitTables) -> FitTables:
    return FitTables(
        a.summary.unionByName(b.summary), a.rows.unionByName(b.rows), a.cols.unionByName(b.cols)
    )


def multistart(obs: DataFrame, n_starts: int, seed: int = 42, opt: FitOptions = FitOptions(), unique: bool = False) -> FitTables:
    """Fits from hashed random starts, one key per start. The starting vectors depend on seed, matrix, start, column."""
    obs = usable(_with_replicate(obs))
    cells = collapse(obs) if not unique else obs.withColumn("n_dup", F.lit(1).cast("long")).withColumn(
        "within_chi2", F.lit(0.0)
    )
    many = cells.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(n_starts - 1))))
    base = [seed, F.col("matrix_id"), F.col("start"), F.col("col_idx")]
    many = (
        many.withColumn("s1", hashed_normal(*base, "start1"))
        .withColumn("s2", hashed_normal(*base, "start2"))
        .withColumn("rep0", F.col("replicate"))
    )
    many = keep(many)
    small, large, total = split_by_size(many, opt.group_max_cells)
    tables = tables_from_blocks(cut(fit_blocks(small, opt, True, total, starts=True)), opt) if total else None
    tables = _with_large(tables, large, opt, starts=True)
    many.unpersist()
    return tables


# ------------------------------------------------------------------ prediction
def predict(obs: DataFrame, tables: FitTables, rank: int = 2) -> DataFrame:
    """Add ``pred1`` and, for rank two, ``pred2`` to each observation by gathering both factors."""
    shared = [k for k in key_columns(obs) if k in tables.rows.columns]
    joined = obs.join(tables.rows, [*shared, "row_idx"]).join(tables.cols, [*key_columns(tables.cols), "col_idx"])
    out = joined.withColumn("pred1", F.col("u") * F.col("v"))
    if rank == 2:
        out = out.withColumn("pred2", F.col("u1") * F.col("v1") + F.col("u2") * F.col("v2"))
    return out.drop("u", "v", "u1", "v1", "u2", "v2")


def predict_matrix(tables: FitTables, rank: int = 1) -> DataFrame:
    """The complete model matrix of each key, observed or not."""
    keys = key_columns(tables.rows)
    grid = tables.rows.join(tables.cols, keys)
    pred = F.col("u") * F.col("v") if rank == 1 else F.col("u1") * F.col("v1") + F.col("u2") * F.col("v2")
    return grid.select(*keys, "row_idx", "col_idx", pred.alias("pred"))


def frobenius(df: DataFrame, a: str, b: str, w: Column | None = None) -> DataFrame:
    d = F.col(a) - F.col(b)
    sq = d * d if w is None else w * d * d
    return df.groupBy(*key_columns(df)).agg(F.sqrt(F.sum(sq)).alias("distance"))


def best_start(summary: DataFrame, rank: int = 2, top: int = 1) -> DataFrame:
    """The ``top`` starts with the lowest chi-square per matrix."""
    keys = [k for k in key_columns(summary) if k != "start"]
    w = Window.partitionBy(*keys).orderBy(F.col(f"chi2_rank{rank}"), "start")
    return summary.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def start_agreement(tables: FitTables, rank: int = 2, tol: float = 0.05) -> DataFrame:
    """Largest relative distance between the predictions of the three best starts.

    Distances of products of factors come from their Gram matrices, so no prediction is written out.
    """
    keys = [k for k in key_columns(tables.summary) if k != "start"]
    top = best_start(tables.summary, rank, 3).select(*keys, "start", "place")
    us, vs = (["u"], ["v"]) if rank == 1 else (["u1", "u2"], ["v1", "v2"])

    def grams(factors: DataFrame, idx: str, names: list[str], out: str) -> DataFrame:
        f = factors.join(top, [*keys, "start"]).select(*keys, idx, "place", *names)
        a = f.select(*keys, idx, F.col("place").alias("pa"), *[F.col(n).alias(f"a{i}") for i, n in enumerate(names)])
        b = f.select(*keys, idx, F.col("place").alias("pb"), *[F.col(n).alias(f"b{i}") for i, n in enumerate(names)])
        pairs = a.join(b, [*keys, idx]).filter(F.col("pa") <= F.col("pb"))
        cells = [(i, k) for i in range(rank) for k in range(rank)]
        return pairs.groupBy(*keys, "pa", "pb").agg(*[F.sum(F.col(f"a{i}") * F.col(f"b{k}")).alias(f"{out}{i}{k}") for i, k in cells])

    g = grams(tables.rows, "row_idx", us, "g").join(grams(tables.cols, "col_idx", vs, "h"), [*keys, "pa", "pb"])
    dot = sum((F.col(f"g{i}{k}") * F.col(f"h{i}{k}") for i in range(rank) for k in range(rank)), F.lit(0.0))
    dots = g.select(*keys, "pa", "pb", dot.alias("dot"))
    own = dots.filter(F.col("pa") == F.col("pb"))
    side = lambda p, name: own.select(*keys, F.col("pa").alias(p), F.col("dot").alias(name))
    pairs = dots.filter(F.col("pa") < F.col("pb")).join(side("pa", "aa"), [*keys, "pa"]).join(side("pb", "bb"), [*keys, "pb"])
    gap = F.sqrt(F.greatest(F.col("aa") + F.col("bb") - 2 * F.col("dot"), F.lit(0.0)))
    out = pairs.groupBy(*keys).agg(F.max(gap / (F.sqrt(F.greatest("aa", F.lit(0.0))) + 1e-10)).alias("max_rel_diff"))
    return out.withColumn("is_stable", F.col("max_rel_diff") <= tol)
