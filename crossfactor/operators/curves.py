"""Curves on an ordered numeric axis: ``(matrix_id, t, y, total_err)`` with one curve per ``matrix_id``.

Interpolation is a bracket join: every knot carries its right neighbour, and a grid point finds its bracket by an
equi-join on a coarse bin of the axis plus a range filter, so no pair outside a bin is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crossfactor.functions.scalars import default_error, finite
from crossfactor.operators.cells import clean
from crossfactor.operators.ordered import running


def valid_points(curves: DataFrame, min_points: int = 2, err_share: float = 0.05) -> DataFrame:
    """Positive finite points with an error; curves left with fewer than two points are dropped."""
    err = default_error(F.col("total_err"), F.col("y"), err_share)
    ok = finite(F.col("t")) & finite(F.col("y")) & (F.col("t") > 0) & (F.col("y") > 0)
    kept = curves.withColumn("total_err", err).filter(ok)
    enough = kept.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points)
    return kept.join(enough.drop("_n"), "matrix_id", "left_semi")


def strict_range(curves: DataFrame, t_min: float, t_max: float, by: list[str] | None = None) -> DataFrame:
    """The range every curve covers, inside [t_min, t_max]; that whole interval when nothing overlaps.

    Per-curve extremes first, then their maximum and minimum: both steps combine before they shuffle.
    """
    by = by or []
    pts = curves.filter(finite(F.col("t")) & (F.col("t") > 0))
    ends = pts.groupBy("matrix_id", *by).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    r = ends.groupBy(*by).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    lo = F.greatest(F.col("lo"), F.lit(t_min))
    hi = F.least(F.col("hi"), F.lit(t_max))
    good = F.col("lo").isNotNull() & (lo < hi)
    return r.select(
        *by, F.when(good, lo).otherwise(F.lit(t_min)).alias("t_lo"), F.when(good, hi).otherwise(F.lit(t_max)).alias("t_hi")
    )


def even_grid(ranges: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced points over [t_lo, t_hi], both ends exact."""
    k = F.col("col_idx")
    step = (F.col("t_hi") - F.col("t_lo")) / (n - 1)
    at = F.when(k == n - 1, F.col("t_hi")).otherwise(F.col("t_lo") + k * step)
    return ranges.withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        *[c for c in ranges.columns if c not in ("t_lo", "t_hi")], "col_idx", at.alias("t")
    )


def segments(curves: DataFrame, values: list[str], by: list[str], spread: bool = False) -> DataFrame:
    """Neighbouring knots of each curve as segments ``t0, t1`` with the values at both ends."""
    if spread:
        r = running(curves.select(*by, "t", *values), by, [F.col("t")], spread=True)
        left = r.select(*by, "rn", F.col("t").alias("t0"), *[F.col(v).alias(f"{v}0") for v in values])
        right = r.select(*by, (F.col("rn") - 1).alias("rn"), F.col("t").alias("t1"), *[F.col(v).alias(f"{v}1") for v in values])
        return left.join(right, [*by, "rn"]).drop("rn").filter(F.col("t1") > F.col("t0"))
    w = Window.partitionBy(*by).orderBy("t")
    out = curves.select(
        *by, F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"),
        *[F.col(v).alias(f"{v}0") for v in values], *[F.lead(v).over(w).alias(f"{v}1") for v in values],
    )
    return out.filter(F.col("t1").isNotNull() & (F.col("t1") > F.col("t0")))


def interpolate(curves: DataFrame, grid: DataFrame, values: list[str], by: list[str] | None = None, bins: int = 256, spread: bool = False) -> DataFrame:
    """Linear interpolation of every curve at every grid point; null outside the curve's own range.

    ``grid`` has ``t`` and ``col_idx`` and any of the ``by`` columns it depends on; ``spread`` is for curves with more
    points than one task should sort.
    """
    by = by or ["matrix_id"]
    on = [c for c in by if c in grid.columns]
    seg = segments(curves, values, by, spread)
    box = grid.groupBy(*on).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    box = box.withColumn("_w", F.when(F.col("_b") > F.col("_a"), (F.col("_b") - F.col("_a")) / bins).otherwise(1.0))

    def binned(df: DataFrame) -> DataFrame:
        if on:
            return df.join(box, on)
        return df.select("*", *[box.select(c).scalar().alias(c) for c in ("_a", "_b", "_w")])

    at = lambda c: F.greatest(F.lit(-1), F.least(F.lit(bins), F.floor((c - F.col("_a")) / F.col("_w")).cast("int")))
    seg = binned(seg).withColumn("_bin", F.explode(F.sequence(at(F.col("t0")), at(F.col("t1"))))).drop("_a", "_b", "_w")
    pts = binned(grid).withColumn("_bin", at(F.col("t"))).drop("_a", "_b", "_w")
    j = pts.join(seg, [*on, "_bin"]).filter((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1")))
    share = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    vals = [(F.col(f"{v}0") + share * (F.col(f"{v}1") - F.col(f"{v}0"))).alias(v) for v in values]
    found = j.select(*by, "col_idx", "t", "t0", *vals)
    # a grid point on a knot lies in two segments with the same value: keep the left one
    first = F.min_by(F.struct("t", *values), F.col("t0"))
    hit = found.groupBy(*by, "col_idx").agg(first.alias("r")).select(*by, "col_idx", *[F.col(f"r.{v}").alias(v) for v in values])
    curves_ids = curves.select(*by).distinct()
    if on:
        every = curves_ids.join(grid, on)
    else:
        points = grid.agg(F.array_sort(F.collect_list(F.struct("col_idx", "t"))).alias("p")).scalar()
        every = curves_ids.select(*by, F.inline(points))
    return every.join(hit, [*by, "col_idx"], "left")


def trapezoid(df: DataFrame, by: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """Integral of each curve over its non-null points."""
    w = Window.partitionBy(*by).orderBy(t)
    term = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(t) - F.lag(t).over(w))
    terms = df.filter(F.col(y).isNotNull()).select(*by, term.alias("_term"))
    return terms.groupBy(*by).agg(F.sum("_term").alias("integral"), F.count(F.lit(1)).alias("n_points"))


def shape_curves(
    curves: DataFrame, t_min: float, t_max: float, n_points: int = 20, log: bool = True, normalize: bool = False,
    label: str = "t=%.3f",
) -> DataFrame:
    """Cells (curve x grid point): ln-space interpolation on the common range, optional unit area, optional logarithm.

    Errors travel as relative errors.
    """
    pts = valid_points(curves)
    grid = even_grid(strict_range(pts, t_min, t_max), n_points)
    logs = pts.select("matrix_id", "t", F.log("y").alias("ly"), (F.col("total_err") / F.col("y")).alias("rel"))
    g = interpolate(logs, grid, ["ly", "rel"]).withColumn("y", F.exp("ly")).withColumn("err", F.exp("ly") * F.col("rel"))
    if normalize:
        area = trapezoid(g, ["matrix_id"]).filter((F.col("n_points") >= 2) & (F.col("integral") > 0))
        g = g.join(area.select("matrix_id", "integral"), "matrix_id")
        g = g.withColumn("y", F.col("y") / F.col("integral")).withColumn("err", F.col("err") / F.col("integral"))
    value, err = (F.log("y"), F.col("err") / F.col("y")) if log else (F.col("y"), F.col("err"))
    return clean(
        g.select(
            F.col("matrix_id").alias("row_label"), "col_idx", F.format_string(label, F.col("t")).alias("col_label"), "t",
            value.alias("value"), err.alias("total_err"),
        )
    )


def log_slope(curves: DataFrame, lo: float, hi: float, min_points: int = 3) -> DataFrame:
    """Falling exponential slope: minus the least-squares slope of ln y on t inside (lo, hi)."""
    pts = curves.filter((F.col("t") > lo) & (F.col("t") < hi) & (F.col("y") > 0))
    g = pts.groupBy("matrix_id").agg(F.regr_slope(F.log("y"), F.col("t")).alias("s"), F.count(F.lit(1)).alias("n_points"))
    return g.filter(F.col("n_points") >= min_points).select("matrix_id", (-F.col("s")).alias("slope"), "n_points")


def power_law(factors: DataFrame, by: list[str], x: Column, v: Column, expected: tuple[float, float] = (-1.5, -0.8)) -> DataFrame:
    """Least-squares exponent of |v| against x, at least three positive x, and whether it lies in the expected range."""
    ok = finite(x) & (x > 0)
    g = factors.filter(ok).groupBy(*by).agg(
        F.regr_slope(F.log(F.abs(v) + 1e-10), F.log(x)).alias("power"), F.count(F.lit(1)).alias("n_points")
    )
    inside = (F.col("power") > expected[0]) & (F.col("power") < expected[1])
    return g.filter(F.col("n_points") >= 3).withColumn("passed", inside)


def decreasing_share(cells: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Share of falling steps along each row and whether it reaches the threshold."""
    keys = [c for c in ("matrix_id", "preset") if c in cells.columns]
    w = Window.partitionBy(*keys, "row_idx").orderBy("col_idx")
    d = cells.withColumn("step", F.col("value") - F.lag("value").over(w)).filter(F.col("step").isNotNull())
    g = d.groupBy(*keys, "row_idx").agg(
        F.avg((F.col("step") < 0).cast("double")).alias("share"), F.count(F.lit(1)).alias("n_steps")
    )
    return g.filter(F.col("n_steps") > 1).withColumn("passed", F.col("share") >= threshold)


def slope_check(slopes: DataFrame, expected: DataFrame) -> DataFrame:
    """Slopes against published constants ``expected(matrix_id, value, tol)``: within two tolerances."""
    j = slopes.join(expected, "matrix_id")
    return j.withColumn("passed", F.abs(F.col("slope") - F.col("value")) < 2 * F.col("tol"))
