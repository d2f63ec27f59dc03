"""Cells made preset by preset in one pass: curves on the grid each preset asks for, and facts cut by each preset.

``presets.apply_presets`` slices finished cells. Ranges, resolutions and modes of curves, and cuts on the facts behind a
cell, need the preset before the cell exists: here it is a key of interpolation and aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crossfactor.operators.cells import clean, mean_cells, merge_moments, moments
from crossfactor.operators.curves import even_grid, interpolate, strict_range, trapezoid, valid_points
from crossfactor.operators.presets import Preset


def _pick(key: str, values: dict[int, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(key))


def curve_cells(
    curves: DataFrame, presets: list[Preset], t_min: float, t_max: float, n_points: int = 20, mode: str = "normalized", log: bool = True,
    label: str = "t=%.3f",
) -> DataFrame:
    """Cells (curve x grid point) of every preset: ``preset, row_label, col_idx, col_label, axis_value, n_points, mode,
    value, total_err``.

    A preset names the range (inside the common one of the curves it keeps), the number of grid points, the mode (``raw``
    values, or ``normalized`` to unit area) and which curves stay; what it leaves open has the defaults given here. Presets
    that agree in curves, range and grid share one interpolation, whatever their mode. A preset that keeps no curve has no
    cells. ``curves``: ``matrix_id, t, y, total_err`` and, for presets with a subset, ``source``.
    """
    shapes: dict[tuple, int] = {}
    uses: dict[int, list[tuple[str, str]]] = {}
    for p in presets:
        if p.cuts:
            raise ValueError(f"preset {p.name}: cuts are for facts, see fact_cells")
        shape = (p.exclude_element, p.include_rows, p.subset if not p.include_rows else None, p.range_min if p.range_min is not None else t_min, p.range_max if p.range_max is not None else t_max, p.n_points or n_points)
        uses.setdefault(shapes.setdefault(shape, len(shapes)), []).append((p.name, p.mode or mode))
    keeps = []
    for (drop, only, subset, *_), i in shapes.items():
        keep = F.lit(True)
        if drop is not None:
            keep = keep & (F.col("matrix_id") != drop)
        if only:
            keep = keep & F.col("matrix_id").isin(*only)
        if subset is not None:
            keep = keep & (F.upper("source") == subset.upper())
        keeps.append(F.when(keep, F.lit(i)))
    number = lambda k: {i: s[k] for s, i in shapes.items()}
    pts = valid_points(curves).withColumn("shape", F.explode(F.array_compact(F.array(*keeps))))
    ranges = strict_range(pts, _pick("shape", number(3)), _pick("shape", number(4)), ["shape"])
    grid = even_grid(ranges, _pick("shape", number(5)))
    by = ["shape", "matrix_id"]
    logs = pts.select(*by, "t", F.log("y").alias("ly"), (F.col("total_err") / F.col("y")).alias("rel"))
    g = interpolate(logs, grid, ["ly", "rel"], by).withColumn("y", F.exp("ly")).withColumn("err", F.exp("ly") * F.col("rel"))
    area = trapezoid(g, by).filter((F.col("n_points") >= 2) & (F.col("integral") > 0)).select(*by, "integral")
    named = F.create_map(*[x for i, u in uses.items() for x in (F.lit(i), F.array(*[F.struct(F.lit(p).alias("preset"), F.lit(m).alias("mode")) for p, m in u]))])
    out = g.join(area, by, "left").select("*", F.inline(F.element_at(named, F.col("shape"))))
    unit = F.when(F.col("mode") == "normalized", F.col("integral")).otherwise(1.0)  # null without an area: dropped below
    y, err = F.col("y") / unit, F.col("err") / unit
    value, err = (F.log(y), err / y) if log else (y, err)
    return clean(
        out.select(
            "preset", F.col("matrix_id").alias("row_label"), "col_idx", F.format_string(label, F.col("t")).alias("col_label"), F.col("t").alias("axis_value"),
            _pick("shape", number(5)).alias("n_points"), "mode", value.alias("value"), err.alias("total_err"),
        )
    )


def fact_cells(facts: DataFrame, presets: list[Preset], value: Column, min_obs: int = 2) -> DataFrame:
    """Mean cells of every preset, ``matrix_id, preset, row_label, col_label, value, total_err, n_obs``, in one pass over the facts.

    ``facts``: ``matrix_id, row_label, col_label`` and the columns that presets cut on. A fact is tagged with the set of
    presets that keep it and shrinks with all facts of its cell and set before any of them is multiplied, so what is
    shuffled does not grow with the number of presets. ``min_xP_points`` keeps rows with so many cells.
    """
    columns = facts.columns
    bits = [F.when(F.coalesce(p.predicate(columns), F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, p in enumerate(presets)]
    if len(presets) > 30:
        raise ValueError("at most 30 presets at once")
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    keys = ["matrix_id", "row_label", "col_label"]
    m = moments(facts.select(*keys, mask.alias("_kept"), value.alias("_x")), [*keys, "_kept"], F.col("_x"))
    names = F.array(*[F.when(F.col("_kept").bitwiseAND(F.lit(1 << k)) != 0, F.lit(p.name)) for k, p in enumerate(presets)])
    cells = mean_cells(merge_moments(m.withColumn("preset", F.explode(F.array_compact(names))), ["preset", *keys]), min_obs)
    dense = {p.name: dict(p.cuts)["min_xP_points"] for p in presets if "min_xP_points" in dict(p.cuts)}
    if dense:
        rows = ["preset", "matrix_id", "row_label"]
        points = cells.groupBy(*rows).agg(F.count(F.lit(1)).alias("_points"))
        least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in dense.items() for x in kv]), F.col("preset")), F.lit(0.0))
        cells = cells.join(points, rows).filter(F.col("_points") >= least).drop("_points")
    return cells
