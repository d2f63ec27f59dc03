"""Checks on cells and results, all in one layout: ``(keys, check, passed, message, details)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crossfactor.schemas import key_columns


def _stack(df: DataFrame, keys: list[str], rows: list[tuple[str, Column, Column, dict[str, Column]]]) -> DataFrame:
    """One aggregate row per key to one row per check."""
    items = [
        F.struct(
            F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), message.alias("message"),
            F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("double"))]).alias("details"),
        )
        for name, passed, message, details in rows
    ]
    return df.select(*keys, F.inline(F.array(*items)))


def coverage(cells: DataFrame, min_obs: int = 20, min_fill: float = 0.5, min_rows: int = 2) -> DataFrame:
    """Enough observations, enough of the grid filled, enough rows with data."""
    keys = [k for k in key_columns(cells) if k in ("matrix_id", "preset")]
    a = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("row_idx").alias("r"), F.countDistinct("col_idx").alias("c"),
        F.countDistinct("row_idx", "col_idx").alias("u"),
    )
    n, r, c, fill = F.col("n"), F.col("r"), F.col("c"), F.col("u") / (F.col("r") * F.col("c"))
    return _stack(
        a, keys,
        [
            ("data_coverage", n >= min_obs, F.format_string("%d observations, %dx%d matrix", n, r, c), {"n_obs": n, "n_rows": r, "n_cols": c}),
            ("matrix_completeness", fill > min_fill, F.format_string("%.4f of all cells are filled", fill), {"fill_fraction": fill}),
            ("row_coverage", r >= min_rows, F.format_string("%d rows with data", r), {"n_rows": r}),
        ],
    )


def window_coverage(curves: DataFrame, t_min: float, t_max: float) -> DataFrame:
    """Every curve spans the analysis window."""
    a = curves.groupBy("matrix_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return _stack(
        a, ["matrix_id"],
        [("t_range", (lo <= t_min) & (hi >= t_max), F.format_string("range: [%.3f, %.3f]", lo, hi), {"t_min": lo, "t_max": hi})],
    )


def value_ranges(cells: DataFrame) -> DataFrame:
    """Values of order one, relative errors between one percent and one, mean near one."""
    keys = [k for k in key_columns(cells) if k in ("matrix_id", "preset")]
    rel = F.col("total_err") / F.abs("value")
    a = cells.groupBy(*keys).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("m"), F.min(rel).alias("el"), F.max(rel).alias("eh"), F.avg(rel).alias("em")
    )
    lo, hi, m, el, eh, em = (F.col(x) for x in ("lo", "hi", "m", "el", "eh", "em"))
    return _stack(
        a, keys,
        [
            ("physical_reasonability", (lo > -1) & (hi < 5) & (m > 0.5) & (m < 2.0), F.format_string("Mean %.3f, range [%.3f, %.3f]", m, lo, hi), {"mean": m, "min": lo, "max": hi}),
            ("error_reasonability", (el > 0.01) & (eh < 1.0) & (em > 0.05), F.format_string("Mean relative error: %.3f", em), {"mean_rel_error": em}),
            ("mean_near_one", (m > 0.8) & (m < 1.2), F.format_string("Mean = %.3f (expected about 1)", m), {"mean": m}),
        ],
    )


def bounds_check(df: DataFrame, keys: list[str], bounds: dict[str, tuple[float, float]], name: str = "physical_range") -> DataFrame:
    """All values of each column strictly inside its bounds."""
    aggs = [f(c).alias(f"{p}_{c}") for c in bounds for p, f in (("lo", F.min), ("hi", F.max))]
    a = df.groupBy(*keys).agg(*aggs)
    ok, text, details = F.lit(True), [], {}
    for c, (lo, hi) in bounds.items():
        ok = ok & (F.col(f"lo_{c}") > lo) & (F.col(f"hi_{c}") < hi)
        text.append(F.format_string(f"{c}: [%.5g, %.5g]", F.col(f"lo_{c}"), F.col(f"hi_{c}")))
        details |= {f"{c}_min": F.col(f"lo_{c}"), f"{c}_max": F.col(f"hi_{c}")}
    return _stack(a, keys, [(name, ok, F.concat_ws(", ", *text), details)])


def run_checks(frames: list[DataFrame]) -> DataFrame:
    """Results of several checks as one table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def overall(checks: DataFrame, keys: list[str]) -> DataFrame:
    return checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if("passed").alias("n_passed"), F.bool_and("passed").alias("all_passed")
    )
