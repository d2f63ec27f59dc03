"""Calibration and power of the rank test from its own p-values: simulation and strength are keys of one plan.

Every simulated table is a slice of its matrix (``preset`` names it), so all simulations of all matrices are fitted, redrawn
and fitted again together: one pass for the tables, one for their replicates, and no loop on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crossfactor.functions.noise import hashed_normal
from crossfactor.operators.fit import FitOptions, FitTables, fit, predict
from crossfactor.operators.ranktest import rank_test
from crossfactor.session import cut


def simulate(cells: DataFrame, observed: FitTables, n_sims: int, strengths: tuple[float, ...] = (0.0,), seed: int = 42) -> DataFrame:
    """Tables on the observed cells and errors: the rank-one fit, a second component of the given strength, and noise.

    The second component has normal row factors with the root mean square of the first one's and normal column factors of
    about unit norm, as in ``strength * rms(u) * a_row * b_col / sqrt(columns)``. Noise and factors depend on seed, matrix,
    simulation and cell only, so the same simulation is repeated at every strength. Adds ``preset``, ``strength``, ``sim``.
    """
    base = predict(cells.select("matrix_id", "row_idx", "col_idx", "value", "total_err"), observed, 1)
    size = observed.rows.groupBy("matrix_id").agg(F.sqrt(F.avg(F.col("u") * F.col("u"))).alias("_rms"))
    size = size.join(observed.summary.select("matrix_id", "n_cols"), "matrix_id")
    many = base.join(size, "matrix_id").withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sims - 1).cast("long"))))
    key = [seed, F.col("matrix_id"), F.col("sim")]
    second = F.col("_rms") * hashed_normal(*key, F.col("row_idx"), "row") * hashed_normal(*key, F.col("col_idx"), "col") / F.sqrt("n_cols")
    noise = F.col("total_err") * hashed_normal(*key, F.col("row_idx"), F.col("col_idx"), "sim")
    many = many.withColumn("_second", second).withColumn("_base", F.col("pred1") + noise)
    many = many.withColumn("strength", F.explode(F.array(*[F.lit(float(x)) for x in strengths])))
    return many.select(
        "matrix_id", F.format_string("strength=%.2f|sim=%d", "strength", "sim").alias("preset"), "strength", "sim", "row_idx", "col_idx",
        (F.col("_base") + F.col("strength") * F.col("_second")).alias("value"), "total_err",
    )


def simulated_p_values(
    cells: DataFrame, n_sims: int, n_bootstrap: int, strengths: tuple[float, ...] = (0.0,), seed: int = 42, opt: FitOptions = FitOptions()
) -> DataFrame:
    """``(matrix_id, preset, strength, sim, lambda_stat, k, n_used, p_value)``: the rank test of every simulated table.

    The p-value is null where fewer than half of the replicates could be used. ``cells``: one observation per cell.
    """
    observed = fit(cells, opt, unique=True)
    sims = cut(simulate(cells, observed, n_sims, strengths, seed))
    names = sims.select("matrix_id", "preset", "strength", "sim").distinct()
    test = rank_test(sims.drop("strength", "sim"), n_bootstrap, seed, opt)
    out = test.summary.select("matrix_id", "preset", "lambda_stat", "k", "n_used", "p_value")
    p = F.when(F.col("n_used") >= n_bootstrap // 2, F.col("p_value"))
    return cut(out.withColumn("p_value", p).join(names, ["matrix_id", "preset"]))
