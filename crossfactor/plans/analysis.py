"""The two analyses end to end, for any number of matrices at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from crossfactor.operators import checks, fit as fitops, mode, presets as presetops, ranktest, replicate, resample
from crossfactor.operators.fit import FitOptions
from crossfactor.session import cut


@dataclass
class Baseline:
    result: DataFrame  # one row per matrix: fits, statistic, p-value, verdict
    checks: DataFrame  # one row per matrix and check
    test: ranktest.RankTest


def _provenance_columns(result: DataFrame, provenance: DataFrame | None):
    if provenance is None:
        return result.withColumn("origin", F.lit("api")), F.lit(True)
    joined = result.join(provenance.select("matrix_id", "origin"), "matrix_id", "left")
    return joined, F.col("origin").isNotNull()


def baseline(
    cells: DataFrame, n_bootstrap: int = 1000, seed: int = 42, opt: FitOptions = FitOptions(), provenance: DataFrame | None = None,
    extra_checks: list[DataFrame] | None = None, injection_bootstrap: int = 100,
) -> Baseline:
    """Rank test, checks, injection of a separable table on the same cells, verdict.

    ``extra_checks`` are check frames built by the caller, for example from the curves the cells come from.
    """
    test = ranktest.rank_test(cells, n_bootstrap, seed, opt)
    result, has = _provenance_columns(test.summary, provenance)
    result = cut(ranktest.verdict(result, F.coalesce("origin", F.lit("api")), has))
    found = [checks.coverage(cells)]
    explained = mode.explained_variance(fitops.predict(cells, test.observed, 1))
    found.append(
        explained.select(
            "matrix_id", F.lit("variance_explained").alias("check"), "passed",
            F.format_string("one component accounts for a share of %.3f", F.col("fraction_explained")).alias("message"),
            F.create_map(F.lit("fraction_explained"), F.col("fraction_explained")).alias("details"),
        )
    )
    if injection_bootstrap:
        rows, cols = resample.smooth_effects(cells)
        scale = cells.groupBy("matrix_id").agg((F.avg(F.abs("value")) * F.sqrt(F.count_distinct("col_idx"))).alias("_s"))
        rows = rows.join(scale, "matrix_id").withColumn("g", F.col("g") * F.col("_s")).drop("_s")
        injected = cut(resample.inject(cells, rows, cols))
        found.append(ranktest.injection_check(ranktest.rank_test(injected, injection_bootstrap, 12345, opt)))
    return Baseline(result, cut(checks.run_checks(found + list(extra_checks or []))), test)


@dataclass
class ModeAnalysis:
    result: DataFrame
    modes: DataFrame
    residuals: DataFrame
    stability: DataFrame
    sweep: DataFrame
    sweep_summary: DataFrame
    replication: DataFrame


def mode_analysis(
    cells: DataFrame, presets: list[presetops.Preset], n_bootstrap: int = 500, n_starts: int = 5, seed: int = 42, opt: FitOptions = FitOptions(),
    n_stability: int = 50,
) -> ModeAnalysis:
    """Residual mode of every matrix with localisation, stability, sweep over presets, global p-value, replication, verdict.

    Starts are real random starts and the sweep is really run; replication compares the mode of every preset that keeps
    the full grid with the mode of all cells.
    """
    spark = cells.sparkSession
    names = presetops.preset_table(spark, presets)
    swept = presetops.sweep(cells, presets, n_bootstrap, seed, opt)
    settled = (F.col("converged_rank1") & F.col("converged_rank2")) if opt.tol > 0 else F.lit(True)
    all_modes = mode.residual_modes(swept.observed)
    base = cut(all_modes.filter(F.col("preset") == "baseline").drop("preset", "replicate"))
    tables = fitops.fit(cells, opt, unique=True)
    starts = mode.residual_modes(fitops.multistart(cells, n_starts, seed, opt, unique=True))
    reps = mode.residual_modes(ranktest.null_distribution(cells, tables, n_stability, seed + 1, opt, factors=True))
    stable = cut(mode.stability(base, starts, reps))
    where = cut(mode.localization(base.filter(F.col("axis") == "col").drop("scale", "axis"), spread=tables.has_large))
    peaks = mode.peak(all_modes.filter(F.col("axis") == "col")).select("matrix_id", "preset", F.col("peak_index").alias("v2_peak_index"))
    sweep_rows = presetops.empty_presets(swept.summary, cells, presets)
    sweep_rows = cut(sweep_rows.join(peaks, ["matrix_id", "preset"], "left").withColumnRenamed("p_value", "p_local"))
    if opt.tol == 0:
        sweep_rows = sweep_rows.withColumn("fit_converged", F.col("lambda_stat").isNotNull())
    overall, _ = presetops.global_significance(swept.observed.summary, swept.null, names)
    ids = all_modes.select(F.concat_ws("|", "matrix_id", "preset").alias("mode_id"), "matrix_id", "preset", "axis", "idx", "val")
    pairs = ids.filter(F.col("preset") != "baseline").select(
        "matrix_id", F.concat_ws("|", "matrix_id", F.lit("baseline")).alias("source_a"), F.col("mode_id").alias("source_b")
    ).distinct()
    compared = replicate.compare_direct(ids.drop("matrix_id", "preset"), pairs)
    report = cut(replicate.replication_report(compared, ["matrix_id"]))
    local = sweep_rows.filter(F.col("preset") == "baseline").select("matrix_id", "p_local", "lambda_stat", "fit_converged", "chi2_rank1", "chi2_rank2", "ndof_rank1", "ndof_rank2", "n_failed")
    health = ranktest.fit_health(tables.summary.withColumn("converged_rank2", settled), tables, rank=2).select("matrix_id", F.col("passed").alias("fit_healthy"))
    result = (
        local.join(overall.select("matrix_id", "p_global", "t_obs", "best_preset"), "matrix_id", "left")
        .join(where, "matrix_id", "left").join(stable.select("matrix_id", "is_stable", "stability_grade", "v2_cosine_mean"), "matrix_id", "left")
        .join(report.select("matrix_id", "all_replicate", "mean_replication_score"), "matrix_id", "left")
        .join(health, "matrix_id", "left")
    )
    return ModeAnalysis(
        cut(mode.mode_verdict(result)), base, mode.residual_map(cells, tables), stable, sweep_rows, presetops.sweep_summary(sweep_rows), report
    )
