"""Preset slices as a dimension of the plan, their rank tests, and the correction for having looked at many of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from crossfactor.functions.scalars import finite
from crossfactor.operators.fit import FitOptions
from crossfactor.operators.ordered import modal_value
from crossfactor.operators.ranktest import RankTest, p_values, rank_test

PRESET = T.StructType(
    [
        T.StructField("preset", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("sweep_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("exclude_element", T.StringType()),
        T.StructField("subset", T.StringType()),
        T.StructField("include_rows", T.ArrayType(T.StringType())),
        T.StructField("range_min", T.DoubleType()),
        T.StructField("range_max", T.DoubleType()),
        T.StructField("n_points", T.IntegerType()),
        T.StructField("mode", T.StringType()),
        T.StructField("cuts", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("is_fast", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Preset:
    """One slice of the cells: leave a label out, keep rows, one source, a range of the column axis, cuts on columns."""

    name: str
    sweep_type: str = "baseline"
    description: str = ""
    exclude_element: str | None = None
    subset: str | None = None
    include_rows: tuple[str, ...] | None = None
    range_min: float | None = None
    range_max: float | None = None
    n_points: int | None = None
    mode: str | None = None
    cuts: tuple[tuple[str, float], ...] = ()
    is_fast: bool = False

    def predicate(self, columns: list[str]) -> Column:
        """The rows of a cell frame this preset keeps."""
        needs = [c for c, used in (("source", self.subset and not self.include_rows), ("axis_value", self.range_min is not None or self.range_max is not None), ("mode", self.mode), ("n_points", self.n_points)) if used]
        if lost := [c for c in needs if c not in columns]:
            raise ValueError(f"preset {self.name}: the cells have no column {', '.join(lost)}")
        keep = F.lit(True)
        if self.exclude_element is not None:
            keep = keep & (F.col("row_label") != self.exclude_element) & (F.col("col_label") != self.exclude_element)
        if self.include_rows:
            keep = keep & F.col("row_label").isin(*self.include_rows)
        elif self.subset is not None:
            keep = keep & (F.upper("source") == self.subset.upper())
        if self.range_min is not None:
            keep = keep & (F.col("axis_value") >= self.range_min)
        if self.range_max is not None:
            keep = keep & (F.col("axis_value") <= self.range_max)
        if self.mode is not None:
            keep = keep & (F.col("mode") == self.mode)
        if self.n_points is not None:
            keep = keep & (F.col("n_points") == self.n_points)
        for name, bound in self.cuts:
            column, _, side = name.rpartition("_")
            if side == "min" and column in columns:
                keep = keep & (F.col(column) >= bound)
            elif side == "max" and column in columns:
                keep = keep & (F.col(column) <= bound)
            elif name != "min_xP_points":  # a count of points per row, see apply_presets
                raise ValueError(f"preset {self.name}: the cells have no column {column or name!r}")
        return keep


# The preset lists of the three published analyses.
SIGNAL_STRENGTH_PRESETS = [
    Preset("baseline", "baseline", "all cells", is_fast=True),
    Preset("loo_gamgam", "leave_one_out", "without γγ", exclude_element="γγ", is_fast=True),
    Preset("loo_ZZ", "leave_one_out", "without ZZ*", exclude_element="ZZ*"),
    Preset("loo_WW", "leave_one_out", "without WW*", exclude_element="WW*"),
    Preset("loo_tautau", "leave_one_out", "without ττ", exclude_element="ττ"),
    Preset("loo_bb", "leave_one_out", "without bb̄", exclude_element="bb̄", is_fast=True),
    Preset("gluon_only", "data_subset", "rows ggF and ttH", include_rows=("ggF", "ttH")),
    Preset("vector_only", "data_subset", "rows VBF, WH and ZH", include_rows=("VBF", "WH", "ZH")),
]
ELASTIC_PRESETS = [
    Preset("baseline", "baseline", "whole common range", is_fast=True),
    Preset("tight_range", "range_variation", "t from 0.05 to 0.15", range_min=0.05, range_max=0.15, is_fast=True),
    Preset("medium_range", "range_variation", "t from 0.03 to 0.20", range_min=0.03, range_max=0.20),
    Preset("wide_range", "range_variation", "t from 0.02 to 0.30", range_min=0.02, range_max=0.30),
    Preset("res_50", "resolution", "grid of 50", n_points=50),
    Preset("res_100", "resolution", "grid of 100", n_points=100),
    Preset("res_200", "resolution", "grid of 200", n_points=200),
    Preset("raw_mode", "mode", "values as measured", mode="raw"),
    Preset("normalized_mode", "mode", "values over their integral", mode="normalized", is_fast=True),
]
DIFFRACTIVE_PRESETS = [
    Preset("baseline", "baseline", "all cells after the usual cuts", is_fast=True),
    Preset("high_Q2", "kinematic_cut", "Q² from 10", cuts=(("Q2_min", 10.0),), is_fast=True),
    Preset("mid_beta", "kinematic_cut", "β from 0.1 to 0.9", cuts=(("beta_min", 0.1), ("beta_max", 0.9))),
    Preset("dense_coverage", "kinematic_cut", "rows with 5 points or more", cuts=(("min_xP_points", 5.0),)),
    Preset("h1_only", "data_subset", "source H1", subset="H1", is_fast=True),
    Preset("zeus_only", "data_subset", "source ZEUS", subset="ZEUS"),
]
_PRESETS = {
    "higgs": SIGNAL_STRENGTH_PRESETS,
    "higgs_atlas": SIGNAL_STRENGTH_PRESETS,
    "higgs_atlas_mu": SIGNAL_STRENGTH_PRESETS,
    "elastic": ELASTIC_PRESETS,
    "elastic_totem": ELASTIC_PRESETS,
    "diffractive": DIFFRACTIVE_PRESETS,
    "diffractive_dis": DIFFRACTIVE_PRESETS,
}


def presets_for(dataset: str, fast: bool = False) -> list[Preset]:
    return [p for p in _PRESETS.get(dataset, []) if p.is_fast or not fast]


def preset_table(spark: SparkSession, presets: list[Preset]) -> DataFrame:
    rows = [
        (
            p.name, i, p.sweep_type, p.description, p.exclude_element, p.subset,
            list(p.include_rows) if p.include_rows else None, p.range_min, p.range_max, p.n_points, p.mode, dict(p.cuts), p.is_fast,
        )
        for i, p in enumerate(presets)
    ]
    return spark.createDataFrame(rows, PRESET)


def preset_json(table: DataFrame) -> DataFrame:
    return table.select("preset", F.to_json(F.struct(*[c for c in table.columns])).alias("json"))


def preset_from_json(df: DataFrame) -> DataFrame:
    return df.select(F.from_json("json", PRESET).alias("p")).select("p.*")


def apply_presets(cells: DataFrame, presets: list[Preset]) -> DataFrame:
    """One pass over the cells: each row is emitted once for every preset that keeps it.

    ``min_xP_points`` keeps only rows of the matrix with at least that many cells.
    """
    cols = cells.columns
    dense = {p.name: dict(p.cuts)["min_xP_points"] for p in presets if "min_xP_points" in dict(p.cuts)}
    if dense:
        by = [c for c in ("matrix_id", "row_idx") if c in cols]
        cells = cells.join(cells.groupBy(*by).agg(F.count_distinct("col_idx").alias("_points")), by)
    tags = []
    for p in presets:
        keep = p.predicate(cols)
        if p.name in dense:
            keep = keep & (F.col("_points") >= dense[p.name])
        tags.append(F.when(keep, F.lit(p.name)))
    return cells.withColumn("preset", F.explode(F.array_compact(F.array(*tags)))).drop("_points")


def empty_presets(summary: DataFrame, matrices: DataFrame, presets: list[Preset]) -> DataFrame:
    """A failed row for every preset that matched no cell of a matrix, so that nothing goes missing silently."""
    listed = F.array(*[F.struct(F.lit(p.name).alias("preset"), F.lit(i).alias("ord")) for i, p in enumerate(presets)])
    want = matrices.select("matrix_id").distinct().select("matrix_id", F.inline(listed))
    return want.join(summary, ["matrix_id", "preset"], "left").withColumn(
        "fit_converged", F.coalesce(F.col("converged_rank1") & F.col("converged_rank2"), F.lit(False))
    )


def sweep(cells: DataFrame, presets: list[Preset], n_bootstrap: int, seed: int = 42, opt: FitOptions = FitOptions()) -> RankTest:
    """The rank test of every matrix under every preset, in one plan.

    Noise is keyed by matrix and preset, so replicates of different presets are independent draws.
    """
    return rank_test(apply_presets(cells, presets), n_bootstrap, seed, opt)


def global_significance(observed: DataFrame, null: DataFrame, presets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Maximum statistic over the presets against the same maximum in each replicate; a preset without a fit counts as 0,
    one that hit the round limit counts with its statistic.

    Equal statistics go to the preset listed first (``presets``: preset, ord), else to the first name.
    """
    if presets is not None:
        observed = observed.join(presets.select("preset", "ord"), "preset")
    tie = [F.col("ord")] if presets is not None else []
    keys = [k for k in ("matrix_id",) if k in null.columns]
    lam = F.coalesce(F.when(finite(F.col("lambda_stat")), F.col("lambda_stat")), F.lit(0.0))
    t_obs = observed.groupBy(*keys).agg(
        F.max(lam).alias("lambda_stat"), F.min_by("preset", F.struct(-F.round(lam, 9), *tie, F.col("preset"))).alias("best_preset"), F.count(F.lit(1)).alias("n_presets")
    )
    t_null = null.groupBy(*keys, "replicate").agg(F.max(lam).alias("lambda_stat"))
    p = p_values(t_obs, t_null)
    out = t_obs.join(p, keys).withColumnRenamed("lambda_stat", "t_obs").withColumnRenamed("p_value", "p_global")
    return out, t_null


def sweep_summary(results: DataFrame) -> DataFrame:
    """Ranges, spread, best preset, agreement on significance and modal peak over the converged presets of a matrix.

    The best preset has the largest statistic to six digits after the point; of equal ones the first listed. Presets that
    keep the same cells differ in the last bits only.

    Needs ``preset, ord, lambda_stat, p_local, fit_converged`` and, where modes were taken, ``v2_peak_index``.
    """
    if "v2_peak_index" not in results.columns:
        results = results.withColumn("v2_peak_index", F.lit(None).cast("int"))
    ok = F.col("fit_converged")
    lam, p = F.when(ok, F.col("lambda_stat")), F.when(ok, F.col("p_local"))
    rank = F.when(ok, F.struct(F.round("lambda_stat", 6), -F.col("ord")))
    g = results.groupBy("matrix_id").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(ok).alias("n_converged"),
        F.coalesce(F.min(lam), F.lit(0.0)).alias("lambda_min"),
        F.coalesce(F.max(lam), F.lit(0.0)).alias("lambda_max"),
        F.coalesce(F.min(p), F.lit(1.0)).alias("p_local_min"),
        F.coalesce(F.max(p), F.lit(1.0)).alias("p_local_max"),
        F.coalesce(F.max_by("preset", rank), F.lit("none")).alias("best_preset"),
        F.coalesce(F.max_by("p_local", rank), F.lit(1.0)).alias("best_p_local"),
        F.coalesce(F.stddev_pop(lam), F.lit(0.0)).alias("lambda_std"),
        F.coalesce(F.stddev_pop(p), F.lit(0.0)).alias("p_local_std"),
        (F.count_distinct(p < 0.05) <= 1).alias("all_agree_significance"),
    )
    peaks = modal_value(results.filter(ok), ["matrix_id"], "v2_peak_index", "ord").select(
        "matrix_id", F.col("mode").alias("peak_mode"), F.col("share").alias("peak_consistency")
    )
    return g.join(peaks, "matrix_id", "left").fillna({"peak_consistency": 0.0})


def ranked_presets(results: DataFrame) -> DataFrame:
    """Presets of a matrix by falling statistic (to nine digits), list order on ties."""
    w = Window.partitionBy("matrix_id").orderBy(F.desc(F.round("lambda_stat", 9)), "ord")
    return results.withColumn("place", F.row_number().over(w))


def seed_robustness(runs: DataFrame, limit: float = 0.05) -> DataFrame:
    """Spread of the p-value over seeds (``runs``: matrix_id, seed, p_value)."""
    g = runs.groupBy("matrix_id").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("p_value").alias("p_mean"), F.stddev_pop("p_value").alias("p_std")
    )
    return g.withColumn("robust", F.col("p_std") < limit)
