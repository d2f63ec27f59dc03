"""From fact tables to cells: aggregation, cleaning, indexing, dense views and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crossfactor.functions.scalars import finite, fit_weight, total_error, weight
from crossfactor.schemas import key_columns
from crossfactor.session import cut


# ---------------------------------------------------------------- aggregation
def moments(df: DataFrame, by: list[str | Column], value: Column) -> DataFrame:
    """Mergeable moments ``(n, mean, m2)`` per group, ``m2`` being the squares about the mean: the small frame that may be
    joined further and merged again. Central moments keep their digits however large the mean is."""
    n = F.count(value)
    return df.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2"))


def merge_moments(df: DataFrame, by: list[str]) -> DataFrame:
    """Moments of unions of groups. The partial moments are stored, as they are read for the means and then about them."""
    df = cut(df.select(*by, "n", "mean", "m2").filter(F.col("n") > 0))
    n, mean = F.col("n"), F.col("mean")
    centre = df.groupBy(*by).agg((F.sum(n * mean) / F.sum(n)).alias("_c"))
    centre = centre.select(*[F.col(b).alias(f"_{b}") for b in by], "_c")
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    off = mean - F.col("_c")
    return df.join(centre, on).groupBy(*by).agg(
        F.sum("n").alias("n"), F.max("_c").alias("mean"), F.sum(F.col("m2") + n * off * off).alias("m2")
    )


def mean_cells(m: DataFrame, min_count: int = 2) -> DataFrame:
    """Moments to cells: value is the mean and the error its standard error."""
    var = F.col("m2") / (F.col("n") - 1)
    rest = [c for c in m.columns if c not in ("mean", "m2", "n")]
    return m.filter(F.col("n") >= min_count).select(
        *rest,
        F.col("mean").alias("value"),
        F.sqrt(var / F.col("n")).alias("total_err"),
        F.col("n").alias("n_obs"),
    )


# ------------------------------------------------------------------- cleaning
def usable(obs: DataFrame) -> DataFrame:
    """The observations a weighted fit can use: finite, with a positive finite error."""
    return obs.filter(finite(F.col("value")) & finite(F.col("total_err")) & (F.col("total_err") > 0))


def clean(obs: DataFrame) -> DataFrame:
    """Complete missing parts, derive the total error and drop cells chi-square cannot use."""
    have = set(obs.columns)
    stat = F.col("stat_err") if "stat_err" in have else F.lit(0.0)
    sys = F.col("sys_err") if "sys_err" in have else F.lit(0.0)
    tot = F.col("total_err") if "total_err" in have else None
    out = (
        obs.withColumn("total_err", total_error(stat, sys, tot))
        .withColumn("stat_err", F.coalesce(stat, F.lit(0.0)))
        .withColumn("sys_err", F.coalesce(sys, F.lit(0.0)))
    )
    return usable(out)


def with_weights(obs: DataFrame, ridge: float = 1e-8) -> DataFrame:
    err = F.col("total_err")
    return obs.withColumn("weight", weight(err)).withColumn("fit_weight", fit_weight(err, ridge))


# ------------------------------------------------------------------- indexing
def label_table(obs: DataFrame, label: str) -> DataFrame:
    """Distinct labels per key with their dense position in sorted order."""
    keys = key_columns(obs)
    w = Window.partitionBy(*keys).orderBy(label)
    return obs.select(*keys, label).distinct().withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def index_labels(obs: DataFrame) -> DataFrame:
    """Add ``row_idx`` and ``col_idx`` by label order.

    Ranks the distinct labels, then joins them back, so the window sorts labels and not observations.
    """
    keys = key_columns(obs)
    for label, idx in (("row_label", "row_idx"), ("col_label", "col_idx")):
        obs = obs.drop(idx).join(label_table(obs, label).withColumnRenamed("idx", idx), [*keys, label])
    return obs


def canonical_order(obs: DataFrame, label: str, canon: DataFrame) -> DataFrame:
    """Labels in a given order first (``canon(label, ord)``), then the leftovers alphabetically."""
    keys = key_columns(obs)
    seen = obs.select(*keys, F.col(label).alias("label")).distinct()
    known = seen.join(canon, "label").withColumn("tier", F.lit(0))
    rest = seen.join(canon, "label", "left_anti").withColumn("ord", F.lit(0)).withColumn("tier", F.lit(1))
    w = Window.partitionBy(*keys).orderBy("tier", "ord", "label")
    return known.unionByName(rest).select(*keys, "label", (F.row_number().over(w) - 1).alias("idx"))


def distinct_labels(obs: DataFrame, label: str) -> DataFrame:
    return obs.select(*key_columns(obs), label).distinct().orderBy(*key_columns(obs), label)


def display_names(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Replace a label by its display name where one is defined."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))


# ----------------------------------------------------------------- duplicates
def last_wins(obs: DataFrame) -> DataFrame:
    """The observation with the highest ``seq`` per cell; an aggregate, so partial results combine before the shuffle."""
    keys = key_columns(obs)
    rest = [c for c in obs.columns if c not in (*keys, "row_idx", "col_idx")]
    picked = obs.groupBy(*keys, "row_idx", "col_idx").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("r"))
    return picked.select(*keys, "row_idx", "col_idx", *[F.col(f"r.{c}").alias(c) for c in rest])


def collapse(obs: DataFrame) -> DataFrame:
    """All observations of a cell as one equivalent observation.

    With w = 1/err^2: weighted mean, error 1/sqrt(sum w), and the scatter inside the cell, which every model pays
    alike. Fits on the result equal fits on the observations, and a group can no longer exceed rows x columns.
    """
    keys = key_columns(obs)
    w = 1.0 / (F.col("total_err") * F.col("total_err"))
    s = obs.groupBy(*keys, "row_idx", "col_idx").agg(
        F.count(F.lit(1)).alias("n_dup"),
        F.sum(w).alias("sw"),
        F.sum(w * F.col("value")).alias("swy"),
        F.sum(w * F.col("value") * F.col("value")).alias("swyy"),
    )
    mean = F.col("swy") / F.col("sw")
    scatter = F.greatest(F.col("swyy") - F.col("swy") * mean, F.lit(0.0))
    return s.select(
        *keys,
        "row_idx",
        "col_idx",
        mean.alias("value"),
        (1.0 / F.sqrt("sw")).alias("total_err"),
        "n_dup",
        F.when(F.col("n_dup") == 1, 0.0).otherwise(scatter).alias("within_chi2"),
    )


# ----------------------------------------------------------------- dense view
def dense_grid(obs: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Every (row, column) of each matrix with the last observation or nulls, and a mask.

    The grid is the product of two label tables *within* a key: an equi-join on the key, not a cross join.
    """
    keys = key_columns(obs)
    cell = last_wins(obs).select(*keys, "row_idx", "col_idx", "value", "total_err")
    grid = rows.join(cols, keys)
    return grid.join(cell, [*keys, "row_idx", "col_idx"], "left").withColumn(
        "mask", F.col("value").isNotNull().cast("int")
    )


def dense_rows(obs: DataFrame, columns: list[int]) -> DataFrame:
    """One row per matrix row with a column per ``col_idx`` (a pivot with the columns given up front)."""
    keys = key_columns(obs)
    return last_wins(obs).groupBy(*keys, "row_idx").pivot("col_idx", columns).agg(F.first("value"))


def vectors(obs: DataFrame) -> DataFrame:
    return obs.select(*key_columns(obs), "row_idx", "col_idx", "value", "total_err")


# ------------------------------------------------------------------ summaries
def matrix_summary(obs: DataFrame) -> DataFrame:
    """Shape, fill, range and mean relative error per matrix (last observation per cell)."""
    keys = key_columns(obs)
    out = last_wins(obs).groupBy(*keys).agg(
        F.countDistinct("row_idx").alias("n_rows"),
        F.countDistinct("col_idx").alias("n_cols"),
        F.count(F.lit(1)).alias("n_cells"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg(F.col("total_err") / F.abs("value")).alias("mean_rel_error"),
    )
    return out.withColumn("fill_fraction", F.col("n_cells") / (F.col("n_rows") * F.col("n_cols")))


def weighted_mean(df: DataFrame, by: list[str], value: Column, w: Column) -> DataFrame:
    """Weighted mean and its error; null where nothing carries weight."""
    s = df.groupBy(*by).agg(F.sum(w * value).alias("_a"), F.sum(w).alias("_b"))
    ok = F.col("_b") > 0
    return s.select(
        *by,
        F.when(ok, F.col("_a") / F.col("_b")).alias("mean"),
        F.when(ok, 1.0 / F.sqrt("_b")).alias("mean_err"),
    )


def ratio_to_reference(obs: DataFrame, reference_col: int = 0) -> DataFrame:
    """Each column against a reference column of the same row, with the propagated error."""
    keys = key_columns(obs)
    ref = obs.filter(F.col("col_idx") == reference_col).select(
        *keys, "row_idx", F.col("value").alias("v0"), F.col("total_err").alias("e0")
    )
    ratio = F.col("value") / F.col("v0")
    rel = F.sqrt(F.pow(F.col("e0") / F.col("v0"), 2) + F.pow(F.col("total_err") / F.col("value"), 2))
    joined = obs.filter(F.col("col_idx") != reference_col).join(ref, [*keys, "row_idx"])
    return joined.filter((F.col("v0") != 0) & (F.col("value") != 0)).select(
        *keys, "row_idx", "col_idx", ratio.alias("ratio"), (F.abs(ratio) * rel).alias("ratio_err")
    )


def mean_ratio(ratios: DataFrame) -> DataFrame:
    keys = key_columns(ratios)
    return ratios.filter(finite(F.col("ratio"))).groupBy(*keys, "col_idx").agg(
        F.avg("ratio").alias("mean_ratio"), F.count(F.lit(1)).alias("n_ratios")
    )
