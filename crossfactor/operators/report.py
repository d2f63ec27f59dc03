"""Result tables and plot data; no drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def summary_table(results: DataFrame) -> DataFrame:
    """One formatted row per analysis."""
    f = F.format_string
    return results.select(
        F.col("matrix_id").alias("dataset"), f("%d×%d", "n_rows", "n_cols").alias("matrix_size"), "n_obs",
        f("%.2f", "chi2_rank1").alias("chi2_r1"), f("%.2f", "chi2_rank2").alias("chi2_r2"), f("%.2f", "lambda_stat").alias("lambda"),
        f("%.4f", "p_value").alias("p_value"), f("[%.4f, %.4f]", "p_lower", "p_upper").alias("ci95"),
        F.when(F.col("p_value") < 0.05, "Yes").otherwise("No").alias("significant"),
    )


def chi2_table(results: DataFrame) -> DataFrame:
    one = F.lit(1)
    return results.select(
        F.col("matrix_id").alias("dataset"), "chi2_rank1", "ndof_rank1",
        (F.col("chi2_rank1") / F.greatest(one, F.col("ndof_rank1"))).alias("chi2_ndof_rank1"), "chi2_rank2", "ndof_rank2",
        (F.col("chi2_rank2") / F.greatest(one, F.col("ndof_rank2"))).alias("chi2_ndof_rank2"), F.col("lambda_stat").alias("delta_chi2"),
    )


def check_table(checks: DataFrame) -> DataFrame:
    return checks.select(F.col("matrix_id").alias("dataset"), "check", F.when(F.col("passed"), "✓").otherwise("✗").alias("passed"), "message")


def combined_summary(baseline: DataFrame, modes: DataFrame) -> DataFrame:
    """Baseline results with the mode results of the same matrix, where there are any."""
    return baseline.join(modes, "matrix_id", "left")


def verdict_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("p_value") < 0.05, F.lit(False))).alias("n_significant"))


def first_rows(df: DataFrame, by: list[str], order: list, n: int = 10) -> DataFrame:
    """The first rows of each group of a report."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def heat_cells(residuals: DataFrame, value: str = "pull1", flag_above: float = 2.0) -> DataFrame:
    return residuals.select("matrix_id", "row_label", "col_label", F.col(value).alias("pull"), (F.abs(value) > flag_above).alias("flagged"))


def factor_curves(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Row and column factors as one long table."""
    r = rows.select("matrix_id", F.lit("row").alias("axis"), F.col("row_idx").alias("idx"), F.col("u").alias("val"))
    c = cols.select("matrix_id", F.lit("col").alias("axis"), F.col("col_idx").alias("idx"), F.col("v").alias("val"))
    return r.unionByName(c)


def shapes_over_row_factor(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row divided by its fitted row factor: separable rows fall on one curve."""
    j = cells.join(rows.select("matrix_id", "row_idx", "u"), ["matrix_id", "row_idx"]).filter(F.col("u") != 0)
    return j.select("matrix_id", "row_idx", "col_idx", (F.col("value") / F.col("u")).alias("shape"), (F.col("total_err") / F.abs("u")).alias("shape_err"))


def similarity(pairs: DataFrame) -> DataFrame:
    """Long similarity matrix from pair results: both orders and the diagonal."""
    a = pairs.select("source_a", "source_b", F.abs("v2_cosine").alias("similarity"))
    b = a.select(F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "similarity")
    d = a.select("source_a").union(a.select("source_b")).distinct().select("source_a", F.col("source_a").alias("source_b"), F.lit(1.0).alias("similarity"))
    return a.unionByName(b).unionByName(d)


def sweep_bars(results: DataFrame) -> DataFrame:
    w = Window.partitionBy("matrix_id").orderBy(F.desc("lambda_stat"), "preset")
    return results.select("matrix_id", "preset", "lambda_stat", "p_value", F.row_number().over(w).alias("place"))
