"""Pseudo-data under a fitted or given separable model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crossfactor.functions.noise import hashed_normal
from crossfactor.schemas import key_columns


def _noise_parts(seed: int, df: DataFrame, replicate: Column, stream: str) -> list:
    keys = [F.col(k) for k in key_columns(df) if k in ("matrix_id", "preset")]
    return [seed, *keys, replicate, F.col("row_idx"), F.col("col_idx"), stream]


def pseudo_data(df: DataFrame, pred: str, n: int, seed: int = 42, stream: str = "null", first: int = 0) -> DataFrame:
    """One row per cell and replicate (``n`` of them from number ``first``): prediction plus error times hashed noise."""
    numbers = F.sequence(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long"))
    many = df.drop("replicate").withColumn("replicate", F.explode(numbers))
    z = hashed_normal(*_noise_parts(seed, many, F.col("replicate"), stream))
    return many.withColumn("value", F.col(pred) + F.col("total_err") * z)


def pseudo_blocks(
    df: DataFrame, pred: str, n: int, n_cells: str, seed: int = 42, stream: str = "null", block_values: int = 1_000_000
) -> tuple[DataFrame, Column]:
    """The same pseudo-data packed for the grouped fit: one row per cell and *block* of consecutive replicates, and the
    expression that draws the values of a block as an array.

    The draw is left to the reader, which spreads the blocks first: noise is then made where it is used and never
    shuffled. A block holds at most ``block_values`` numbers over all cells of its matrix.
    """
    size = F.greatest(F.lit(1), F.least(F.lit(n), F.floor(F.lit(float(block_values)) / F.col(n_cells)))).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.col("_size"))
    many = df.drop("replicate").withColumn("_size", size).withColumn("rep0", F.explode(starts))
    many = many.withColumn("rep1", F.least(F.col("rep0") + F.col("_size") - 1, F.lit(n - 1).cast("long"))).drop("_size")

    def draw(b: Column) -> Column:
        z = hashed_normal(*_noise_parts(seed, many, b, stream))
        return F.col(pred) + F.col("total_err") * z

    return many, F.transform(F.sequence(F.col("rep0"), F.col("rep1")), draw)


def inject(df: DataFrame, row_effect: DataFrame, col_effect: DataFrame, seed: int = 12345) -> DataFrame:
    """On the observed cells and errors, a separable table given by ``row_effect(row_idx, g)`` and
    ``col_effect(col_idx, h)`` plus noise."""
    keys = key_columns(df)
    shared_r = [k for k in keys if k in row_effect.columns]
    shared_c = [k for k in keys if k in col_effect.columns]
    j = df.join(row_effect, [*shared_r, "row_idx"]).join(col_effect, [*shared_c, "col_idx"])
    z = hashed_normal(*_noise_parts(seed, j, F.lit("inject"), "inject"))
    return j.withColumn("value", F.col("g") * F.col("h") + F.col("total_err") * z).drop("g", "h")


def smooth_effects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Default separable effects for an injection check: 1 + 0.2 sin on rows, 1 + 0.2 cos on columns, v of unit norm."""
    keys = key_columns(df)
    rows = df.select(*keys, "row_idx").distinct().withColumn("g", 1.0 + 0.2 * F.sin(1.0 + F.col("row_idx")))
    cols = df.select(*keys, "col_idx").distinct().withColumn("h", 1.0 + 0.2 * F.cos(1.0 + F.col("col_idx")))
    norm = cols.groupBy(*keys).agg(F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("_n"))
    cols = cols.join(norm, keys).withColumn("h", F.col("h") / F.col("_n")).drop("_n")
    return rows, cols
