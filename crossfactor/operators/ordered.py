"""Positions and running sums inside ordered groups, with a form for groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crossfactor.session import cut


def running(
    df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column] | None = None, spread: bool = False
) -> DataFrame:
    """Add ``rn`` (1, 2, ...) and running inclusive sums per group.

    ``spread`` sorts by range over all tasks instead of one task per group: positions and sums are computed inside each
    range and shifted by the totals of the ranges before it, of which there are only as many as partitions.
    """
    sums = sums or {}
    if not spread:
        w = Window.partitionBy(*by).orderBy(*order)
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", F.row_number().over(w).alias("rn"), *[F.sum(c).over(run).alias(n) for n, c in sums.items()])
    parts = df.sparkSession.sparkContext.defaultParallelism
    ranged = cut(df.repartitionByRange(parts, *[F.col(b) for b in by], *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()]
    )
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        *by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_s_{n}") for n in sums],
    )
    w = Window.partitionBy(*by, "_range").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", F.row_number().over(w).alias("_rn"), *[F.sum(c).over(run).alias(f"_l_{n}") for n, c in sums.items()])
    out = local.join(shift, [*by, "_range"])
    return out.select(
        *df.columns, (F.col("_rn") + F.col("_n0")).alias("rn"),
        *[(F.col(f"_l_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums],
    )


def value_positions(df: DataFrame, by: list[str], value: str, bucket: Column | None = None, spread: bool = False) -> DataFrame:
    """Distinct values per group with ``n_le`` (how many rows are at most this value), ``n_eq`` and group size ``n``.

    Rows collapse to distinct values before anything is sorted. With a monotone ``bucket`` of the value, each group is
    sorted bucket by bucket, so a group holding most of the rows is still spread; ``spread`` does without a bucket and
    sorts by range over all tasks.
    """
    if spread:
        d = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_eq"))
        size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        d = running(d, by, [value], {"n_le": F.col("n_eq")}, spread=True).join(size, by)
        return d.select(*by, value, "n_eq", F.col("n_le").cast("long").alias("n_le"), "n")
    bucket = bucket if bucket is not None else F.lit(0)
    d = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_eq")).withColumn("_b", bucket)
    tot = d.groupBy(*by, "_b").agg(F.sum("n_eq").alias("_nb"))
    wb = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(
        *by, "_b", F.coalesce(F.sum("_nb").over(wb), F.lit(0)).alias("_off"),
        F.sum("_nb").over(Window.partitionBy(*by)).alias("n"),
    )
    w = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.join(off, [*by, "_b"]).select(
        *by, value, "n_eq", (F.sum("n_eq").over(w) + F.col("_off")).alias("n_le"), "n"
    )


def average_ranks(df: DataFrame, by: list[str], value: str, spread: bool = False) -> DataFrame:
    """Add ``rank``, the mean position of the value inside its group (ties share it).

    The default sorts each group in one task, which suits vectors; ``spread`` ranks distinct values and joins them back.
    """
    if not spread:
        same = Window.partitionBy(*by, value)
        first = F.rank().over(Window.partitionBy(*by).orderBy(value))
        return df.withColumn("rank", first + (F.count(F.lit(1)).over(same) - 1) / 2)
    pos = value_positions(df, by, value, spread=True)
    rank = F.col("n_le") - (F.col("n_eq") - 1) / 2
    return df.join(pos.select(*by, value, rank.alias("rank")), [*by, value])


def modal_value(df: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """The most frequent value and its share; the one seen first wins ties."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"), F.min(seq).alias("_s"))
    best = F.max_by(F.col(value), F.struct(F.col("_c"), -F.col("_s")))
    return c.groupBy(*by).agg(best.alias("mode"), (F.max("_c") / F.sum("_c")).alias("share"))
