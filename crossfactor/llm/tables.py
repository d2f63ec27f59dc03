"""Shared pieces: reading tables, bounded samples for fitting, and row positions that need no single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossfactor.session import cut

#: Words of the digest contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids fall in no fold."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def class_sample(df: DataFrame, label: str, key: str, per_class: int, most: int | None = None, least: int = 20) -> DataFrame:
    """About ``per_class`` rows of each class, chosen by a hash of the key; no class is left out.

    For fitting only: the bound is a parameter of the fit. With ``most``, so many classes that these would exceed it share
    ``most`` rows, but ``least`` rows a class remain. The classes' counts cover all rows.
    """
    span = 1 << 30
    counts = cut(df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_rows")))
    if most:
        per_class = min(per_class, max(least, most // max(1, counts.count())))
    counts = counts.select(label, (F.lit(span) * F.least(F.lit(1.0), F.lit(per_class) / F.col("_rows"))).cast("long").alias("_limit"))
    chosen = F.pmod(F.xxhash64(F.col(key), F.lit("fit")), F.lit(span))
    return join_small(df, counts, label).where(chosen < F.col("_limit")).select(*df.columns)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", most: int = 100_000) -> DataFrame:
    """Joins a summary: stored and counted first, and broadcast only up to ``most`` narrow rows; else a shuffled join."""
    small = cut(small)
    return big.join(F.broadcast(small) if small.count() <= most else small, on, how)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row number in a column of a free name. The plan must read rows in a fixed order, as files are."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def positions(df: DataFrame, by: list[Column], group: list[str], into: str) -> DataFrame:
    """Adds ``into``: the row's place from 0 within its group, in the order of ``group`` and then ``by``.

    Rows are sorted by range over all tasks, so a group of any size is split; only one row per task and group (its
    first place and its count) meets in a window. Rows equal in every key follow their order of reading.
    The result is stored once, since the range borders must not move between the two uses.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in group] + list(by)
    n = partitions(spark)
    d = df.withColumn("_tie", F.monotonically_increasing_id())
    d = d.repartitionByRange(n, *keys, F.col("_tie")).sortWithinPartitions(*keys, F.col("_tie")).drop("_tie")
    d = cut(d.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)))
    heads = d.groupBy("_task", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    heads = heads.select(F.col("_task").alias("_task2"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_before")
    on = F.col("_task") == F.col("_task2")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return join_small(d, heads, on).withColumn(into, F.col("_at") + F.col("_before")).select(*df.columns, into)
