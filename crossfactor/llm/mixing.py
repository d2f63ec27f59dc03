"""Mix sources to target weights by systematic sampling of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossfactor.llm.tables import WORD, join_small, numbered, positions, table
from crossfactor.session import cut


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(source, source_size, target)``: each source's share of all words by weight, at most ``most`` times its size.

    Weights repeat over the sources in code-point order, null last. The excess of capped sources goes to the others by
    weight until none is above: with sources ordered by the level at which they reach their cap, the common level is
    the first at which the rest is served. One row per source meets in one window.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.array(*[F.lit(int(w)) for w in weights])
    s = s.withColumn("_w", F.element_at(pick, (rank % len(weights) + 1).cast("int")))
    order = [F.col("source_size") * most / F.col("_w"), F.col("source").asc_nulls_last()]
    before, onward = (Window.orderBy(*order).rowsBetween(*r) for r in ((Window.unboundedPreceding, -1), (Window.currentRow, Window.unboundedFollowing)))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    s = s.withColumn("_level", left / F.sum("_w").over(onward)).withColumn("_nth", F.row_number().over(Window.orderBy(*order)))
    served = F.when(F.col("_level") * F.col("_w") <= F.col("source_size") * most, F.struct("_nth", "_level"))
    s = s.withColumn("_all", F.min(served).over(whole))
    target = F.least(F.col("source_size") * most * F.lit(1.0), F.col("_all._level") * F.col("_w"))
    return s.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, drawn from the seed and the source's name."""
    name = F.coalesce(F.concat(F.lit(f"{seed}:s:"), source), F.lit(f"{seed}:n"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 11) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to rows that have ``doc_id``, ``source`` and ``size``.

    Every document of a source expects ``target / source_size`` copies. Their running sum, in the order of falling
    size (then id, null last) and shifted by one offset per source, emits a copy at each whole number it passes. The
    order by size keeps the words taken within about one largest document of the target, whatever the offset.
    Null sources are a source; empty documents are taken at no cost; no rows give no rows. Positions come from a sort
    by range, so a source that holds most rows is spread over all tasks.
    """
    rates = targets(sizes, weights, most)
    placed = positions(sizes, [F.col("size").desc(), F.col("doc_id").asc_nulls_last()], ["source"], "_k")
    rates = rates.select(F.col("source").alias("_s"), "source_size", "target")
    out = join_small(placed, rates, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = F.floor((F.col("_k") + 1) * rate + u) - F.floor(F.col("_k") * rate + u)
    return out.withColumn("copies", copies.cast("long")).drop("_k")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 11) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, columns unchanged."""
    d, row = numbered(docs)
    plan = mix(d.select(row, "doc_id", "source", n_words(F.col("text")).alias("size")), weights, most, seed)
    plan = plan.where("copies > 0").select(row, F.col("copies").alias("_copies"))
    out = d.join(cut(plan), row)
    return out.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s0),
s2 AS (SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (SUM(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev,
       ROW_NUMBER() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS nth FROM s1),
l AS (SELECT ARG_MIN(lev, nth) AS lev FROM s2 WHERE lev * w <= 3 * source_size),
t AS (SELECT source, source_size, LEAST(3.0::DOUBLE * source_size, l.lev * w) AS target,
      CASE WHEN source_size > 0 THEN LEAST(3.0::DOUBLE * source_size, l.lev * w) / source_size ELSE 0.0::DOUBLE END AS rate,
      ('0x' || SUBSTR(MD5(COALESCE('11:s:' || source, '11:n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s2, l),
k AS (SELECT doc_id, size, source, ROW_NUMBER() OVER (PARTITION BY source ORDER BY size DESC, doc_id NULLS LAST) - 1 AS k FROM d)
SELECT doc_id, size, source_size, target, ((FLOOR((k + 1) * rate + u) - FLOOR(k * rate + u)) * size)::BIGINT AS taken
FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
"""
