"""Provenance as a table: where cells come from, what was cut, which fallbacks were taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossfactor.schemas import PROVENANCE

#: Origins of cells, and those that never support a verdict.
ORIGINS = ["api", "manual_table", "arxiv_pdf", "root_file", "placeholder", "cache", "fallback"]
UNTRUSTED = ["placeholder", "fallback"]


def _array_type(name: str):
    return PROVENANCE[name].dataType


def build(
    matrices: DataFrame, origin: Column | str, details: str = "", sources: DataFrame | None = None, filters: DataFrame | None = None,
    fallbacks: DataFrame | None = None, files: DataFrame | None = None, stamp: bool = True,
) -> DataFrame:
    """One provenance row per matrix from event tables keyed by ``matrix_id``.

    Events are few per matrix (files read, cuts applied, sources passed over), so they are gathered as arrays.
    """
    out = matrices.select("matrix_id").distinct()
    out = out.withColumn("origin", F.lit(origin) if isinstance(origin, str) else origin).withColumn("origin_details", F.lit(details))
    for name, events in (("sources", sources), ("input_files", files), ("selection_filters", filters), ("fallbacks", fallbacks)):
        kind = _array_type(name)
        if events is None:
            out = out.withColumn(name, F.array().cast(kind))
            continue
        fields = [f for f in kind.elementType.fields]
        cols = [
            (F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
        ]
        g = events.select("matrix_id", F.struct(*cols).alias("e")).groupBy("matrix_id").agg(F.array_sort(F.collect_list("e")).alias(name))
        out = out.join(g, "matrix_id", "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = out.withColumn("build_timestamp", now if stamp else F.lit(None).cast("string"))
    return out.withColumn("extra", F.create_map().cast("map<string,string>")).select(*[f.name for f in PROVENANCE.fields])


def flags(prov: DataFrame) -> DataFrame:
    return prov.withColumn("has_fallbacks", F.size("fallbacks") > 0).withColumn("is_placeholder", F.col("origin") == "placeholder")


def warnings(prov: DataFrame) -> DataFrame:
    """One row per warning: fallbacks taken and placeholder data."""
    fb = prov.select("matrix_id", F.explode("fallbacks").alias("f")).select(
        "matrix_id", F.format_string("%s took %s instead: %s", F.col("f.step"), F.col("f.fallback_to"), F.col("f.reason")).alias("warning")
    )
    ph = prov.filter(F.col("origin") == "placeholder").select("matrix_id", F.lit("stand-in values, not measurements").alias("warning"))
    return fb.unionByName(ph)


def distinct_dois(prov: DataFrame) -> DataFrame:
    return prov.select(F.explode("sources.doi").alias("doi")).filter(F.col("doi").isNotNull()).distinct()


def write(prov: DataFrame, path: str) -> None:
    prov.write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROVENANCE).json(path)
