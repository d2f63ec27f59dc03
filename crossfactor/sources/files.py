"""File manifests, checksums and data-portal records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossfactor.schemas import FILE_RECORD


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, SHA-256, size and time of every file below a folder; each file is hashed where it is read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"),
        F.sha1("content").alias("sha1"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_time"),
    )


def content_manifest(df: DataFrame, name: Column, content: Column) -> DataFrame:
    """The same figures for contents that lie in a column: one row per row, hashed where it is read."""
    raw = content.cast("binary")
    return df.select(
        name.alias("path"), name.alias("file"), F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"),
        F.octet_length(raw).cast("long").alias("size_bytes"),
    )


def verify_checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare a manifest with ``expected(file, checksum)`` where the checksum reads 'algorithm:hash' or a bare SHA-256.

    Adler sums are not recomputed and count as skipped; a file that is not there fails.
    """
    parts = F.split("checksum", ":")
    e = expected.select(
        "file", F.when(F.size(parts) > 1, F.lower(parts[0])).otherwise("sha256").alias("algorithm"), F.lower(F.element_at(parts, -1)).alias("wanted")
    )
    j = e.join(files, "file", "left")
    actual = F.when(F.col("algorithm") == "sha256", F.col("sha256")).when(F.col("algorithm") == "md5", F.col("md5")).when(
        F.col("algorithm") == "sha1", F.col("sha1")
    )
    status = (
        F.when(F.col("path").isNull(), "missing").when(actual.isNull(), "skipped").when(actual == F.col("wanted"), "ok").otherwise("mismatch")
    )
    return j.select("file", "algorithm", "wanted", actual.alias("actual"), status.alias("status"))


def read_file_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_RECORD).option("multiLine", True).json(path)


def record_files(records: DataFrame) -> DataFrame:
    """Files of each record: key or else file name, size, checksum, address, type, and the categories of the record."""
    cats = F.concat(F.coalesce("metadata.categories.primary", F.array()), F.coalesce("metadata.categories.secondary", F.array()))
    f = records.select(F.col("id").alias("record_id"), F.col("metadata.doi").alias("doi"), F.col("metadata.title").alias("title"), cats.alias("categories"), F.explode("metadata.files").alias("f"))
    return f.select(
        "record_id", "doi", "title", "categories", F.coalesce("f.key", "f.filename").alias("file"), F.col("f.size").alias("size"),
        F.col("f.checksum").alias("checksum"), F.col("f.uri").alias("uri"), F.col("f.type").alias("type"),
    )


def files_of_type(files: DataFrame, kind: str) -> DataFrame:
    return files.filter(F.lower("type") == kind.lower())


def files_with_extension(files: DataFrame, ext: str) -> DataFrame:
    dotted = ext if ext.startswith(".") else f".{ext}"
    return files.filter(F.endswith(F.lower("file"), F.lit(dotted.lower())))


def total_size(files: DataFrame, by: list[str]) -> DataFrame:
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"))
