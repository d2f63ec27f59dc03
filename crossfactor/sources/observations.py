"""Reading and writing observation tables, their metadata and covariances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from crossfactor.schemas import COV, OBS

_LABELS = ["row_label", "col_label"]
_ERRORS = ["stat_err", "sys_err", "total_err"]


def complete(obs: DataFrame) -> DataFrame:
    """All observation columns in order: missing errors are 0 and missing labels empty."""
    for field in OBS.fields:
        if field.name not in obs.columns:
            obs = obs.withColumn(field.name, F.lit(None).cast(field.dataType))
    filled = obs.fillna(0.0, subset=_ERRORS).fillna("", subset=_LABELS)
    return filled.select(*[F.col(f.name).cast(f.dataType) for f in OBS.fields])


#: Finest split of matrices into buckets, and so the bound on what the writer counts.
MOST_BUCKETS = 65_536


def _write_clustered(df: DataFrame, path: str, order: list[str], rows_per_file: int) -> None:
    """Folders ``of=<buckets>/bucket=<b>`` by hash of ``matrix_id``, files of about ``rows_per_file`` rows sorted by matrix.

    The number of buckets follows from the rows, never from the number of matrices. A bucket with more rows than a file
    should hold (one hot matrix, say) is written by as many tasks as it needs.
    """
    fine = F.pmod(F.hash("matrix_id"), F.lit(MOST_BUCKETS))
    counts = {r["b"]: r["n"] for r in df.groupBy(fine.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    of = 1
    while of < MOST_BUCKETS and of * rows_per_file < sum(counts.values()):
        of *= 2
    held: dict[int, int] = {}
    for b, n in counts.items():
        held[b % of] = held.get(b % of, 0) + n
    spark = df.sparkSession
    pieces = spark.createDataFrame([(b, -(-n // rows_per_file)) for b, n in held.items()], "bucket int, _pieces long")
    placed = df.withColumn("of", F.lit(of)).withColumn("bucket", F.pmod(F.hash("matrix_id"), F.lit(of)))
    placed = placed.join(F.broadcast(pieces), "bucket").withColumn("_piece", F.pmod(F.xxhash64(*order), F.col("_pieces")))
    files = max(1, sum(-(-n // rows_per_file) for n in held.values()))
    laid = placed.repartition(files, "bucket", "_piece").sortWithinPartitions("bucket", "matrix_id", *order)
    laid.drop("_pieces", "_piece").write.mode("overwrite").partitionBy("of", "bucket").parquet(path)


def write_observations(
    obs: DataFrame, path: str, cov: DataFrame | None = None, meta: DataFrame | None = None, rows_per_file: int = 4_000_000
) -> None:
    """Observations clustered by matrix in hash buckets; covariance (clustered alike) and metadata beside them."""
    _write_clustered(complete(obs), f"{path}/obs", ["seq", "row_idx", "col_idx"], rows_per_file)
    if cov is not None:
        _write_clustered(cov.select(*[f.name for f in COV.fields]), f"{path}/cov", ["i", "j"], rows_per_file)
    if meta is not None:
        meta.write.mode("overwrite").parquet(f"{path}/meta")


def _read_clustered(spark: SparkSession, path: str, schema, matrices: list[str] | None) -> DataFrame:
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("of", T.IntegerType()), T.StructField("bucket", T.IntegerType())])).parquet(path)
    if matrices is not None:
        # a condition on folders only, so other buckets are not listed into the scan; sorted files skip by their statistics
        buckets = [F.pmod(F.hash(F.lit(m)), F.col("of")) for m in matrices]
        df = df.filter(F.col("bucket").isin(buckets) & F.col("matrix_id").isin(matrices)) if matrices else df.filter(F.lit(False))
    return df.select(*[f.name for f in schema.fields])


def read_observations(spark: SparkSession, path: str, matrices: list[str] | None = None) -> DataFrame:
    """The stored observations, of all matrices or of those named; only the buckets of these are read."""
    return complete(_read_clustered(spark, f"{path}/obs", OBS, matrices))


def read_covariance(spark: SparkSession, path: str, matrices: list[str] | None = None) -> DataFrame:
    return _read_clustered(spark, f"{path}/cov", COV, matrices)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException:
        return False


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The stored table when present, else build, store and read back."""
    if force or not exists(spark, f"{path}/obs"):
        write_observations(build(), path)
    return read_observations(spark, path)


_JSON = (
    "name string, description string, observations array<struct<row_idx:int, col_idx:int, value:double, stat_err:double, "
    "sys_err:double, total_err:double, row_label:string, col_label:string>>, covariance array<array<double>>, "
    "row_labels array<string>, col_labels array<string>"
)


def documents_json(obs: DataFrame, cov: DataFrame | None = None, most: int = 1_000_000) -> DataFrame:
    """One JSON document per matrix, meant for matrices that people exchange as files.

    The document holds its matrix in one row, so it is refused, before anything is gathered, when a matrix has more than
    ``most`` observations or covariance entries; parquet is the format for those.
    """
    for frame in (obs, cov):
        if frame is not None:
            large = frame.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).limit(5).collect()
            if large:
                raise ValueError(f"too large for one document: {', '.join(str(r['matrix_id']) for r in large)}")
    cells = obs.groupBy("matrix_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "row_idx", "col_idx", "value", *_ERRORS, *_LABELS))), lambda x: x.dropFields("seq")
        ).alias("observations")
    )
    if cov is not None:
        rows = cov.groupBy("matrix_id", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda x: x["c"]).alias("r"))
        dense = rows.groupBy("matrix_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("covariance"))
        cells = cells.join(dense, "matrix_id", "left")
    cols = [F.col("matrix_id").alias("name"), "observations", *(["covariance"] if cov is not None else [])]
    return cells.select("matrix_id", F.to_json(F.struct(*cols)).alias("json"))


def write_json(obs: DataFrame, path: str, cov: DataFrame | None = None) -> None:
    documents_json(obs, cov).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def parse_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations and covariance from a frame with a ``json`` column."""
    d = docs.select(F.from_json("json", _JSON).alias("d")).select("d.*")
    obs = d.select(F.col("name").alias("matrix_id"), F.posexplode("observations").alias("seq", "o")).select("matrix_id", "seq", "o.*")
    cov = (
        d.select(F.col("name").alias("matrix_id"), F.posexplode("covariance").alias("i", "row"))
        .select("matrix_id", "i", F.posexplode("row").alias("j", "c"))
        .select("matrix_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "c")
    )
    return complete(obs), cov


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_documents(spark.read.text(path).withColumnRenamed("value", "json"))


def read_curated(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """A curated table: columns and rows with an explicit schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def histogram_curve(table: DataFrame, min_bins: int = 10) -> DataFrame:
    """A histogram table ``(matrix_id, centre, value, variance)`` as a curve; at most ten bins are not a curve."""
    enough = table.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_bins)
    return table.join(enough.select("matrix_id"), "matrix_id", "left_semi").select(
        "matrix_id", F.col("centre").alias("t"), F.col("value").alias("y"), F.sqrt("variance").alias("total_err")
    )


# ---------------------------------------------------------------- result sinks
def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def read_results(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report table as CSV files, as many as it has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)
