"""Session construction and the one way lineage is cut."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting (since 4.1) that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "crossfactor", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is tuned for; a cluster's own settings win when present."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, which cannot import it from the driver's path on a cluster."""
    sc = spark.sparkContext
    name = f"crossfactor-{sc.applicationId}.zip"
    if any(f.endswith(name) for f in sc.listFiles):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(top, "crossfactor")):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), top))
    sc.addPyFile(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a scratch folder only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a stored table, in whatever store Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so later plans start from stored rows and survive lost executors.

    Stored rows need the shuffles behind them no more, so these files go at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def keep(df: DataFrame) -> DataFrame:
    """Reuse across several consumers of one plan; spills to disk and is recomputed when an executor goes away."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
