"""Base cell sets over the star schema, as plans. Each aggregates before it joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crossfactor.functions.noise import hashed_uniform
from crossfactor.operators.cells import index_labels, mean_cells, merge_moments, moments
from crossfactor.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(cells: DataFrame) -> DataFrame:
    """Cells with label positions, stored: labels, fits, null draws and reports all read them again, and facts must be
    scanned once. There is one row per cell, however many facts there are."""
    return cut(index_labels(cells))


def order_value_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation x market segment, mean order value. Orders shrink to one row per customer before any join."""
    orders = table(spark, sf_dir, "orders")
    per_cust = moments(orders, ["o_custkey"], F.col("o_totalprice"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    m = per_cust.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    m = merge_moments(m, ["c_nationkey", "c_mktsegment"])
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = m.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lit("orders").alias("matrix_id"), F.col("n_name").alias("row_label"), F.col("c_mktsegment").alias("col_label"),
        "n", "mean", "m2",
    )
    return indexed(mean_cells(named))


def revenue_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation x brand, mean line revenue. Lines shrink to one row per (supplier, part) before the joins."""
    line = table(spark, sf_dir, "lineitem")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    m = moments(line, ["l_suppkey", "l_partkey"], revenue)
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    m = m.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    m = merge_moments(m, ["s_nationkey", "p_brand"])
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = m.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lit("lines").alias("matrix_id"), F.col("n_name").alias("row_label"), F.col("p_brand").alias("col_label"),
        "n", "mean", "m2",
    )
    return indexed(mean_cells(named))


def priority_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One matrix per order priority: nation x order year, mean order value."""
    orders = table(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate"))
    m = moments(orders, ["o_custkey", "o_orderpriority", "yr"], F.col("o_totalprice"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    m = m.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    m = merge_moments(m, ["o_orderpriority", "c_nationkey", "yr"])
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = m.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderpriority").alias("matrix_id"), F.col("n_name").alias("row_label"),
        F.format_string("year=%d", F.col("yr")).alias("col_label"), "n", "mean", "m2",
    )
    return indexed(mean_cells(named))


def grouped_priority_cells(spark: SparkSession, sf_dir: str, leave_out: bool) -> DataFrame:
    """Nation x order year for all orders and for groups of priorities, from one scan.

    ``leave_out``: matrices ``full`` and ``without <priority>``; else ``combined`` and one per priority. The moments per
    (priority, nation, year) are what is repeated per matrix, never the orders.
    """
    orders = table(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate"))
    m = moments(orders, ["o_custkey", "o_orderpriority", "yr"], F.col("o_totalprice"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    m = cut(merge_moments(m.join(cust, F.col("o_custkey") == F.col("c_custkey")), ["o_orderpriority", "c_nationkey", "yr"]))
    if leave_out:
        everyone = m.agg(F.collect_set("o_orderpriority")).scalar()
        rest = F.array_remove(F.col("_all"), F.col("o_orderpriority"))
        names = F.concat(F.array(F.lit("full")), F.transform(rest, lambda x: F.concat(F.lit("without "), x)))
        m = m.withColumn("_all", everyone)
    else:
        names = F.array(F.lit("combined"), F.col("o_orderpriority"))
    m = merge_moments(m.withColumn("matrix_id", F.explode(names)), ["matrix_id", "c_nationkey", "yr"])
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = m.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "matrix_id", F.col("n_name").alias("row_label"), F.format_string("year=%d", F.col("yr")).alias("col_label"), "n", "mean", "m2"
    )
    return indexed(mean_cells(named))


def line_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as one observation of (part, supplier nation): unit price with a 10 percent error.

    One large sparse matrix whose rows grow with the part table and whose observations grow with the lines.
    """
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return line.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.lit("unit_price").alias("matrix_id"), F.col("l_partkey").cast("int").alias("row_idx"),
        F.col("s_nationkey").alias("col_idx"), price.alias("value"), (0.1 * F.abs(price)).alias("total_err"),
    )


def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small matrix per supplier: return flag and line status x ship year, mean line revenue."""
    line = table(spark, sf_dir, "lineitem")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    named = line.select(
        F.col("l_suppkey").cast("string").alias("matrix_id"),
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("row_label"),
        F.format_string("year=%d", F.year("l_shipdate")).alias("col_label"),
        revenue.alias("x"),
    )
    return indexed(mean_cells(moments(named, ["matrix_id", "row_label", "col_label"], F.col("x"))))


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves: event type x day number (from 1), mean value with its standard error."""
    ev = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2023-12-31").cast("date")).cast("double")
    m = moments(ev.withColumn("t", day), ["event_type", "t"], F.col("value"))
    return mean_cells(m.withColumnRenamed("event_type", "matrix_id")).withColumnRenamed("value", "y")


def embedding_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a column vector: (matrix_id, idx, val)."""
    em = table(spark, sf_dir, "embeddings")
    return em.select(
        F.col("vec_id").cast("string").alias("matrix_id"), "label", F.posexplode("embedding").alias("idx", "val")
    ).withColumn("val", F.col("val").cast("double"))


def event_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of p-values keyed by event type: one hashed uniform per event, from its number and value."""
    ev = table(spark, sf_dir, "events")
    u = hashed_uniform("p", F.col("event_id"), F.round(F.col("value") * 100).cast("long"))
    return ev.select("event_id", F.col("event_type").alias("calibration_id"), "user_id", u.alias("p"))
