"""Queries on cells: building, cutting, indexing, reshaping, summarising."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfactor.operators import cells as cellops, checks, wrangle
from crossfactor.plans import cellsets
from crossfactor.registry import sqltext as s
from crossfactor.session import cut


def _rounded(*cols, d=6):
    return [F.round(c, d).alias(c) for c in cols]


def cells_errors(spark, sf):
    c = cellops.with_weights(cellops.clean(cellsets.revenue_cells(spark, sf)))
    return c.select(
        "row_label", "col_label", "row_idx", "col_idx", "n_obs", F.round(F.log("value"), 9).alias("log_value"),
        F.round(F.col("total_err") / F.col("value"), 9).alias("log_err"), F.round(F.col("weight") * 1e6, 6).alias("weight_millionths"),
    )


CELLS = s.with_(s.CB) + """
SELECT row_label, col_label, row_idx, col_idx, n_obs, round(ln(value), 9) AS log_value, round(total_err / value, 9) AS log_err,
 round(1e6 / (total_err * total_err), 6) AS weight_millionths FROM cb WHERE total_err > 0"""

_CUTS = {"l_quantity": (5.0, 40.0), "l_discount": (0.02, 0.08), "l_tax": (None, 0.06)}
_CUT_SQL = "l_quantity >= 5 AND l_quantity <= 40 AND l_discount >= 0.02 AND l_discount <= 0.08 AND l_tax <= 0.06"


def cells_cut_counts(spark, sf):
    return wrangle.cut_counted(cellsets.table(spark, sf, "lineitem"), _CUTS, ["l_returnflag"])


CUTS = f"SELECT l_returnflag, count(*) AS n_before, count(*) FILTER ({_CUT_SQL}) AS n_after FROM lineitem GROUP BY l_returnflag"


def cut_and_bin(spark, sf):
    """Cells of several tagged sources after range cuts, with labels printed from numbers and positions by label order."""
    line = cellsets.table(spark, sf, "lineitem")
    a = line.filter(F.col("l_linestatus") == "F").select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("value"))
    b = line.filter(F.col("l_linestatus") == "O").select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("value"), (F.col("l_extendedprice") * 0.05).alias("stat_err"))
    u = wrangle.source_cells({"F": a, "O": b}, _CUTS, F.format_string("q=%.1f_d=%.3f", F.col("l_quantity"), F.col("l_discount")), F.format_string("tax=%.5f", F.col("l_tax")))
    cells = cut(u.groupBy("matrix_id", "source", "row_label", "col_label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.max("total_err"), 4).alias("max_err")
    ))
    return cellops.index_labels(cells).drop("matrix_id")


CUT_BIN = f"""WITH u AS (SELECT l_linestatus AS source, 'q=' || printf('%.1f', l_quantity) || '_d=' || printf('%.3f', l_discount) AS row_label,
 'tax=' || printf('%.5f', l_tax) AS col_label, l_extendedprice AS value, CASE WHEN l_linestatus = 'O' THEN 0.05 ELSE 0.1 END * l_extendedprice AS e
 FROM lineitem WHERE l_linestatus IN ('F', 'O') AND {_CUT_SQL}),
i AS (SELECT *, CAST(dense_rank() OVER (ORDER BY row_label) - 1 AS INTEGER) AS row_idx, CAST(dense_rank() OVER (ORDER BY col_label) - 1 AS INTEGER) AS col_idx FROM u)
SELECT source, row_label, col_label, row_idx, col_idx, count(*) AS n, round(sum(value), 2) AS total, round(max(e), 4) AS max_err
FROM i GROUP BY source, row_label, col_label, row_idx, col_idx"""


def label_index(spark, sf):
    c = cellsets.revenue_cells(spark, sf)
    return c.select("row_label", "row_idx").distinct()


LABEL_INDEX = s.with_(s.CB) + "SELECT DISTINCT row_label, row_idx FROM cb"


def dense_grid(spark, sf):
    c = cellsets.priority_cells(spark, sf).withColumn("seq", F.col("n_obs"))
    thin = c.filter(F.col("n_obs") >= 12)
    rows, cols = c.select("matrix_id", "row_idx").distinct(), c.select("matrix_id", "col_idx").distinct()
    return cellops.dense_grid(thin, rows, cols).select("matrix_id", "row_idx", "col_idx", "mask", F.round(F.log("value"), 9).alias("log_value"))


GRID = s.with_(s.CC) + """
SELECT matrix_id, row_idx, col_idx, CASE WHEN t.value IS NULL THEN 0 ELSE 1 END AS mask, round(ln(t.value), 9) AS log_value
FROM (SELECT DISTINCT matrix_id, row_idx FROM cc) JOIN (SELECT DISTINCT matrix_id, col_idx FROM cc) USING (matrix_id)
LEFT JOIN (SELECT * FROM cc WHERE n_obs >= 12) t USING (matrix_id, row_idx, col_idx)"""


def dense_pivot(spark, sf):
    c = cellsets.order_value_cells(spark, sf).withColumn("seq", F.col("n_obs"))
    p = cellops.dense_rows(c, [0, 1, 2, 3, 4])
    return p.select("matrix_id", "row_idx", *[F.round(str(i), 3).alias(f"c{i}") for i in range(5)])


PIVOT = s.with_(s.CA) + "SELECT matrix_id, row_idx, " + ", ".join(
    f"round(max(value) FILTER (col_idx = {i}), 3) AS c{i}" for i in range(5)
) + " FROM ca GROUP BY matrix_id, row_idx"


def last_wins(spark, sf):
    """Last order line (by order and line number) of each part x supplier-nation cell."""
    line = cellsets.table(spark, sf, "lineitem")
    supp = cellsets.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    obs = line.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.lit("m").alias("matrix_id"), F.col("l_partkey").alias("row_idx"), F.col("s_nationkey").alias("col_idx"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"), F.col("l_extendedprice").alias("value"),
    )
    return cellops.last_wins(obs).select("row_idx", "col_idx", "value")


LAST = """SELECT l_partkey AS row_idx, s_nationkey AS col_idx, l_extendedprice AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
QUALIFY row_number() OVER (PARTITION BY l_partkey, s_nationkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1"""


def collapse_duplicates(spark, sf):
    c = cellops.collapse(cellsets.line_observations(spark, sf))
    return c.select("row_idx", "col_idx", "n_dup", F.round(F.log("value"), 9).alias("log_value"), F.round(F.log("total_err"), 9).alias("log_err"), F.round("within_chi2", 5).alias("within_chi2"))


COLLAPSE = s.with_(s.CP) + """, m AS (SELECT row_idx, col_idx, count(*) AS n_dup, sum(value / (total_err * total_err)) / sum(1 / (total_err * total_err)) AS v,
 1 / sqrt(sum(1 / (total_err * total_err))) AS e FROM cp GROUP BY row_idx, col_idx)
SELECT row_idx, col_idx, any_value(n_dup) AS n_dup, round(ln(any_value(v)), 9) AS log_value, round(ln(any_value(e)), 9) AS log_err,
 CASE WHEN any_value(n_dup) = 1 THEN 0.0 ELSE round(sum(((value - v) / total_err) * ((value - v) / total_err)), 5) END AS within_chi2
FROM cp JOIN m USING (row_idx, col_idx) GROUP BY row_idx, col_idx"""


def matrix_summary(spark, sf):
    c = cellsets.priority_cells(spark, sf).withColumn("seq", F.col("n_obs"))
    out = cellops.matrix_summary(c)
    return out.select("matrix_id", "n_rows", "n_cols", "n_cells", *_rounded("min_value", "max_value", d=4), *_rounded("mean_rel_error", "fill_fraction", d=8))


SUMMARY = s.with_(s.CC) + """
SELECT matrix_id, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_cols, count(*) AS n_cells, round(min(value), 4) AS min_value,
 round(max(value), 4) AS max_value, round(avg(total_err / abs(value)), 8) AS mean_rel_error, round(count(*) / (count(DISTINCT row_idx) * count(DISTINCT col_idx)), 8) AS fill_fraction
FROM cc GROUP BY matrix_id"""


def weighted_mean(spark, sf):
    c = cellops.with_weights(cellsets.priority_cells(spark, sf))
    out = cellops.weighted_mean(c, ["matrix_id", "row_label"], F.col("value"), F.col("weight"))
    return out.select("matrix_id", "row_label", F.round("mean", 4).alias("mean"), F.round("mean_err", 4).alias("mean_err"))


WMEAN = s.with_(s.CC) + """
SELECT matrix_id, row_label, round(sum(value / (total_err * total_err)) / sum(1 / (total_err * total_err)), 4) AS mean,
 round(1 / sqrt(sum(1 / (total_err * total_err))), 4) AS mean_err FROM cc GROUP BY matrix_id, row_label"""


def ratio_columns(spark, sf):
    r = cellops.ratio_to_reference(cellsets.priority_cells(spark, sf))
    return r.select("matrix_id", "row_idx", "col_idx", *_rounded("ratio", "ratio_err", d=7))


RATIO = s.with_(s.CC) + """
SELECT c.matrix_id, c.row_idx, c.col_idx, round(c.value / r.value, 7) AS ratio,
 round(abs(c.value / r.value) * sqrt(power(r.total_err / r.value, 2) + power(c.total_err / c.value, 2)), 7) AS ratio_err
FROM cc c JOIN cc r ON c.matrix_id = r.matrix_id AND c.row_idx = r.row_idx AND r.col_idx = 0 WHERE c.col_idx <> 0"""


def mean_ratio(spark, sf):
    m = cellops.mean_ratio(cellops.ratio_to_reference(cellsets.priority_cells(spark, sf)))
    return m.select("matrix_id", "col_idx", F.round("mean_ratio", 7).alias("mean_ratio"), "n_ratios")


MEAN_RATIO = s.with_(s.CC) + """
SELECT c.matrix_id, c.col_idx, round(avg(c.value / r.value), 7) AS mean_ratio, count(*) AS n_ratios
FROM cc c JOIN cc r ON c.matrix_id = r.matrix_id AND c.row_idx = r.row_idx AND r.col_idx = 0 WHERE c.col_idx <> 0 GROUP BY c.matrix_id, c.col_idx"""


def coverage_checks(spark, sf):
    out = checks.coverage(cellsets.priority_cells(spark, sf))
    return out.select("matrix_id", "check", "passed", "message")


COVERAGE = s.with_(s.CC) + """, a AS (SELECT matrix_id, count(*) AS n, count(DISTINCT row_idx) AS r, count(DISTINCT col_idx) AS c FROM cc GROUP BY matrix_id)
SELECT matrix_id, 'data_coverage' AS check, n >= 20 AS passed, printf('%d observations, %dx%d matrix', n, r, c) AS message FROM a
UNION ALL SELECT matrix_id, 'matrix_completeness', n / (r * c) > 0.5, printf('%.4f of all cells are filled', n / (r * c)) FROM a
UNION ALL SELECT matrix_id, 'row_coverage', r >= 2, printf('%d rows with data', r) FROM a"""


def range_checks(spark, sf):
    c = cellsets.priority_cells(spark, sf)
    return checks.value_ranges(c.withColumn("value", F.col("value") / 250000).withColumn("total_err", F.col("total_err") / 250000)).select("matrix_id", "check", "passed")


RANGES = s.with_(s.CC) + """, a AS (SELECT matrix_id, min(value / 250000) AS lo, max(value / 250000) AS hi, avg(value / 250000) AS m, min(total_err / value) AS el,
 max(total_err / value) AS eh, avg(total_err / value) AS em FROM cc GROUP BY matrix_id)
SELECT matrix_id, 'physical_reasonability' AS check, lo > -1 AND hi < 5 AND m > 0.5 AND m < 2 AS passed FROM a
UNION ALL SELECT matrix_id, 'error_reasonability', el > 0.01 AND eh < 1 AND em > 0.05 FROM a
UNION ALL SELECT matrix_id, 'mean_near_one', m > 0.8 AND m < 1.2 FROM a"""


_TAGS = [("red", "warm"), ("ring", "round"), ("widget", "tool"), ("small", "little"), ("blue", "cold")]


def tag_first_match(spark, sf):
    part = cellsets.table(spark, sf, "part")
    return part.groupBy(wrangle.tag_first_match(F.concat_ws(" ", "p_name", "p_type"), _TAGS).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


TAG = "SELECT CASE " + " ".join(f"WHEN contains(lower(p_name || ' ' || p_type), '{a}') THEN '{b}'" for a, b in _TAGS) + " END AS tag, count(*) AS n FROM part GROUP BY 1"


def keyword_tables(spark, sf):
    """Documents whose source or text carries the keywords of a signal-strength table; some of them are given one."""
    d = cellsets.table(spark, sf, "documents")
    n = F.col("doc_id")
    source = F.concat(F.when(n % 5 == 0, F.lit("Mu_")).when(n % 11 == 0, F.lit("μ")).otherwise(F.lit("")), "source")
    text = F.concat("text", F.when(n % 7 == 0, F.lit(" Signal Strength")).when(n % 13 == 0, F.lit(" PROD by decay")).when(n % 17 == 0, F.lit(" prod")).otherwise(F.lit("")))
    return d.filter(wrangle.has_keywords(source, text)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


KEYWORDS = """SELECT lang, count(*) AS n FROM (SELECT lang, CASE WHEN doc_id % 5 = 0 THEN 'Mu_' WHEN doc_id % 11 = 0 THEN 'μ' ELSE '' END || source AS source,
 text || CASE WHEN doc_id % 7 = 0 THEN ' Signal Strength' WHEN doc_id % 13 = 0 THEN ' PROD by decay' WHEN doc_id % 17 = 0 THEN ' prod' ELSE '' END AS text FROM documents) WHERE contains(lower(text), 'signal strength') OR contains(lower(source), 'mu_') OR contains(source, 'μ')
 OR (contains(lower(text), 'prod') AND contains(lower(text), 'decay')) OR contains(lower(text), 'coupling') GROUP BY lang"""


def wide_to_cells(spark, sf):
    """A wide table (brand x order of magnitude columns) unpivoted into tagged cells."""
    part = cellsets.table(spark, sf, "part")
    wide = part.groupBy("p_brand").agg(
        F.avg("p_retailprice").alias("price_gamma"), F.avg(F.col("p_size").cast("double")).alias("size_tau"), F.max("p_size").cast("string").alias("max_bb"),
        F.min("p_name").alias("note_mu"),
    )
    out = wrangle.wide_to_cells(
        wide, "p_brand", ["price_gamma", "size_tau", "max_bb", "note_mu"], [("brand#1", "one"), ("brand#2", "two"), ("brand#", "other")], wrangle.COLUMN_HEADER_MODES
    )
    out = out.groupBy("row_label", "col_label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.sum("total_err").alias("e"))
    return cellops.display_names(out, "col_label", wrangle.DISPLAY_NAMES).select("row_label", "col_label", "n", F.round("v", 5).alias("v"), F.round("e", 5).alias("e"))


WIDE = """WITH w AS (SELECT p_brand, avg(p_retailprice) AS a, avg(p_size) AS b, CAST(max(p_size) AS DOUBLE) AS c FROM part GROUP BY p_brand),
l AS (SELECT p_brand, 'γγ' AS col_label, a AS v FROM w UNION ALL SELECT p_brand, 'ττ', b FROM w UNION ALL SELECT p_brand, 'bb̄', c FROM w)
SELECT CASE WHEN contains(lower(p_brand), 'brand#1') THEN 'one' WHEN contains(lower(p_brand), 'brand#2') THEN 'two' ELSE 'other' END AS row_label, col_label,
 count(*) AS n, round(sum(v), 5) AS v, round(sum(0.1 * abs(v)), 5) AS e FROM l GROUP BY 1, 2"""


def single_measurement(spark, sf):
    """First part (by key) of every brand as a one-cell table: value-like column and default error."""
    part = cellsets.table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("signal_price"))
    return wrangle.single_measurement(part, "p_brand", "p_partkey").select("p_brand", *_rounded("value", "total_err", d=4))


SINGLE = """SELECT p_brand, round(p_retailprice, 4) AS value, round(0.1 * p_retailprice, 4) AS total_err FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1"""


def source_priority(spark, sf):
    """Order years per priority level as competing sources: the first with more than 300 orders wins."""
    o = cellsets.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("matrix_id"), F.year("o_orderdate").alias("priority"),
        F.concat(F.lit("y"), F.year("o_orderdate")).alias("source"), "o_totalprice",
    )
    kept, lost = wrangle.source_priority(o, ["matrix_id"], 300)
    a = kept.groupBy("matrix_id", F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("kept"))
    b = lost.select("matrix_id", F.col("original_source").alias("name"), F.lit(None).cast("bigint").alias("n"), F.lit("passed over").alias("kind"))
    return a.unionByName(b)


PRIORITY = """WITH c AS (SELECT o_orderpriority AS matrix_id, year(o_orderdate) AS p, count(*) AS n FROM orders GROUP BY 1, 2),
w AS (SELECT matrix_id, min(p) AS wp FROM c WHERE n > 300 GROUP BY matrix_id)
SELECT matrix_id, 'y' || p AS name, n, 'kept' AS kind FROM c JOIN w USING (matrix_id) WHERE p = wp
UNION ALL SELECT matrix_id, 'y' || p, NULL, 'passed over' FROM c LEFT JOIN w USING (matrix_id) WHERE wp IS NULL OR p < wp"""


def tagged_union(spark, sf):
    """Two sources with different columns under one tag; the lists of sources per year."""
    o = cellsets.table(spark, sf, "orders").select(F.year("o_orderdate").alias("yr"), F.col("o_totalprice").alias("value"), "o_orderpriority")
    l = cellsets.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("yr"), F.col("l_extendedprice").alias("value"), "l_returnflag")
    u = wrangle.tagged_union({"orders": o, "lines": l})
    n = u.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.count("l_returnflag").alias("n_flags"))
    inc = wrangle.included(u, ["yr"], "source").select("yr", F.concat_ws(",", "included").alias("included"))
    return n.join(inc, "yr")


UNION = """WITH u AS (SELECT year(o_orderdate) AS yr, 'orders' AS source, NULL AS flag FROM orders UNION ALL SELECT year(l_shipdate), 'lines', l_returnflag FROM lineitem)
SELECT yr, count(*) AS n, count(flag) AS n_flags, array_to_string(list_sort(list(DISTINCT source)), ',') AS included FROM u GROUP BY yr"""


def canonical_order(spark, sf):
    c = cellsets.order_value_cells(spark, sf)
    canon = wrangle.ordered_labels(spark, ["MACHINERY", "BUILDING", "NOWHERE"])
    return cellops.canonical_order(c, "col_label", canon)


CANON = s.with_(s.CA) + """, l AS (SELECT DISTINCT matrix_id, col_label AS label FROM ca)
SELECT matrix_id, label, CAST(row_number() OVER (PARTITION BY matrix_id ORDER BY CASE label WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, label) - 1 AS INTEGER) AS idx FROM l"""


def evenly_spaced(spark, sf):
    c = cellsets.priority_cells(spark, sf)
    return wrangle.evenly_spaced(c, ["matrix_id"], "row_idx", 5).select("matrix_id", "row_idx", "col_idx", F.round("value", 4).alias("value"))


EVEN = s.with_(s.CC) + """
SELECT matrix_id, row_idx, col_idx, round(value, 4) AS value FROM cc JOIN (SELECT matrix_id, max(row_idx) AS m FROM cc GROUP BY matrix_id) USING (matrix_id)
WHERE row_idx IN (floor(0 * m / 4), floor(1 * m / 4), floor(2 * m / 4), floor(3 * m / 4), m)"""


ENTRIES = {
    "cells_errors": (cells_errors, CELLS),
    "cells_cut_counts": (cells_cut_counts, CUTS),
    "cut_and_bin": (cut_and_bin, CUT_BIN),
    "label_index": (label_index, LABEL_INDEX),
    "dense_grid": (dense_grid, GRID),
    "dense_pivot": (dense_pivot, PIVOT),
    "last_wins": (last_wins, LAST),
    "collapse_duplicates": (collapse_duplicates, COLLAPSE),
    "matrix_summary": (matrix_summary, SUMMARY),
    "weighted_mean": (weighted_mean, WMEAN),
    "ratio_columns": (ratio_columns, RATIO),
    "mean_ratio": (mean_ratio, MEAN_RATIO),
    "coverage_checks": (coverage_checks, COVERAGE),
    "range_checks": (range_checks, RANGES),
    "tag_first_match": (tag_first_match, TAG),
    "keyword_tables": (keyword_tables, KEYWORDS),
    "wide_to_cells": (wide_to_cells, WIDE),
    "single_measurement": (single_measurement, SINGLE),
    "source_priority": (source_priority, PRIORITY),
    "tagged_union": (tagged_union, UNION),
    "canonical_order": (canonical_order, CANON),
    "evenly_spaced": (evenly_spaced, EVEN),
}
