"""Queries on sums that do not depend on the layout of rows: each is computed from two layouts and compared by its bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfactor.operators import exactsum, fit as fitops
from crossfactor.plans import cellsets
from crossfactor.registry import sqltext as s
from crossfactor.registry.fits import FIXED1


def _two_layouts(df, by, column, make):
    """``make`` on the rows as they lie and on rows dealt out by another column; null-safe on the bits of each result."""
    first, second = make(df), make(df.repartition(F.col(column)))
    names = [c for c in first.columns if c not in by]
    other = second.select(*by, F.struct(*names).alias("_other"))
    return first.join(other, by).withColumn("same", F.struct(*names).eqNullSafe(F.col("_other"))).drop("_other")


#: Digits of a sum below 2^26 down to 2^-36: all of them for sums over 2^16.
_BITS = 68719476736.0


def exact_revenue(spark, sf):
    """What every supplier was charged, added exactly, with a hash of the digits."""
    line = cellsets.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice", "l_discount", "l_tax")
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    out = _two_layouts(line, ["l_suppkey"], "l_orderkey", lambda d: exactsum.exact_sums(d, ["l_suppkey"], {"charge": charge}))
    return out.select("l_suppkey", "charge", F.md5((F.col("charge") * _BITS).cast("long").cast("string")).alias("digits"), "same")


# the same sum in whole multiples of 2^-64, read back from its three 32-bit digits
EXACT_REVENUE = """WITH x AS (SELECT l_suppkey, sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 18446744073709551616.0 AS HUGEINT)) AS n FROM lineitem GROUP BY 1),
d AS (SELECT l_suppkey, CAST(n % 4294967296 AS DOUBLE) / 18446744073709551616.0 + CAST((n // 4294967296) % 4294967296 AS DOUBLE) / 4294967296.0
 + CAST(n // 18446744073709551616 AS DOUBLE) AS charge FROM x)
SELECT l_suppkey, charge, md5(CAST(CAST(trunc(charge * 68719476736.0) AS BIGINT) AS VARCHAR)) AS digits, true AS same FROM d"""


def exact_moments(spark, sf):
    """Count, mean and squares about the mean of order values per priority, from exact sums."""
    o = cellsets.table(spark, sf, "orders").select("o_orderpriority", "o_custkey", "o_totalprice")
    make = lambda d: exactsum.exact_moments(d, ["o_orderpriority"], F.col("o_totalprice"), F.lit(150000.0))
    out = _two_layouts(o, ["o_orderpriority"], "o_custkey", make)
    return out.select("o_orderpriority", "n", F.round("mean", 6).alias("mean"), F.round(F.col("m2") / 1e9, 5).alias("m2_billions"), "same")


EXACT_MOMENTS = """SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean,
 round(var_pop(o_totalprice) * count(o_totalprice) / 1e9, 5) AS m2_billions, true AS same FROM orders GROUP BY 1"""


def exact_chi2(spark, sf):
    """Chi-square of the rank-one fit of every priority, added exactly."""
    cells = cellsets.priority_cells(spark, sf)
    p = fitops.predict(cells, fitops.fit(cells, FIXED1, unique=True), 1)
    out = _two_layouts(p, ["matrix_id"], "col_idx", lambda d: exactsum.exact_chi2(d, ["matrix_id"]))
    return out.select("matrix_id", "n_cells", F.round("chi2", 6).alias("chi2"), "same")


EXACT_CHI2 = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6, 1)) + """
SELECT matrix_id, count(*) AS n_cells, round(sum(wc * r * r), 6) AS chi2, true AS same FROM f_r1 GROUP BY matrix_id"""


ENTRIES = {
    "exact_revenue": (exact_revenue, EXACT_REVENUE),
    "exact_moments": (exact_moments, EXACT_MOMENTS),
    "exact_chi2": (exact_chi2, EXACT_CHI2),
}
