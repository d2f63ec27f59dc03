"""Queries on singular values and on stored observations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crossfactor.operators import spectrum
from crossfactor.plans import cellsets
from crossfactor.registry import sqltext as s
from crossfactor.session import ensure_checkpoint_dir
from crossfactor.sources import observations


def _gram(src: str, value: str) -> list[str]:
    return [
        s.cte("x", f"SELECT matrix_id, row_idx, col_idx, {value} AS x FROM {src}"),
        s.cte("g1", "SELECT a.matrix_id, a.col_idx AS i, b.col_idx AS j, sum(a.x * b.x) AS g FROM x a JOIN x b USING (matrix_id, row_idx) GROUP BY 1, 2, 3"),
        # missing pairs of columns are zeros of the matrix
        s.cte("g0", "SELECT matrix_id, p.i, q.j, coalesce(g, 0.0) AS g FROM (SELECT DISTINCT matrix_id, i FROM g1) p JOIN (SELECT DISTINCT matrix_id, j FROM g1) q USING (matrix_id) LEFT JOIN g1 USING (matrix_id, i, j)"),
    ]


def _leading(g: str, p: str, squarings: int) -> list[str]:
    """Leading eigenvector ``{p}v`` and eigenvalue ``{p}l`` of ``g`` by repeated squaring."""
    out, last = [], g
    for m in range(squarings):
        out.append(s.cte(f"{p}b{m}", f"SELECT matrix_id, i, j, t / sum(CASE WHEN i = j THEN t END) OVER (PARTITION BY matrix_id) AS g FROM (SELECT a.matrix_id, a.i, b.j, sum(a.g * b.g) AS t FROM {last} a JOIN {last} b ON a.matrix_id = b.matrix_id AND a.j = b.i GROUP BY 1, 2, 3)"))
        last = f"{p}b{m}"
    out.append(s.cte(f"{p}v", f"SELECT matrix_id, i, g / sqrt(sum(g * g) OVER (PARTITION BY matrix_id)) AS v FROM {last} JOIN (SELECT matrix_id, arg_max(i, g) AS j FROM {last} WHERE i = j GROUP BY 1) USING (matrix_id, j)"))
    out.append(s.cte(f"{p}l", f"SELECT m.matrix_id, sum(a.v * m.g * b.v) AS l FROM {g} m JOIN {p}v a ON m.matrix_id = a.matrix_id AND m.i = a.i JOIN {p}v b ON m.matrix_id = b.matrix_id AND m.j = b.i GROUP BY 1"))
    return out


def _deflated(g: str, p: str, out: str) -> str:
    return s.cte(out, f"SELECT m.matrix_id, m.i, m.j, m.g - l.l * a.v * b.v AS g FROM {g} m JOIN {p}l l USING (matrix_id) JOIN {p}v a ON m.matrix_id = a.matrix_id AND m.i = a.i JOIN {p}v b ON m.matrix_id = b.matrix_id AND m.j = b.i")


def large_spectrum(spark, sf):
    """Seven largest singular values of (part x supplier nation), in the form for matrices beyond one task."""
    out = spectrum.singular_values(cellsets.line_observations(spark, sf), 7, group_max_cells=20_000)
    return out.select("matrix_id", "k", F.round("s", 4).alias("s"))


#: Lines of one cell are one equivalent observation: weighted mean over its error.
_CELLS = s.cte("ce", "SELECT matrix_id, row_idx, col_idx, sum(value / (total_err * total_err)) / sqrt(sum(1.0 / (total_err * total_err))) AS z FROM cp GROUP BY 1, 2, 3")
_SEVEN = [x for k in range(1, 8) for x in (*_leading(f"g{'0' if k == 1 else f'd{k - 1}'}", f"k{k}", 14), _deflated(f"g{'0' if k == 1 else f'd{k - 1}'}", f"k{k}", f"gd{k}"))]
LARGE = s.with_(s.CP, _CELLS, _gram("ce", "z"), _SEVEN) + " UNION ALL ".join(f"SELECT matrix_id, CAST({k} AS INTEGER) AS k, round(sqrt(l), 4) AS s FROM k{k}l" for k in range(1, 8))


def condition_number(spark, sf):
    """Largest over smallest singular value of the weighted matrices."""
    sv = spectrum.singular_values(cellsets.priority_cells(spark, sf), 7)
    return spectrum.condition_number(sv).select("matrix_id", F.round("condition_number", 4).alias("condition_number"))


# the smallest value of g is the leading one of (largest - g)
_SHIFTED = s.cte("sh", "SELECT matrix_id, i, j, CASE WHEN i = j THEN l ELSE 0.0 END - g AS g FROM g0 JOIN topl USING (matrix_id)")
CONDITION = s.with_(s.CC, _gram("cc", "value / total_err"), _leading("g0", "top", 14), _SHIFTED, _leading("sh", "low", 24)) + """
SELECT matrix_id, round(sqrt(t.l / (t.l - b.l)), 4) AS condition_number FROM topl t JOIN lowl b USING (matrix_id)"""


def observation_store(spark, sf):
    """The matrices of all suppliers written to a store, read back whole, and again with two of them named."""
    cells = cellsets.supplier_cells(spark, sf).withColumn("seq", F.col("row_idx").cast("long") * 1000 + F.col("col_idx"))
    path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    observations.write_observations(cells, path)
    named = observations.read_observations(spark, path, ["7", "42"]).groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n_named"))
    back = observations.read_observations(spark, path).groupBy("matrix_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") / 1000), 6).alias("thousands"), F.sum("stat_err").alias("stat_err"),
        F.max("row_label").alias("last_row"),
    )
    return back.join(named, "matrix_id", "left").fillna({"n_named": 0})


STORE = s.with_(s.CS) + """SELECT matrix_id, count(*) AS n, round(sum(value / 1000), 6) AS thousands, 0.0::DOUBLE AS stat_err, max(row_label) AS last_row,
 CASE WHEN matrix_id IN ('7', '42') THEN count(*) ELSE 0 END AS n_named FROM cs GROUP BY matrix_id"""


ENTRIES = {
    "large_spectrum": (large_spectrum, LARGE),
    "condition_number": (condition_number, CONDITION),
    "observation_store": (observation_store, STORE),
}
