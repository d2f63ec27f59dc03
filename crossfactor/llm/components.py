"""Connected components of an edge table by alternating stars, with no component ever in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfactor.session import cut

#: Up to so many nodes with a smaller neighbour, their least ones are sent to every task in place of a shuffled join.
SENT = 100_000


def _least(edges: DataFrame) -> DataFrame:
    """``(n, m)``: the least neighbour of every larger end; stored, so that a join reads plain shuffles and can split a hub's rows."""
    return cut(edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every node of the edges, ``component`` being the least node reachable.

    Loops, repeated edges and either direction are allowed; edges with a null end are left out; no edges give no rows.
    In a round every node hands each larger neighbour its least neighbour (or itself), and then each smaller neighbour
    and itself the least of them. Each round is stored in the checkpoint folder. The rounds end when every larger end has
    one smaller neighbour, which has none itself: a star per component. Their number follows the data (a few for
    near-duplicates).
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(max_rounds):
        least = _least(e)
        n = least.count()
        send = F.broadcast if n <= SENT else lambda df: df
        if e.count() == n and e.join(send(least), F.col("v") == F.col("n"), "left_semi").isEmpty():
            break
        larger = e.join(send(least), F.col("v") == F.col("n"), "left").select("u", F.coalesce("m", "v").alias("v"))
        larger = larger if n <= SENT else cut(larger)
        # the larger ends are the same as before, so there are as many of them
        smaller = larger.join(send(_least(larger)), F.col("u") == F.col("n"))
        e = cut(smaller.select("m", F.explode(F.array("u", "v")).alias("u")).where("u > m").select("u", F.col("m").alias("v")).distinct())
    else:
        raise RuntimeError(f"components: no fixed point in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
