"""Compare the members of many buckets with each other, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfactor.llm.tables import join_small, partitions


def tile_rows(rows: DataFrame, bucket: list[str], spread: str, most: int, weight: str | None = None, most_weight: int = 1) -> DataFrame:
    """Gives every row the tiles ``(_a, _b)`` of its bucket in which it takes part, and its own piece ``_own``.

    A bucket of up to ``most`` rows is one tile. A larger one is cut into pieces by a hash of ``spread``, and each
    two pieces (and each piece with itself) meet in a tile of their own: every pair of rows meets in exactly one tile,
    and no task ever holds a bucket whole. With ``weight`` (say, bytes) a bucket is also cut where its weights add up to
    more than ``most_weight``.
    """
    pieces = F.ceil(F.count(F.lit(1)) / F.lit(most))
    if weight:
        pieces = F.greatest(pieces, F.least(F.count(F.lit(1)), F.ceil(F.sum(weight) / F.lit(most_weight))))
    large = rows.groupBy(*bucket).agg(pieces.cast("int").alias("_g")).where(F.col("_g") > 1)
    out = join_small(rows, large, bucket, "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    out = out.withColumn("_own", F.pmod(F.xxhash64(F.col(spread)), F.col("_g")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return out.withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other")).drop("_g", "_other")


def _changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's tile is another than that of the row before it, by all key columns."""
    out = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        c = t.column(k)
        out |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy()
    return out


def map_tiles(tiled: DataFrame, bucket: list[str], fn: Callable[[pa.Table], pa.Table], schema: str, batch: int = 20_000, batch_bytes: int = 64 << 20) -> DataFrame:
    """Runs ``fn`` on tables made of whole tiles, sorted by tile, with the tile's number within the table in ``_tile``.

    Tiles are bounded, so a table holds at most ``batch`` rows or ``batch_bytes`` and one tile more. Bucket columns are
    not null.
    """
    keys = [*bucket, "_a", "_b"]
    n = partitions(tiled.sparkSession)
    dealt = tiled.repartition(n, *keys).sortWithinPartitions(*keys, "_own")

    def numbered(t: pa.Table) -> pa.Table:
        return t.append_column("_tile", pa.array(np.cumsum(np.r_[False, _changes(t, keys)]), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            size += b.nbytes
            if rows < batch and size < batch_bytes:
                continue
            whole = pa.Table.from_batches(held)
            ends = np.flatnonzero(_changes(whole, keys))
            if not len(ends):
                continue
            cut_at = int(ends[-1]) + 1
            yield from fn(numbered(whole.slice(0, cut_at))).to_batches()
            held = whole.slice(cut_at).combine_chunks().to_batches()
            rows, size = whole.num_rows - cut_at, sum(x.nbytes for x in held)
        if rows:
            yield from fn(numbered(pa.Table.from_batches(held))).to_batches()

    return dealt.mapInArrow(run, schema)


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each of ``n`` nodes' component under the links ``i``-``j``: a forest in place of all pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
