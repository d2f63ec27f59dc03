"""Contiguous shards whose largest is as small as it can be."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm.tables import numbered, positions, table
from crossfactor.session import cut

#: Atomic groups: texts of equal leading checksum bits. A fixed number, so their sizes fit the driver at any scale.
GROUP_BITS = 16


def _greedy(prefix: np.ndarray, capacity: int, shards: int) -> bool:
    """Do the groups fit when each shard takes as many as its capacity holds?"""
    at = 0
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if at == len(prefix) - 1:
            return True
    return False


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[list[int], int]:
    """First group of each shard, and the least capacity with which the ordered groups fit into ``shards`` runs.

    The capacity is found by binary search with a greedy check. Under it, each cut goes where the shard comes nearest to
    an equal share of what is left, as far as the rest still fits; so no shard is left over almost empty.
    """
    n = len(sizes)
    prefix = np.r_[0, np.cumsum(np.asarray(sizes, np.int64))]
    total = int(prefix[-1])
    low, high = max(int(np.max(sizes, initial=0)), -(-total // shards)), max(total, 0)
    while low < high:
        mid = (low + high) // 2
        if _greedy(prefix, mid, shards):
            high = mid
        else:
            low = mid + 1
    reach = np.searchsorted(prefix, prefix + low, "right") - 1
    need = np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[reach[i]]
    at, starts = 0, []
    for k in range(shards):
        starts.append(at)
        left = shards - k - 1
        if not left:
            break
        ideal = prefix[at] + (total - prefix[at]) / (left + 1)
        j = int(np.searchsorted(prefix, ideal))
        if j > at and ideal - prefix[j - 1] <= prefix[min(j, n)] - ideal:
            j -= 1
        first = at + int(np.argmax(need[at : reach[at] + 1] <= left))  # need falls along the groups
        at = min(max(j, first, at), int(reach[at]))
    return starts, low


def assign(rows: DataFrame, shards: int = 40) -> DataFrame:
    """Adds ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` to rows that have ``doc_id``,
    ``_bytes`` (of the text, null: none) and ``_crc`` (its CRC-32, null for a null text).

    Law ``bytes``: shards are runs of atomic groups in the order of the checksum, cut for the least largest shard, so
    sizes are near equal. Equal texts share a checksum, hence a group and a shard; a group larger than an even share
    makes its shard as large as itself. Slots count from 0 in the order of checksum and id. No rows give no rows.
    """
    rows = rows.withColumn("size", F.coalesce("_bytes", F.lit(0)).cast("long") + 16)
    group = F.shiftright(F.coalesce("_crc", F.lit(0)), 32 - GROUP_BITS)
    sums = rows.groupBy(group.alias("g")).agg(F.sum("size").alias("n")).collect()  # at most 2 ** GROUP_BITS rows
    sizes = np.zeros(1 << GROUP_BITS, np.int64)
    for r in sums:
        sizes[r["g"]] = r["n"]
    starts, _ = minimax_cuts(sizes, shards)
    shard: Column = F.lit(0)
    for s in starts[1:]:
        shard = shard + (group >= F.lit(s)).cast("int")
    out = rows.select(*[c for c in rows.columns if c not in ("_bytes", "_crc")], F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), shard.alias("shard"))
    out = positions(out, [F.col("text_crc32").asc_nulls_first(), F.col("doc_id").asc_nulls_last()], ["shard"], "slot")
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


def _measured(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, "doc_id", F.octet_length("text").alias("_bytes"), F.crc32(F.col("text").cast("binary")).alias("_crc"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (and the other columns of ``assign``) joined to each row."""
    d, row = numbered(docs)
    plan = assign(_measured(d, row), shards).drop("doc_id")
    clash = [c for c in plan.columns if c in docs.columns]
    return d.drop(*clash).join(cut(plan), row).drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(_measured(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", F.coalesce("text_crc32", F.lit(0)).alias("text_crc32"), "law", "shard", "slot", "grown_shard")
