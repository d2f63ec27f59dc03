"""Near-duplicates by SimHash fingerprints, compared on vertical bit planes with carry-save counters."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm import tiles
from crossfactor.llm.components import components
from crossfactor.llm.tables import numbered, table
from crossfactor.session import cut

SEED = 42
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text whose words are in memory at once.
CHUNK = 1 << 20
#: Rows of one piece of a bucket, and the mean bucket size from which more bits go into a bucket's key.
PIECE, MEAN_BUCKET = 1024, 256


def _chunks(data: bytes):
    """Lists of words of bounded size; no word is cut."""
    at, end = 0, len(data)
    while at < end:
        stop = min(end, at + CHUNK)
        while stop < end and data[stop] not in _SPACE:
            stop += 1
        yield data[at:stop].split()
        at = stop


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The contract's 64-bit fingerprint of a whole text, unsigned; 0 for a text without words."""
    digest = xxhash.xxh64_intdigest
    ones, n, carry = np.zeros(64, np.int64), 0, []
    for words in _chunks((text or "").encode().lower()):
        words = carry + words
        carry = words[-(shingle - 1) :] if shingle > 1 else []
        if len(words) < shingle:
            continue
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size + 1) - 1
        start = stop - size
        h = np.array([digest(line[a:b], SEED) for a, b in zip(start[: len(words) - shingle + 1].tolist(), stop[shingle - 1 :].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    if not n:
        return digest(b" ".join(carry), SEED) if carry else 0
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row, ``fp`` the fingerprint's bits as a signed long; other columns are not read."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), fp(F.col(text)).alias("fp"))


def masks(n: int, radius: int) -> list[int]:
    """Bit masks such that any two fingerprints within the radius agree on all bits of one mask at least.

    With ``radius + k`` blocks of bits, ``k`` of them are free of differences; ``k`` grows with the number of
    fingerprints until a bucket of unrelated ones stays small. Nothing is missed for any ``k``.
    """
    for k in (1, 2, 3, 4):
        blocks = radius + k
        if k == 4 or n / 2.0 ** (64 * k // blocks) <= MEAN_BUCKET:
            edges = [round(64 * i / blocks) for i in range(blocks + 1)]
            part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
            return [sum(part[i] for i in c) for c in combinations(range(blocks), k)]
    raise AssertionError


def near_pairs(fp: np.ndarray, tile: np.ndarray, side: np.ndarray, split: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs ``i < j`` of the same tile within the radius (at most 7); in a split tile only across its sides.

    Rows are laid out in blocks of 64 lanes per tile, one word per block and bit plane. A query row meets a block by
    adding its differing bits, plane after plane, to three carry-save counter words that start at ``7 - radius``: the
    carry out of the third marks a lane beyond the radius. A block all of whose lanes are marked is abandoned.
    """
    n = len(fp)
    fp = fp.view(np.uint64)
    first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    size = np.diff(np.r_[first, n])
    blocks = -(-size // 64)
    base = np.cumsum(blocks) - blocks
    group = np.repeat(np.arange(len(first)), size)
    inside = np.arange(n) - first[group]
    place = base[group] * 64 + inside
    lanes = int(blocks.sum()) * 64
    held, row = np.zeros(lanes, np.uint64), np.full(lanes, -1, np.int64)
    held[place], row[place] = fp, np.arange(n)
    pack = lambda bits: np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    planes = [pack(((held >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)) for p in range(64)]
    right = np.zeros(lanes, np.uint8)
    right[place] = side
    right, valid = pack(right), pack((row >= 0).astype(np.uint8))

    own = inside // 64
    meets = blocks[group] - own
    out_i, out_j = [], []
    done = np.cumsum(meets)
    step, begin = 1 << 16, 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + step)))
        rows = np.arange(begin, end)
        begin = end
        q = np.repeat(rows, meets[rows])
        off = np.arange(len(q)) - np.repeat(np.cumsum(meets[rows]) - meets[rows], meets[rows])
        w = base[group[q]] + own[q] + off
        over = ~valid[w]
        own_block = off == 0
        lane = (inside[q[own_block]] % 64).astype(np.uint64)
        over[own_block] |= ONES >> (np.uint64(63) - lane)
        over |= np.where(split[q], ~(right[w] ^ np.where(side[q], ONES, np.uint64(0))), np.uint64(0))
        start = 7 - radius
        one, two, four = (np.full(len(q), ONES if start >> b & 1 else 0, np.uint64) for b in range(3))
        for p in range(64):
            if p % 8 == 0:
                live = over != ONES
                if not live.all():
                    q, w, over, one, two, four = (x[live] for x in (q, w, over, one, two, four))
                if not len(q):
                    break
            x = planes[p][w] ^ (np.uint64(0) - ((fp[q] >> np.uint64(p)) & np.uint64(1)))
            c = one & x
            one ^= x
            x = two & c
            two ^= c
            c = four & x
            four ^= x
            over |= c
        live = over != ONES
        if live.any():
            bits = np.unpackbits((~over[live]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(bits)
            out_i.append(q[live][at])
            out_j.append(row[w[live][at] * 64 + lane])
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def link_edges(reps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``(a, b)`` between the representatives ``(fp, rep)`` of distinct fingerprints.

    They connect just what is linked within the radius: each tile returns a forest of its links, not the pairs.
    """
    keys = masks(reps.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in keys]
    rows = reps.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])))
    rows = rows.select("fp", "rep", F.col("_m.t").alias("t"), F.col("_m.k").alias("k"))

    def forest(t: pa.Table) -> pa.Table:
        col = lambda c: t.column(c).to_numpy()
        split = col("_a") != col("_b")
        i, j = near_pairs(col("fp"), col("_tile"), (col("_own") == col("_b")) & split, split, radius)
        rep = col("rep")
        label = tiles.local_components(len(rep), i, j)
        far = np.flatnonzero(label != np.arange(len(rep)))
        return pa.table({"a": rep[far], "b": rep[label[far]]})

    return tiles.map_tiles(tiles.tile_rows(rows, ["t", "k"], "fp", PIECE), ["t", "k"], forest, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Two rows are linked when their fingerprints differ in at most ``radius`` bits (7 at most); ``component_id`` is the
    least id reachable. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows repeat.
    A row without an id is labelled like its fingerprint, but is no node: its component is null when no row of that
    fingerprint has an id. No rows give no rows. Copies meet in one fingerprint before any comparison, so a group of
    copies of any size costs one row; distinct fingerprints are compared in tiles of bounded size.
    """
    fps = cut(fingerprints(docs, shingle, doc_id, text))
    reps = cut(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(link_edges(reps, radius), "a", "b")
    named = cut(reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row of each group of near-duplicates, all columns kept: the one with the least id (nulls last).

    Rows are told apart by their place in ``docs``, so repeated ids and rows without an id are grouped by text alone.
    """
    d, row = numbered(docs)
    found = near_duplicates(d, radius, shingle, doc_id=row).select(F.col("doc_id").alias(row), "component_id")
    ids = found.join(d.select(row, "doc_id"), row)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("r")))
    kept = cut(ids.groupBy("component_id").agg(least.alias("x")).select(F.col("x.r").alias(row)))
    return d.join(kept, row, "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
