"""Near-duplicate vectors: p-stable hashing of unit vectors into tables of buckets, then exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm import tiles
from crossfactor.llm.components import components
from crossfactor.llm.tables import table
from crossfactor.session import cut

#: Width of a quantised projection; rows of one piece of a bucket.
WIDTH, PIECE = 1.5, 512


def collision(width: float, distance: float) -> float:
    """Chance that one Gaussian projection of two points at this distance falls into the same cell."""
    u = width / distance
    phi = 0.5 * math.erfc(u / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * u) * (1 - math.exp(-u * u / 2))


def plan(n: int, min_cosine: float, recall: float = 0.99, width: float = WIDTH) -> tuple[int, int]:
    """Projections per table and tables: unrelated vectors (at right angles) meet about once a table, links at the
    threshold are found with the given chance, closer ones oftener."""
    near, far = collision(width, math.sqrt(max(2 - 2 * min_cosine, 1e-12))), collision(width, math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(near**k, 1 - 1e-12))))


def cells(x: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """Bucket number of every row in every table, ``[rows, tables]``."""
    rng = np.random.default_rng([seed, x.shape[1], k, tables])
    a = rng.standard_normal((x.shape[1], k * tables))
    b = rng.random(k * tables) * width
    mix = rng.integers(1, 1 << 62, k * tables, dtype=np.int64) | 1
    at = np.floor((x @ a + b) / width).astype(np.int64)
    return (at * mix).reshape(len(x), tables, k).sum(axis=2)


def link_vectors(vectors: DataFrame, min_cosine: float = 0.98, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``(vec_id, embedding, label)``.

    Vectors are compared when their labels are equal and not null (and their lengths are equal) and linked at a cosine
    of ``min_cosine`` or more, in double precision. Null, zero and empty vectors and those with null or non-finite parts
    link with nothing, nor does a row without an id. Equal vectors under one label are one point with a weight, so
    copies cost one row; each is linked to all others. A row repeated under its own id counts as another vector.
    ``n_links`` counts the links found; every one is exact, and one at the threshold is found with chance ``recall``.
    """
    parts, kind = F.col("embedding"), vectors.schema["embedding"].dataType.elementType
    good = F.coalesce((F.size(parts) > 0) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(parts, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are the same direction
    # vectors travel in their own type and are made double where they are compared
    rows = vectors.select("vec_id", F.transform(parts, lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x)).alias("v"), "label", (good & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("ok"))
    rows = rows.withColumn("key", F.when(F.col("ok"), F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64("v", "label", F.lit(1)).alias("b"))))
    points = cut(rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("key").alias("key")))
    widest = points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    k, n_tables = plan(widest, min_cosine, recall)

    @F.pandas_udf("array<long>")
    def buckets(vs: pd.Series) -> pd.Series:
        out: list = [None] * len(vs)
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vs):
            by.setdefault(len(v), []).append(i)
        for at in by.values():
            x = np.array([vs.iloc[i] for i in at], np.float64)
            for i, c in zip(at, cells(_unit(x), k, n_tables, WIDTH, seed)):
                out[i] = c
        return pd.Series(out)

    placed = points.withColumn("keys", buckets("v")).select("label", "v", "rep", "m", "keys", F.posexplode("keys").alias("t", "k"))
    placed = placed.withColumn("d", F.size("v"))

    def compare(t: pa.Table) -> pa.Table:
        tile, own, a, b = (t.column(c).to_numpy() for c in ("_tile", "_own", "_a", "_b"))
        rep, m, nth = (t.column(c).to_numpy() for c in ("rep", "m", "t"))
        starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        flat, dims = t.column("v").combine_chunks(), t.column("d").to_numpy()
        values, begin = np.asarray(flat.values), np.asarray(flat.offsets)
        found = np.asarray(t.column("keys").combine_chunks().values).reshape(len(rep), n_tables)
        ids, links, roots = [], [], []
        for s, e in zip(starts.tolist(), np.r_[starts[1:], len(tile)].tolist()):
            if e - s < 2:
                continue
            d = dims[s]
            x = _unit(values[begin[s] : begin[s] + d * (e - s)].astype(np.float64).reshape(e - s, d))
            near = (x @ x.T) >= min_cosine
            if a[s] != b[s]:
                near &= own[s:e, None] != own[None, s:e]
            np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            # a pair counts in the first table where it meets, so nothing has to be made distinct afterwards
            first = (found[s + i] == found[s + j]).argmax(axis=1) == nth[s]
            i, j = i[first], j[first]
            if not len(i):
                continue
            n = np.bincount(i, weights=m[s + j], minlength=e - s).astype(np.int64)
            label = tiles.local_components(e - s, i, j)
            hit = np.flatnonzero(n)
            ids.append(rep[s + hit])
            links.append(n[hit])
            roots.append(rep[s + label[hit]])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"rep": cat(ids), "n": cat(links), "root": cat(roots)})

    bucket = ["label", "d", "t", "k"]
    links = cut(tiles.map_tiles(tiles.tile_rows(placed, bucket, "rep", PIECE), bucket, compare, "rep long, n long, root long", 4_000))
    found = components(links, "rep", "root")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    named = points.select("key", "rep", "m").join(counts, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    named = cut(named.select("key", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    # the key of a point is 128 bits of its label and parts; a row that is not compared has none
    out = rows.select("vec_id", "key").join(named, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
