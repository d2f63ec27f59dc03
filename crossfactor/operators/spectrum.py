"""Singular values of many weighted, zero-filled matrices, and of one very large one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from crossfactor.functions.noise import hashed_uniform
from crossfactor.operators.cells import collapse
from crossfactor.operators.fit import _Layout, per_key, split_by_size
from crossfactor.schemas import key_columns
from crossfactor.session import cut


def singular_values(
    obs: DataFrame, k: int, weighted: bool = True, rounds: int = 100, group_max_cells: int = 1_000_000, tol: float = 1e-9
) -> DataFrame:
    """The ``k`` largest singular values per key as rows (k, s, settled).

    Bounded matrices in one task each; larger ones by block iteration over all keys at once, until no wanted value of a
    matrix moves by more than ``tol`` of its largest one or ``rounds`` are over (``settled`` false).
    """
    keys = key_columns(obs)
    cells = collapse(obs)
    x = F.col("value") / F.col("total_err") if weighted else F.col("value")
    cells = cut(cells.select(*keys, "row_idx", "col_idx", x.alias("x")))
    small, large, _ = split_by_size(cells, group_max_cells)
    schema = T.StructType([small.schema[c] for c in keys] + [T.StructField("k", T.IntegerType()), T.StructField("s", T.DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        _, r = np.unique(pdf["row_idx"], return_inverse=True)
        _, c = np.unique(pdf["col_idx"], return_inverse=True)
        m = np.zeros((r.max() + 1, c.max() + 1))
        m[r, c] = pdf["x"]
        s = np.linalg.svd(m, compute_uv=False)[:k]
        return pd.DataFrame({**{c_: [pdf[c_].iloc[0]] * len(s) for c_ in keys}, "k": np.arange(1, len(s) + 1, dtype=np.int32), "s": s})

    out = small.groupBy(*keys).applyInPandas(one, schema).withColumn("settled", F.lit(True))
    return out if large is None else out.unionByName(_by_blocks(large, keys, k, rounds, tol))


#: Directions below this share of the largest squared singular value of a block count as zero.
_NEGLIGIBLE = 1e-14
#: Bytes of turns that are sent to every task.
_TURNS = 32 << 20
#: Most columns for which a block is made as wide as the matrix.
_WIDEST = 64


def _by_blocks(cells: DataFrame, keys: list[str], k: int, rounds: int, tol: float) -> DataFrame:
    """Subspace iteration with a block of random vectors, one array per row or column.

    The block has 2k + 8 vectors, or as many as there are columns where that is at most ``_WIDEST``: then it spans the
    matrix and the first round has all values.
    A half-step multiplies the stored cells with the whole block; the block is made orthonormal from its Gram matrix,
    the only thing that is gathered (one small matrix per key). The Gram matrix of the other half-step holds the values.
    Matrices that have settled leave the loop.
    """
    cols = cut(cells.select(*keys, "col_idx").distinct())
    n_cols = cols.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    width = n_cols if 2 * k + 8 < n_cols <= _WIDEST else 2 * k + 8
    most = _TURNS // (8 * width * width)
    layout = _Layout(cells, keys, 0)
    block = cols.select(*keys, "col_idx", F.array(*[hashed_uniform("block", F.col("col_idx"), i) - 0.5 for i in range(width)]).alias("f"))

    def times(f: DataFrame, known: str, wanted: str) -> DataFrame:
        sums = [F.sum(F.col("x") * F.col("f")[i]).alias(f"_{i}") for i in range(width)]
        g = layout.gather(f, known).groupBy(*keys, wanted).agg(*sums)
        return g.select(*keys, wanted, F.array(*[f"_{i}" for i in range(width)]).alias("f"))

    def turned(f: DataFrame, idx: str, basis: DataFrame) -> DataFrame:
        dot = lambda c: F.aggregate(F.zip_with(c, "f", lambda p, q: p * q), F.lit(0.0), lambda s, q: s + q)
        return f.join(per_key(basis.select(*keys, "turn"), layout.n_keys, most), keys).select(*keys, idx, F.transform("turn", dot).alias("f"))

    found, before = [], None
    for it in range(1, rounds + 1):
        u = cut(times(block, "col_idx", "row_idx"))
        ub = cut(_basis(u, keys, width))
        v = cut(times(turned(u, "row_idx", ub), "row_idx", "col_idx"))
        vb = cut(_basis(v, keys, width).join(ub.select(*keys, F.col("n").alias("n_rows")), keys))
        now = vb.select(*keys, F.slice("s", 1, k).alias("s"), F.least(F.lit(k), F.col("n"), F.col("n_rows")).alias("m"))
        if before is not None:
            moved = F.array_max(F.zip_with("s", "_s", lambda p, q: F.abs(p - q)))
            now = now.join(before, keys).withColumn("settled", moved <= tol * F.col("s")[0]).drop("_s")
        else:
            now = now.withColumn("settled", F.lit(False))
        now = cut(now)
        leave = F.col("settled") | F.lit(it == rounds)
        n_leave, n_all = now.agg(F.count_if(leave), F.count(F.lit(1))).first()
        if n_leave:
            found.append(now.filter(leave))
        if n_leave == n_all:
            break
        stay = now.filter(~leave)
        before = stay.select(*keys, F.col("s").alias("_s"))
        block = turned(v, "col_idx", vb.join(layout.per_key(stay.select(*keys)), keys, "left_semi"))
    layout.release()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = out.select(*keys, "settled", F.posexplode(F.expr("slice(s, 1, m)")).alias("k", "s"))
    return out.select(*keys, (F.col("k") + 1).alias("k"), "s", "settled")


def _basis(f: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Per key the turn that makes the block orthonormal (a list of columns), its singular values in order, and its length.

    Tasks add up the Gram matrix of what they read; a key then has one small matrix per task that held it.
    """
    schema = T.StructType([f.schema[c] for c in keys])
    gram = T.StructType([*schema.fields, T.StructField("n", T.LongType()), T.StructField("g", T.ArrayType(T.DoubleType()))])
    turn = T.StructType(
        [*schema.fields, T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType())),
         T.StructField("turn", T.ArrayType(T.ArrayType(T.DoubleType())))]
    )

    def flush(held: dict) -> pd.DataFrame:
        rows = [(*key, n, g.ravel()) for key, (n, g) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=[*keys, "n", "g"])

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                m = np.stack(part["f"].to_numpy())
                n, g = held.get(key, (0, 0.0))
                held[key] = (n + len(m), g + m.T @ m)
            if len(held) > 1000:
                yield flush(held)
        yield flush(held)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.sum(np.stack(pdf["g"].to_numpy()), axis=0).reshape(width, width)
        lam, q = np.linalg.eigh(g)
        lam, q = lam[::-1], q[:, ::-1]
        real = lam > _NEGLIGIBLE * max(lam[0], 0.0)
        s = np.sqrt(np.where(real, lam, 0.0))
        t = np.where(real, q / np.where(real, s, 1.0), 0.0)
        row = [*(pdf[c].iloc[0] for c in keys), int(pdf["n"].sum()), s, [c for c in t.T]]
        return pd.DataFrame([row], columns=[*keys, "n", "s", "turn"])

    return f.mapInPandas(partial, gram).groupBy(*keys).applyInPandas(solve, turn)


def explained_ratio(spectrum: DataFrame, rank: int) -> DataFrame:
    """Share of squared singular values in the first ``rank``; 1 when all are zero."""
    keys = key_columns(spectrum)
    sq = F.col("s") * F.col("s")
    g = spectrum.groupBy(*keys).agg(F.sum(sq).alias("_t"), F.sum(F.when(F.col("k") <= rank, sq).otherwise(0.0)).alias("_e"))
    return g.select(*keys, F.when(F.col("_t") > 0, F.col("_e") / F.col("_t")).otherwise(1.0).alias("explained"))


def condition_number(spectrum: DataFrame, floor: float = 1e-10) -> DataFrame:
    keys = key_columns(spectrum)
    return spectrum.groupBy(*keys).agg((F.max("s") / F.greatest(F.min("s"), F.lit(floor))).alias("condition_number"))
