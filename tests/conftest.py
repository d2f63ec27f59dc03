from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crossfactor.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def frame(spark, tables: dict[str, tuple]):
    """Cells of several dense tables given as (values, errors); NaN marks a missing cell."""
    parts = []
    for name, (y, e) in tables.items():
        r, c = np.nonzero(np.isfinite(y))
        parts.append(
            pd.DataFrame({"matrix_id": name, "row_idx": r.astype("int32"), "col_idx": c.astype("int32"), "value": y[r, c], "total_err": e[r, c]})
        )
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def noisy(m: np.ndarray, seed: int, share: float = 0.05, floor: float = 0.01):
    e = share * np.abs(m) + floor
    return m + e * np.random.default_rng(seed).standard_normal(m.shape), e


@pytest.fixture(scope="session")
def synthetic():
    """The synthetic shapes of the fixture list: rank one 5x4, rank two 6x5, sparse 8x6, exact 3x3."""
    u, v = np.array([1, 0.9, 1.1, 0.95, 1.05]), np.array([1, 0.8, 0.6, 0.4])
    m1 = np.outer(u, v / np.linalg.norm(v))
    rng = np.random.default_rng(123)
    m2 = rng.standard_normal((6, 2)) @ np.linalg.qr(rng.standard_normal((5, 2)))[0].T
    rng = np.random.default_rng(456)
    m3 = np.outer(rng.random(8) + 0.5, rng.random(6) + 0.5)
    hole = rng.random(m3.shape) > 0.6
    hole[:, 0] = hole[0, :] = False
    y3, e3 = noisy(m3, 3)
    y3[hole] = np.nan
    exact = np.outer([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])
    return {
        "rank1": (*noisy(m1, 42), m1), "rank2": (*noisy(m2, 7), m2), "sparse": (y3, e3, m3),
        "exact": (exact, np.full_like(exact, 0.1), exact),
    }


def dense_als(y: np.ndarray, e: np.ndarray, rank: int, rounds: int = 500, ridge: float = 1e-8):
    """Plain loop over rows and columns of one table: the second opinion for small groups."""
    s = np.sqrt(np.nanmean(y * y))
    y, e = y / s, e / s
    ok = np.isfinite(y)
    w = np.where(ok, 1 / (e * e + ridge), 0.0)
    z = np.where(ok, y, 0.0)
    v = np.linalg.svd(z)[2][:rank].T.copy()
    u = np.zeros((len(y), rank))
    for _ in range(rounds):
        for i in range(len(y)):
            u[i] = np.linalg.solve((v * w[i][:, None]).T @ v + ridge * np.eye(rank), v.T @ (w[i] * z[i]))
        for j in range(y.shape[1]):
            v[j] = np.linalg.solve((u * w[:, j][:, None]).T @ u + ridge * np.eye(rank), u.T @ (w[:, j] * z[:, j]))
    return float(np.sum(np.where(ok, ((z - u @ v.T) / e) ** 2, 0.0))), (u @ v.T) * s
