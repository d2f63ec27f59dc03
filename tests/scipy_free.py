"""Dense second opinions in plain numpy."""

import numpy as np


def dense_gls(r, c, y, cov, rank: int, rounds: int) -> float:
    """Generalised alternating least squares on one table; the cost after so many rounds."""
    w = np.linalg.inv(np.linalg.cholesky(cov))
    n_rows, n_cols = r.max() + 1, c.max() + 1

    def half(known, k, g, size, rk):
        a = np.zeros((len(y), size * rk))
        for q in range(rk):
            a[np.arange(len(y)), g * rk + q] = known[k, q]
        return np.linalg.lstsq(w @ a, w @ y, rcond=None)[0].reshape(size, rk)

    v = np.ones((n_cols, 1))
    for rk in range(1, rank + 1):
        if rk == 2:
            v = np.concatenate([v, np.sin(1.0 + np.arange(n_cols))[:, None]], axis=1)
        for _ in range(rounds):
            u = half(v, c, r, n_rows, rk)
            v = half(u, r, c, n_cols, rk)
    res = w @ (y - np.sum(u[r] * v[c], axis=1))
    return float(res @ res)
