"""Correlated errors: blocks, whitening, generalised fits of both forms, correlated null draws."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from scipy_free import dense_gls

from crossfactor.operators import correlated, fit as fitops, ranktest
from crossfactor.operators.fit import FitOptions


def tables(seed=0, shapes=((5, 4), (6, 5), (4, 3)), blocks=(1, 3, 7)):
    """Observations with block-diagonal covariances of mixed block sizes, as frames and as dense arrays."""
    rng = np.random.default_rng(seed)
    obs, cov, dense = [], [], {}
    for t, (n_rows, n_cols) in enumerate(shapes):
        r, c = (x.ravel() for x in np.meshgrid(np.arange(n_rows), np.arange(n_cols), indexing="ij"))
        keep = rng.random(len(r)) < 0.95
        r, c = r[keep], c[keep]
        y = (1 + 0.3 * np.sin(r)) * (2 + np.cos(c)) + 0.2 * np.cos(r * 1.7) * np.sin(c * 2.3) + 0.05 * rng.standard_normal(len(r))
        n, m = len(r), np.zeros((len(r), len(r)))
        order = rng.permutation(n)
        at = 0
        while at < n:
            own = order[at : at + int(rng.choice(blocks))]
            a = rng.standard_normal((len(own), len(own) + 2)) * 0.05
            m[np.ix_(own, own)] = a @ a.T + 0.001 * np.eye(len(own))
            at += len(own)
        name, seq = f"m{t}", np.arange(n) * 3 + 10
        obs.append(pd.DataFrame({"matrix_id": name, "seq": seq, "row_idx": r.astype("int32"), "col_idx": c.astype("int32"), "value": y, "total_err": np.sqrt(np.diag(m))}))
        i, j = np.nonzero(m)
        cov.append(pd.DataFrame({"matrix_id": name, "i": seq[i], "j": seq[j], "c": m[i, j]}))
        dense[name] = (r, c, y, m)
    return pd.concat(obs), pd.concat(cov), dense


def test_blocks_of_a_covariance(spark):
    edges = [("a", 1, 2), ("a", 2, 3), ("a", 9, 8), ("b", 1, 9)] + [("p", k, k + 1) for k in range(200)]
    nodes = [("a", k) for k in (1, 2, 3, 5, 8, 9)] + [("b", k) for k in (1, 2, 9)] + [("p", k) for k in range(201)]
    got = correlated.connected(spark.createDataFrame(nodes, "matrix_id string, seq long"), spark.createDataFrame(edges, "matrix_id string, i long, j long"))
    got = {(r["matrix_id"], r["seq"]): r["block"] for r in got.collect()}
    assert [got["a", k] for k in (1, 2, 3, 5, 8, 9)] == [1, 1, 1, 5, 8, 8]
    assert [got["b", k] for k in (1, 2, 9)] == [1, 2, 1] and {got["p", k] for k in range(201)} == {0}


def test_whitening_uses_the_marginal_covariance_and_lists_bad_ones(spark):
    obs, cov, dense = tables(1)
    bad = pd.DataFrame({"matrix_id": "bad", "i": [1, 1, 2, 2], "j": [1, 2, 1, 2], "c": [1.0, 2.0, 2.0, 1.0]})
    more = pd.DataFrame({"matrix_id": ["bad", "bad", "bare"], "seq": [1, 2, 7], "row_idx": [0, 1, 0], "col_idx": [0, 0, 0], "value": [1.0, 2.0, 3.0], "total_err": 1.0})
    gone = obs[(obs.matrix_id == "m1") & (obs.seq % 2 == 0)]
    left = obs.drop(gone.index[0:0]).merge(gone[["matrix_id", "seq"]], how="left", indicator=True).query("_merge == 'left_only'").drop(columns="_merge")
    white, problems = correlated.whitening(spark.createDataFrame(pd.concat([left, more])), spark.createDataFrame(pd.concat([cov, bad])))
    assert {r["matrix_id"] for r in problems.collect()} == {"bad", "bare"}
    rows = white.toPandas()
    for name, (r, c, y, m) in dense.items():
        own = rows[rows.matrix_id == name].sort_values(["block", "seq"])
        seqs = own.seq.to_numpy()
        w, at = np.zeros((len(own), len(own))), 0
        for _, b in own.groupby("block", sort=False):
            w[at : at + len(b), at : at + len(b)] = np.stack(b.wrow.to_numpy())
            at += len(b)
        k = (seqs - 10) // 3
        assert np.allclose(w @ m[np.ix_(k, k)] @ w.T, np.eye(len(k)), atol=1e-8)
    assert set(rows.matrix_id) == set(dense)


def check_against_dense(spark, obs, dense, t, rounds, rtol):
    got = t.summary.toPandas().set_index("matrix_id")
    pred = fitops.predict(spark.createDataFrame(obs), t, 2).toPandas()
    for name in got.index:
        r, c, y, m = dense[name]
        assert got.loc[name, "ndof_rank1"] == len(r) - (len(set(r)) + len(set(c)) - 1)
        p = pred[pred.matrix_id == name].sort_values("seq")
        for rank in (1, 2):
            chi2 = got.loc[name, f"chi2_rank{rank}"]
            assert abs(chi2 - dense_gls(r, c, y, m, rank, rounds)) <= rtol * max(1.0, chi2)
            # and the factors reproduce the cost
            res = p["value"].to_numpy() - p[f"pred{rank}"].to_numpy()
            assert abs(res @ np.linalg.solve(m, res) - chi2) < 1e-6 * max(1.0, chi2)


def test_generalised_fits_equal_dense_ones(spark):
    obs, cov, dense = tables(2)
    t = correlated.fit_correlated(spark.createDataFrame(obs), spark.createDataFrame(cov), FitOptions(max_iter=400, tol=1e-12))
    assert t.summary.count() == 3
    check_against_dense(spark, obs, dense, t, 400, 1e-5)


def test_fits_by_joins_equal_dense_ones(spark):
    obs, cov, dense = tables(6, shapes=((3, 2),), blocks=(1, 3))
    o, c = spark.createDataFrame(obs).withColumn("replicate", F.lit(-1).cast("long")), spark.createDataFrame(cov)
    white, _ = correlated.whitening(o, c)
    t = correlated._fit_relational(o, white, FitOptions(max_iter=1, tol=0.0), inner=6)
    check_against_dense(spark, obs, dense, t, 1, 1e-6)
    assert not t.summary.first()["converged_rank1"]


def test_diagonal_covariance_is_the_weighted_fit_and_starts_are_used(spark):
    obs, _, _ = tables(3)
    o = spark.createDataFrame(obs)
    diag = o.select("matrix_id", F.col("seq").alias("i"), F.col("seq").alias("j"), (F.col("total_err") ** 2).alias("c"))
    opt = FitOptions(tol=1e-12)
    plain = fitops.fit(o, opt, unique=True)
    full = fitops.fit(o, opt, cov=diag)
    a, b = (t.summary.toPandas().set_index("matrix_id").sort_index() for t in (plain, full))
    for rank in (1, 2):
        assert np.allclose(a[f"chi2_rank{rank}"], b[f"chi2_rank{rank}"], rtol=1e-5)
    short = FitOptions(max_iter=5)
    again = fitops.fit(o, short, cov=diag, start=fitops.start_from(full)).summary.toPandas().set_index("matrix_id").sort_index()
    assert np.allclose(again.chi2_rank2, b.chi2_rank2, rtol=1e-4) and again.converged_rank1.all()
    again = fitops.fit(o, short, unique=True, start=fitops.start_from(plain)).summary.toPandas().set_index("matrix_id").sort_index()
    assert np.allclose(again.chi2_rank1, a.chi2_rank1, rtol=1e-6) and again.converged_rank1.all()


def test_correlated_test_tells_separable_tables_from_others(spark):
    obs, cov, dense = tables(4)
    flat = obs.copy()
    for name, (r, c, y, m) in dense.items():
        rng = np.random.default_rng(9)
        flat.loc[flat.matrix_id == name, "value"] = (1 + 0.3 * np.sin(r)) * (2 + np.cos(c)) + np.linalg.cholesky(m) @ rng.standard_normal(len(r))
    opt = FitOptions(max_iter=200)
    c = spark.createDataFrame(cov)
    real = ranktest.rank_test(spark.createDataFrame(obs), 40, 42, opt, cov=c).summary.toPandas().set_index("matrix_id")
    null = ranktest.rank_test(spark.createDataFrame(flat), 40, 42, opt, cov=c).summary.toPandas().set_index("matrix_id")
    assert (real.p_value < 0.05).any() and (null.p_value > 0.01).all() and (real.n_used == 40).all()
    assert (real.lambda_stat > null.lambda_stat).sum() >= 2


def test_noise_has_the_covariance(spark):
    obs, cov, dense = tables(5, shapes=((3, 3),), blocks=(4,))
    white, _ = correlated.whitening(spark.createDataFrame(obs), spark.createDataFrame(cov))
    n = correlated.pseudo_noise(white, 4000).toPandas().pivot(index="replicate", columns="seq", values="noise").to_numpy()
    m = dense["m0"][3]
    assert np.abs(np.cov(n.T) - m).max() < 0.1 * np.abs(m).max()
