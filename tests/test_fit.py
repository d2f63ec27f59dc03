import numpy as np
import pytest
from conftest import dense_als, frame, noisy
from pyspark.sql import functions as F

from crossfactor.operators import fit as fitops, ranktest, resample
from crossfactor.operators.fit import FitOptions


@pytest.fixture(scope="module")
def fitted(spark, synthetic):
    cells = frame(spark, {k: v[:2] for k, v in synthetic.items()})
    t = fitops.fit(cells)
    return cells, t, {r["matrix_id"]: r for r in t.summary.collect()}


def test_chi2_equals_dense_loop(fitted, synthetic):
    _, _, rows = fitted
    for name in ("rank1", "rank2", "sparse"):
        y, e, _ = synthetic[name]
        assert rows[name]["chi2_rank1"] == pytest.approx(dense_als(y, e, 1)[0], rel=1e-5)
    for name in ("rank1", "rank2"):
        y, e, _ = synthetic[name]
        assert rows[name]["chi2_rank2"] <= dense_als(y, e, 2)[0] * (1 + 1e-3)


def test_degrees_of_freedom_and_order(fitted):
    _, _, rows = fitted
    assert rows["rank1"]["ndof_rank1"] == 20 - (5 + 4 - 1)
    assert rows["rank2"]["ndof_rank2"] == 30 - 2 * (6 + 5)
    assert rows["exact"]["chi2_rank1"] < 1e-8
    for r in rows.values():
        assert r["lambda_stat"] >= -1e-6 and r["converged_rank1"]
    assert rows["rank2"]["lambda_stat"] > 0
    assert 0.1 < rows["rank1"]["chi2_rank1"] / rows["rank1"]["ndof_rank1"] < 5


def test_prediction_close_to_truth(fitted, synthetic):
    _, t, _ = fitted
    for name, rank, limit in (("rank1", 1, 0.2), ("rank2", 2, 0.3), ("exact", 1, 1e-6)):
        p = fitops.predict_matrix(t, rank).filter(F.col("matrix_id") == name).toPandas()
        m = synthetic[name][2]
        got = np.zeros_like(m)
        got[p["row_idx"], p["col_idx"]] = p["pred"]
        assert np.linalg.norm(got - m) / np.linalg.norm(m) < limit


def test_gauge(fitted):
    _, t, _ = fitted
    g = t.cols.groupBy("matrix_id").agg(
        F.sum(F.col("v") ** 2).alias("a"), F.sum(F.col("v1") ** 2).alias("b"), F.sum(F.col("v1") * F.col("v2")).alias("c")
    ).collect()
    for r in g:
        assert r["a"] == pytest.approx(1) and r["b"] == pytest.approx(1) and abs(r["c"]) < 1e-8


def test_both_forms_agree(spark, synthetic):
    cells = frame(spark, {k: synthetic[k][:2] for k in ("rank1", "rank2", "sparse")})
    opt = FitOptions(max_iter=3, tol=0.0, start_rounds=2)
    a, b = fitops.fit(cells, opt, form="grouped"), fitops.fit(cells, opt, form="relational")
    x = a.summary.join(b.summary.select("matrix_id", F.col("chi2_rank1").alias("c1"), F.col("chi2_rank2").alias("c2")), "matrix_id").collect()
    assert len(x) == 3
    for r in x:
        assert r["chi2_rank1"] == pytest.approx(r["c1"], rel=1e-8) and r["chi2_rank2"] == pytest.approx(r["c2"], rel=1e-8)
    va = {(r["matrix_id"], r["col_idx"]): r for r in a.cols.collect()}
    for r in b.cols.collect():
        o = va[(r["matrix_id"], r["col_idx"])]
        assert r["v"] == pytest.approx(o["v"], abs=1e-8)
        assert abs(r["v2"]) == pytest.approx(abs(o["v2"]), abs=1e-6)


def test_relational_stops_by_key(spark, synthetic):
    cells = frame(spark, {k: synthetic[k][:2] for k in ("rank1", "exact")})
    t = fitops.fit(cells, FitOptions(max_iter=12, tol=1e-6, rank=1, start_rounds=2), form="relational")
    rows = {r["matrix_id"]: r for r in t.summary.collect()}
    assert rows["rank1"]["converged_rank1"] and rows["exact"]["converged_rank1"]
    assert rows["exact"]["chi2_rank1"] < 1e-6


def test_size_split_sends_large_keys_to_joins(spark, synthetic):
    cells = frame(spark, {k: synthetic[k][:2] for k in ("rank1", "sparse")})
    opt = FitOptions(max_iter=3, tol=0.0, start_rounds=2, rank=1)
    one = {r["matrix_id"]: r["chi2_rank1"] for r in fitops.fit(cells, opt).summary.collect()}
    mixed = fitops.fit(cells, FitOptions(max_iter=3, tol=0.0, start_rounds=2, rank=1, group_max_cells=25))
    assert mixed.has_large
    two = {r["matrix_id"]: r["chi2_rank1"] for r in mixed.summary.collect()}
    assert two == pytest.approx(one, rel=1e-8)


def test_metamorphic(spark, synthetic):
    y, e, _ = synthetic["rank2"]
    cells = frame(spark, {"plain": (y, e), "scaled": (1e4 * y, 1e4 * e), "turned": (y.T.copy(), e.T.copy())})
    rows = {r["matrix_id"]: r for r in fitops.fit(cells).summary.collect()}
    assert rows["scaled"]["lambda_stat"] == pytest.approx(rows["plain"]["lambda_stat"], rel=1e-6)
    assert rows["turned"]["chi2_rank1"] == pytest.approx(rows["plain"]["chi2_rank1"], rel=1e-5)
    again = {r["matrix_id"]: r for r in fitops.fit(cells.repartition(5, "col_idx")).summary.collect()}
    for k in rows:
        assert again[k]["lambda_stat"] == pytest.approx(rows[k]["lambda_stat"], rel=1e-9)


def test_duplicates_count_every_observation(spark, synthetic):
    y, e, _ = synthetic["rank1"]
    cells = frame(spark, {"m": (y, e)})
    twice = cells.unionByName(cells)
    a = fitops.fit(cells, FitOptions(rank=1)).summary.first()
    b = fitops.fit(twice, FitOptions(rank=1)).summary.first()
    assert b["n_obs"] == 2 * a["n_obs"] and b["chi2_rank1"] == pytest.approx(2 * a["chi2_rank1"], rel=1e-6)


def test_multistart(spark, synthetic):
    cells = frame(spark, {"rank1": synthetic["rank1"][:2]})
    t = fitops.multistart(cells, 4, opt=FitOptions(rank=1))
    chi2 = [r["chi2_rank1"] for r in t.summary.collect()]
    assert len(chi2) == 4 and max(chi2) / min(chi2) < 2
    assert fitops.best_start(t.summary, 1).first()["chi2_rank1"] == min(chi2)
    agree = fitops.start_agreement(t, 1).first()
    assert agree["is_stable"] and agree["max_rel_diff"] < 0.05


def test_multistart_large_keys(spark, synthetic):
    cells = frame(spark, {"rank1": synthetic["rank1"][:2]})
    small = fitops.multistart(cells, 2, opt=FitOptions(rank=1, max_iter=3, tol=0.0))
    large = fitops.multistart(cells, 2, opt=FitOptions(rank=1, max_iter=3, tol=0.0, group_max_cells=4))
    a = {r["start"]: r["chi2_rank1"] for r in small.summary.collect()}
    assert {r["start"]: r["chi2_rank1"] for r in large.summary.collect()} == pytest.approx(a, rel=1e-7)


def test_rank_test(spark, synthetic):
    cells = frame(spark, {k: synthetic[k][:2] for k in ("rank1", "rank2")})
    t = ranktest.rank_test(cells, 60)
    rows = {r["matrix_id"]: r for r in ranktest.verdict(t.summary).collect()}
    assert rows["rank1"]["p_value"] > 0.01 and rows["rank2"]["p_value"] < 0.05
    for r in rows.values():
        assert r["p_lower"] <= r["p_value"] <= r["p_upper"] + 1 / 60
        assert r["n_used"] + r["n_failed"] == 60
    assert rows["rank2"]["verdict"] == "REJECTED"
    other = ranktest.rank_test(cells.repartition(16), 60).summary.collect()
    assert {r["matrix_id"]: r["p_value"] for r in other} == {k: r["p_value"] for k, r in rows.items()}


def test_null_of_large_keys_matches_grouped(spark, synthetic):
    cells = frame(spark, {"rank1": synthetic["rank1"][:2]})
    opt = dict(max_iter=2, tol=0.0, start_rounds=2)
    small = ranktest.rank_test(cells, 4, opt=FitOptions(**opt))
    large = ranktest.rank_test(cells, 4, opt=FitOptions(**opt, group_max_cells=4, relational_rows=60))
    a = {r["replicate"]: r["lambda_stat"] for r in small.null.collect()}
    assert {r["replicate"]: r["lambda_stat"] for r in large.null.collect()} == pytest.approx(a, rel=1e-6)


def test_pseudo_blocks_equal_long_form(spark, synthetic):
    cells = frame(spark, {"rank1": synthetic["rank1"][:2]}).withColumn("pred", F.col("value")).withColumn("grid", F.lit(20))
    blocks, draw = resample.pseudo_blocks(cells, "pred", 7, "grid", block_values=60)
    got = blocks.withColumn("ys", draw).select("row_idx", "col_idx", "rep0", F.posexplode("ys").alias("i", "y"))
    a = {(r["row_idx"], r["col_idx"], r["rep0"] + r["i"]): r["y"] for r in got.collect()}
    b = {(r["row_idx"], r["col_idx"], r["replicate"]): r["value"] for r in resample.pseudo_data(cells, "pred", 7).collect()}
    assert len(a) == 140 and a == pytest.approx(b)


def test_verdict_gates(spark):
    base = dict(p_value=0.01, ndof_rank1=5, ndof_rank2=3, lambda_stat=10.0, converged_rank1=True, converged_rank2=True, origin="api")
    cases = [
        ({}, "REJECTED"), ({"p_value": 0.2}, "NOT_REJECTED"), ({"ndof_rank2": -5}, "INCONCLUSIVE"), ({"origin": "fallback"}, "INCONCLUSIVE"),
        ({"converged_rank2": False}, "INCONCLUSIVE"), ({"lambda_stat": -2.0}, "INCONCLUSIVE"),
    ]
    df = spark.createDataFrame([{**base, **c, "n": i} for i, (c, _) in enumerate(cases)])
    got = ranktest.verdict(df, F.col("origin")).orderBy("n").collect()
    assert [r["verdict"] for r in got] == [w for _, w in cases]


def test_calibration_of_p_values(spark):
    """Sixty rank-one tables: their p-values look uniform."""
    rng = np.random.default_rng(5)
    tables = {}
    for i in range(60):
        m = np.outer(rng.random(6) + 0.5, rng.random(5) + 0.5)
        e = np.full_like(m, 0.05)
        tables[f"t{i}"] = (m + e * rng.standard_normal(m.shape), e)
    from crossfactor.operators import validate

    p = ranktest.rank_test(frame(spark, tables), 99).summary.select(F.lit("all").alias("g"), F.col("p_value").alias("p"))
    r = validate.calibration_report(p, ["g"], 60).first()
    assert r["n"] == 60 and r["ks_pvalue"] > 0.01 and r["rate_calibrated"] and r["null_passed"]


def test_accelerated_rounds_reach_the_same_point_sooner(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((9, 2)) @ rng.standard_normal((2, 7))
    y, e = noisy(m, 11, 0.05, 0.3)
    hole = rng.random(m.shape) > 0.75
    hole[0] = hole[:, 0] = False
    y[hole] = np.nan
    cells = frame(spark, {"holes": (y, e)})
    ahead = fitops.fit(cells, FitOptions(tol=1e-9, start_rounds=2, rank=1, accelerate=True), unique=True, form="relational").summary.first()
    plain = fitops.fit(cells, FitOptions(tol=1e-9, start_rounds=2, rank=1, check_every=1), unique=True, form="grouped").summary.first()
    exact = fitops.fit(cells, FitOptions(tol=1e-14, rank=1), unique=True, form="grouped").summary.first()
    assert ahead.converged_rank1 and ahead.n_iter_rank1 < plain.n_iter_rank1
    assert ahead.chi2_rank1 == pytest.approx(exact.chi2_rank1, rel=1e-8)


def test_accelerated_rounds_end_with_plain_ones(spark, synthetic):
    """A limit in the middle of a cycle still leaves factors that belong together, and unsettled keys say so."""
    cells = frame(spark, {"rank2": synthetic["rank2"][:2]})
    for limit in (1, 4):
        opt = FitOptions(max_iter=limit, tol=0.0, start_rounds=2, rank=1, accelerate=True)
        t = fitops.fit(cells, opt, unique=True, form="relational")
        r = t.summary.first()
        p = fitops.predict(cells, t, 1).toPandas()
        assert r.n_iter_rank1 == limit and not r.converged_rank1
        assert (((p.value - p.pred1) / p.total_err) ** 2).sum() == pytest.approx(r.chi2_rank1, rel=1e-9)


def test_large_sides_give_what_small_ones_give(spark, synthetic, monkeypatch):
    """Factors and keys that are too many to be sent are hashed; the numbers are the same."""
    cells = frame(spark, {k: synthetic[k][:2] for k in ("rank2", "sparse")})
    opt = FitOptions(max_iter=2, tol=0.0, start_rounds=1, rank=1, salt=2)
    get = lambda: {r["matrix_id"]: (r["chi2_rank1"], r["n_rows"], r["n_cols"]) for r in fitops.fit(cells, opt, unique=True, form="relational").summary.collect()}
    sent = get()
    monkeypatch.setattr(fitops, "SENT", 0)
    hashed = get()
    assert set(sent) == set(hashed) == {"rank2", "sparse"}
    for k in sent:
        assert sent[k][0] == pytest.approx(hashed[k][0], rel=1e-9) and sent[k][1:] == hashed[k][1:]


def test_no_matrix_meets_in_one_task(spark):
    """Frames with a row per matrix and factors of a small side are sent, so cells are never hashed or sorted by matrix."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = spark.range(400).selectExpr("'m' AS matrix_id", "int(id % 80) AS row_idx", "int(id / 80) AS col_idx", "double(id) AS y", "1.0D AS w")
        _, large, _ = fitops.split_by_size(cells, 10)
        assert "SortMergeJoin" not in large._jdf.queryExecution().executedPlan().toString()
        layout = fitops._Layout(cells, ["matrix_id"], 0)
        v = spark.range(5).selectExpr("'m' AS matrix_id", "int(id) AS col_idx", "1.0D AS v")
        plan = layout.half_step(v, "col_idx", "row_idx", ["v"])
        assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
        assert {r["row_idx"]: r["p"] for r in plan.collect()} == {i: sum(float(i + 80 * k) for k in range(5)) for i in range(80)}
        layout.release()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
