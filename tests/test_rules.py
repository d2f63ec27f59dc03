"""One stopping rule for every size, no dropped replicates, errors that hold, presets that say what they miss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import frame, noisy
from crossfactor.operators import cells as cellops, fit as fitops, mode, ordered, presets, ranktest, replicate
from crossfactor.operators.fit import FitOptions


def test_both_forms_follow_the_same_rule(spark, synthetic):
    cells = frame(spark, {k: synthetic[k][:2] for k in ("sparse",)})
    a = {r["matrix_id"]: r for r in fitops.fit(cells, FitOptions(max_iter=40), unique=True).summary.collect()}
    b = {r["matrix_id"]: r for r in fitops.fit(cells, FitOptions(max_iter=40, group_max_cells=4), unique=True).summary.collect()}
    for k, r in a.items():
        for c in ("converged_rank1", "converged_rank2", "n_iter_rank1", "n_iter_rank2"):
            assert r[c] == b[k][c], (k, c)
        for c in ("chi2_rank1", "chi2_rank2"):
            assert b[k][c] == pytest.approx(r[c], rel=1e-6)


def test_every_finished_replicate_counts(spark):
    obs = spark.createDataFrame([("a", 4.0), ("b", 1.0)], "matrix_id string, lambda_stat double")
    null = spark.createDataFrame(
        [("a", 0, 5.0, True), ("a", 1, 6.0, False), ("a", 2, 1.0, False), ("a", 3, None, True), ("b", 0, float("nan"), True)],
        "matrix_id string, replicate long, lambda_stat double, settled boolean",
    )
    p = ranktest.with_interval(ranktest.p_values(obs, null, ok=F.col("settled")))
    r = {x["matrix_id"]: x for x in p.collect()}
    assert (r["a"]["k"], r["a"]["n_used"], r["a"]["n_failed"], r["a"]["n_unsettled"]) == (2, 3, 1, 2)
    assert r["a"]["p_value"] == pytest.approx(3 / 4)
    assert r["b"]["n_used"] == 0 and r["b"]["p_value"] is None and r["b"]["p_lower"] is None
    full = obs.select("matrix_id", "lambda_stat", F.lit(5).alias("ndof_rank1"), F.lit(2).alias("ndof_rank2"), F.lit(True).alias("converged_rank1"), F.lit(True).alias("converged_rank2"))
    words = {x["matrix_id"]: x["verdict"] for x in ranktest.verdict(full.join(p, "matrix_id")).collect()}
    assert words == {"a": "NOT_REJECTED", "b": "INCONCLUSIVE"}


def test_unsettled_replicates_stay_in_the_global_test(spark):
    obs = spark.createDataFrame([("m", "x", 10.0)], "matrix_id string, preset string, lambda_stat double")
    null = spark.createDataFrame([("m", "x", i, 20.0, i == 0) for i in range(19)], "matrix_id string, preset string, replicate long, lambda_stat double, settled boolean")
    r = presets.global_significance(obs, null)[0].first()
    assert r["k"] == 19 and r["p_global"] == 1.0


def test_no_p_value_is_no_verdict(spark):
    row = dict(p_local=None, p_global=0.01, gini=0.6, normalized_entropy=0.5, is_stable=True, stability_grade="high", all_replicate=True, mean_replication_score=0.9, fit_healthy=True)
    schema = "p_local double, p_global double, gini double, normalized_entropy double, is_stable boolean, stability_grade string, all_replicate boolean, mean_replication_score double, fit_healthy boolean"
    r = mode.mode_verdict(spark.createDataFrame([row], schema)).first()
    assert r["mode_verdict"] == "inconclusive" and r["reasons"]


def test_moments_keep_their_digits(spark):
    x = spark.range(1000).select(F.lit("g").alias("g"), (F.col("id") % 7).alias("part"), (F.lit(1e9) + F.col("id") % 2).alias("x"))
    m = cellops.merge_moments(cellops.moments(x, ["g", "part"], F.col("x")), ["g"])
    r = cellops.mean_cells(m).first()
    want = x.agg(F.stddev_samp("x")).first()[0] / np.sqrt(1000)
    assert r["value"] == 1e9 + 0.5 and r["total_err"] == pytest.approx(want, rel=1e-7) and r["n_obs"] == 1000


def test_moments_of_null_groups_and_no_rows(spark):
    x = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), ("a", 1, None)], "g string, part int, x double")
    m = cellops.merge_moments(cellops.moments(x, ["g", "part"], F.col("x")), ["g"]).collect()
    assert [(r["g"], r["n"], r["mean"], r["m2"]) for r in m] == [(None, 2, 3.0, 2.0)]


def test_cells_without_an_error_do_not_reach_the_fit(spark, synthetic):
    y, e = synthetic["rank1"][:2]
    e = e.copy()
    e[1, 2] = 0.0
    cells = frame(spark, {"m": (y, e)})
    r = fitops.fit(cells).summary.first()
    assert r["n_obs"] == 19 and np.isfinite([r["chi2_rank1"], r["chi2_rank2"], r["lambda_stat"]]).all()
    t = ranktest.rank_test(cells, 10)
    assert np.isfinite([x["lambda_stat"] for x in t.null.collect()]).all()


def test_presets_name_the_column_they_miss(spark):
    cells = spark.createDataFrame([("m", "a", "b", 1.0)], "matrix_id string, row_label string, col_label string, value double")
    for some, column in ((presets.ELASTIC_PRESETS, "axis_value"), (presets.DIFFRACTIVE_PRESETS[:2], "Q2"), (presets.DIFFRACTIVE_PRESETS[-1:], "source")):
        with pytest.raises(ValueError, match=column):
            presets.apply_presets(cells, some)


def test_ranks_over_all_tasks(spark):
    d = spark.range(300).select(F.lit(1).alias("k"), F.col("id"), ((F.col("id") * 7) % 50).cast("double").alias("x"))
    one = {r["id"]: r["rank"] for r in ordered.average_ranks(d, ["k"], "x").collect()}
    assert {r["id"]: r["rank"] for r in ordered.average_ranks(d, ["k"], "x", spread=True).collect()} == one
    j = d.select("k", F.col("x").alias("a"), (F.col("x") * F.col("x") - 20).alias("b"))
    assert replicate.spearman(j, ["k"], spread=True).first()["spearman"] == pytest.approx(replicate.spearman(j, ["k"]).first()["spearman"])


@pytest.mark.parametrize("rank", [1, 2])
def test_agreement_of_starts_from_gram_matrices(spark, synthetic, rank):
    cells = frame(spark, {"m": noisy(synthetic["rank2"][2], 5)})
    t = fitops.multistart(cells, 3, opt=FitOptions(rank=2, max_iter=4, tol=0.0))
    got = fitops.start_agreement(t, rank).first()["max_rel_diff"]
    pred = fitops.predict_matrix(t, rank).toPandas()
    order = [r["start"] for r in fitops.best_start(t.summary, rank, 3).orderBy("place").collect()]
    m = [pred[pred.start == s].sort_values(["row_idx", "col_idx"]).pred.to_numpy() for s in order]
    want = max(np.linalg.norm(m[i] - m[k]) / np.linalg.norm(m[i]) for i in range(3) for k in range(i + 1, 3))
    assert got == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_large_documents_are_refused(spark):
    from crossfactor.sources import observations

    obs = spark.range(20).select(F.lit("m").alias("matrix_id"), F.col("id").alias("seq"))
    with pytest.raises(ValueError, match="m"):
        observations.documents_json(obs, most=10)
