import numpy as np
import pandas as pd
import pytest
from conftest import frame
from pyspark.sql import functions as F

from crossfactor.operators import fit as fitops, mode, ordered, presets, replicate
from crossfactor.plans import analysis


def vectors(spark, d):
    return spark.createDataFrame(
        pd.concat([pd.DataFrame({"matrix_id": k, "idx": np.arange(len(v), dtype="int32"), "val": np.array(v, float)}) for k, v in d.items()])
    )


@pytest.mark.parametrize("spread", [False, True])
def test_localization(spark, spread):
    v = vectors(
        spark,
        {"spike": [0, 0, 1, 0, 0], "flat": [1] * 10, "hill": [0.1, 0.2, 0.5, 0.3, 0.1], "pair": [0, 0, 0.7, 0.7, 0.1, 0], "none": [0, 0, 0]},
    )
    r = {x["matrix_id"]: x for x in mode.localization(v, spread).collect()}
    assert r["spike"]["gini"] >= 0.8 and r["spike"]["normalized_entropy"] < 0.3 and r["spike"]["top_k_mass"][1] == 1
    assert r["flat"]["gini"] < 0.1 and r["flat"]["normalized_entropy"] > 0.95 and r["flat"]["top_k_mass"][1] < 0.2
    assert r["hill"]["peak_index"] == 2 and r["hill"]["peak_value"] == 0.5
    assert r["pair"]["window_concentration"][2] > 0.9
    assert r["none"]["gini"] == 0 and r["none"]["peak_index"] == 0


def test_running_forms_agree(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 900 + ["b"] * 30, "x": rng.random(930), "id": np.arange(930)}))
    one = ordered.running(df, ["g"], [F.col("x"), F.col("id")], {"c": F.col("x")})
    two = ordered.running(df, ["g"], [F.col("x"), F.col("id")], {"c": F.col("x")}, spread=True)
    a = {r["id"]: (r["rn"], round(r["c"], 9)) for r in one.collect()}
    assert {r["id"]: (r["rn"], round(r["c"], 9)) for r in two.collect()} == a


def test_average_ranks_forms_agree(spark):
    df = spark.createDataFrame([("a", float(i % 7), i) for i in range(50)], "g string, x double, id int")
    a = {r["id"]: r["rank"] for r in ordered.average_ranks(df, ["g"], "x").collect()}
    b = {r["id"]: r["rank"] for r in ordered.average_ranks(df, ["g"], "x", spread=True).collect()}
    assert a == b
    assert a == pd.Series([i % 7 for i in range(50)]).rank().to_dict()


def test_sign_and_norm(spark):
    rows = [("m", "row", i, float(x)) for i, x in enumerate((1, 2, 3))] + [("m", "col", i, x) for i, x in enumerate((0.1, -0.5, 0.2))]
    rows += [("n", "row", i, float(x)) for i, x in enumerate((1, 2, 3))] + [("n", "col", i, float(x)) for i, x in enumerate((4, 0, 3))]
    df = spark.createDataFrame(rows, "matrix_id string, axis string, idx int, val double")
    out = {(r["matrix_id"], r["axis"], r["idx"]): r for r in mode.signed_normalised(df).collect()}
    assert out[("m", "col", 1)]["val"] > 0 and out[("m", "row", 0)]["val"] < 0
    assert out[("n", "row", 1)]["val"] == pytest.approx(10) and out[("n", "col", 0)]["scale"] == pytest.approx(5)
    signs = {c: mode.sign_of(df.filter("axis = 'col' and matrix_id = 'm'"), ["matrix_id"], c).first()["sign"] for c in ("max_positive", "dot_positive", "first_positive")}
    assert signs == {"max_positive": -1.0, "dot_positive": -1.0, "first_positive": 1.0}


def test_residual_map_gain_sums_to_lambda(spark, synthetic):
    cells = frame(spark, {"rank2": synthetic["rank2"][:2]})
    t = fitops.fit(cells)
    gain = mode.residual_map(cells, t).agg(F.sum("chi2_gain")).first()[0]
    assert gain == pytest.approx(t.summary.first()["lambda_stat"], rel=1e-6)


def test_stability_grades(spark):
    def modes(kind, vs):
        rows = [("m", i, ax, j, float(x)) for i, v in enumerate(vs) for ax in ("row", "col") for j, x in enumerate(v)]
        return spark.createDataFrame(rows, f"matrix_id string, {kind} int, axis string, idx int, val double")

    ref = modes("start", [[0.1, 0.9, 0.2]]).drop("start")
    same = mode.stability(ref, modes("start", [[0.1, 0.9, 0.2], [-0.1, -0.9, -0.2], [0.1, 0.9, 0.21]])).first()
    assert same["stability_grade"] == "high" and same["is_stable"] and same["peak_index_mode"] == 1 and same["peak_index_consistency"] == 1
    off = mode.stability(ref, modes("start", [[0.9, -0.1, 0.0], [0.0, 0.1, 0.9]])).first()
    assert off["stability_grade"] == "unstable" and not off["is_stable"]
    alone = mode.stability(ref, None, modes("replicate", [[0.1, 0.9, 0.2]])).first()
    assert alone["stability_grade"] == "unknown" and alone["v2_bootstrap_cosine_mean"] == pytest.approx(1)


def test_mode_verdict(spark):
    base = dict(p_local=0.001, p_global=0.01, gini=0.6, normalized_entropy=0.5, is_stable=True, stability_grade="high", all_replicate=True, mean_replication_score=0.9, fit_healthy=True)
    cases = [
        ({}, "structured_deviation"), ({"fit_healthy": False}, "inconclusive"), ({"is_stable": False, "stability_grade": "low"}, "inconclusive"),
        ({"p_local": 0.5}, "consistent_with_null"), ({"p_global": 0.2, "gini": 0.2, "normalized_entropy": 0.9, "all_replicate": False}, "likely_artifact"),
        ({"p_global": 0.2}, "structured_deviation"), ({"p_local": 0.03, "all_replicate": False}, "likely_artifact"),
        ({"p_local": 0.03}, "structured_deviation"), ({"p_local": 0.07}, "consistent_with_null"),
    ]
    df = spark.createDataFrame([{**base, **c, "n": i} for i, (c, _) in enumerate(cases)])
    got = mode.mode_verdict(df).orderBy("n").collect()
    assert [r["mode_verdict"] for r in got] == [w for _, w in cases]
    assert all(r["reasons"] for r in got)


def test_presets(spark):
    for name in ("higgs", "elastic", "diffractive"):
        full, fast = presets.presets_for(name), presets.presets_for(name, fast=True)
        assert full[0].name == "baseline" and len(fast) == 3 and {p.name for p in fast} < {p.name for p in full}
    table = presets.preset_table(spark, presets.DIFFRACTIVE_PRESETS)
    back = presets.preset_from_json(presets.preset_json(table))
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))
    cells = spark.createDataFrame(
        [("m", 0, 0, 20.0, 0.5, "H1"), ("m", 0, 1, 5.0, 0.05, "ZEUS"), ("m", 0, 2, 5.0, 0.5, "h1")],
        "matrix_id string, row_idx int, col_idx int, Q2 double, beta double, source string",
    )
    n = {r["preset"]: r["count"] for r in presets.apply_presets(cells, presets.DIFFRACTIVE_PRESETS).groupBy("preset").count().collect()}
    assert n == {"baseline": 3, "high_Q2": 1, "mid_beta": 2, "h1_only": 2, "zeus_only": 1}


def test_sweep_summary(spark):
    schema = "matrix_id string, preset string, ord int, lambda_stat double, p_local double, fit_converged boolean, v2_peak_index int"
    rows = [("a", "x", 0, 5.0, 0.2, True, 3), ("a", "y", 1, 10.0, 0.01, True, 2), ("a", "z", 2, 99.0, 0.0, False, 2), ("b", "x", 0, 1.0, 0.5, False, None)]
    r = {x["matrix_id"]: x for x in presets.sweep_summary(spark.createDataFrame(rows, schema)).collect()}
    assert r["a"]["best_preset"] == "y" and r["a"]["n_converged"] == 2 and not r["a"]["all_agree_significance"] and r["a"]["peak_mode"] == 3
    assert r["b"]["best_preset"] == "none" and r["b"]["n_converged"] == 0 and r["b"]["p_local_min"] == 1


def test_sweep_summary_of_presets_that_keep_the_same_cells(spark):
    """A difference in the last bits does not choose the best preset; the first listed does."""
    schema = "matrix_id string, preset string, ord int, lambda_stat double, p_local double, fit_converged boolean"
    rows = [("a", "late", 3, 205.5714 + 1e-10, 0.4, True), ("a", "first", 0, 205.5714, 0.3, True), ("a", "low", 1, 57.651, 0.2, True)]
    r = presets.sweep_summary(spark.createDataFrame(rows, schema)).first()
    assert (r["best_preset"], r["best_p_local"]) == ("first", 0.3)


def test_global_significance_counts_failures_as_zero(spark):
    obs = spark.createDataFrame([("a", "x", 4.0), ("a", "y", 2.0)], "matrix_id string, preset string, lambda_stat double")
    null = spark.createDataFrame(
        [("a", "x", 0, 5.0), ("a", "y", 0, 1.0), ("a", "x", 1, None), ("a", "y", 1, 3.0), ("a", "x", 2, 3.0), ("a", "y", 2, 4.5)],
        "matrix_id string, preset string, replicate long, lambda_stat double",
    )
    out, t_null = presets.global_significance(obs, null)
    r = out.first()
    assert r["k"] == 2 and r["p_global"] == pytest.approx(3 / 4) and r["best_preset"] == "x"
    assert {x["replicate"]: x["lambda_stat"] for x in t_null.collect()} == {0: 5.0, 1: 3.0, 2: 4.5}


def _modes(spark, d):
    rows = [(k, ax, i, float(x), float(g)) for k, (u, v, grid) in d.items() for ax, vec in (("row", u), ("col", v)) for i, (x, g) in enumerate(zip(vec, grid if ax == "col" else range(len(vec))))]
    return spark.createDataFrame(rows, "mode_id string, axis string, idx int, val double, grid double")


def test_compare_direct(spark):
    g = [0, 1, 2, 3]
    m = _modes(spark, {"a": ([1, 2], [0.1, 0.9, 0.3, 0.2], g), "b": ([-1, -2], [-0.1, -0.9, -0.3, -0.2], g), "c": ([1, 2], [0.9, -0.1, 0, 0], g), "d": ([1, 2, 3], [1, 0, 0, 0], g)})
    r = {(x["source_a"], x["source_b"]): x for x in replicate.compare_direct(m, replicate.unordered_pairs(m)).collect()}
    assert len(r) == 6
    ab = r[("a", "b")]
    assert ab["v2_cosine"] == pytest.approx(1) and ab["u2_cosine"] == pytest.approx(1) and not ab["sign_aligned"] and ab["replication_grade"] == "excellent"
    assert ab["v2_spearman"] == pytest.approx(1)
    assert abs(r[("a", "c")]["v2_cosine"]) < 0.05
    assert r[("a", "d")]["replication_grade"] == "incompatible" and "row factors of" in r[("a", "d")]["comparability_note"]


def test_compare_interpolated(spark):
    x, z = np.linspace(0, 1, 11), np.linspace(0.2, 1.4, 9)
    f = lambda t: np.exp(-((t - 0.6) ** 2) / 0.02)
    m = _modes(spark, {"a": ([1, 2, 3], f(x), x), "b": ([1, 2, 3], -f(z), z), "far": ([1, 2], f(x), x + 50)})
    r = {(q["source_a"], q["source_b"]): q for q in replicate.compare_interpolated(m, replicate.unordered_pairs(m)).collect()}
    ab = r[("a", "b")]
    grid = np.linspace(0.2, 1.0, 100)
    a, b = np.interp(grid, x, f(x)), np.interp(grid, z, f(z))
    assert ab["v2_cosine"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-9)
    assert ab["u2_cosine"] == pytest.approx(-1) and ab["v2_peak_a"] == int(np.argmax(a))
    assert not r[("a", "far")]["comparable"] and r[("a", "far")]["replication_grade"] == "incompatible"
    rep = replicate.by_energy(m).first()
    assert rep["n_comparisons"] == 3 and rep["best_comparison"] == "a vs b"


def test_replication_strategies(spark):
    g = [0, 1, 2, 3]
    m = _modes(spark, {"full": ([1, 2], [0.1, 0.9, 0.3, 0.2], g), "loo_a": ([1, 2], [0.1, 0.9, 0.3, 0.25], g), "loo_b": ([1, 2], [0.1, 0.9, 0.35, 0.2], g)})
    r = replicate.full_and_left_out(m).first()
    assert r["n_comparisons"] == 3 and r["all_replicate"]
    s = replicate.by_source(m.withColumn("mode_id", F.regexp_replace("mode_id", "full", "combined")), has_grid=False).first()
    assert s["n_comparisons"] == 3 and s["mean_replication_score"] > 0.9


def test_mode_analysis_end_to_end(spark, synthetic):
    u, v, m = synthetic["rank2"]
    cells = frame(spark, {"rank2": (u, v), "rank1": synthetic["rank1"][:2]})
    cells = cells.withColumn("row_label", F.concat(F.lit("r"), "row_idx")).withColumn("col_label", F.concat(F.lit("c"), "col_idx"))
    ps = [presets.Preset("baseline"), presets.Preset("loo_r0", "leave_one_out", exclude_element="r0"), presets.Preset("nothing", "data_subset", include_rows=("zz",))]
    out = analysis.mode_analysis(cells, ps, n_bootstrap=30, n_starts=3, n_stability=5)
    r = {x["matrix_id"]: x for x in out.result.collect()}
    assert set(r) == {"rank1", "rank2"} and r["rank2"]["p_local"] < r["rank1"]["p_local"]
    sw = {(x["matrix_id"], x["preset"]): x["fit_converged"] for x in out.sweep.collect()}
    assert len(sw) == 6 and not sw[("rank2", "nothing")]
    assert all(x["mode_verdict"] for x in r.values())


def test_baseline_end_to_end(spark, synthetic):
    cells = frame(spark, {k: synthetic[k][:2] for k in ("rank1", "rank2")})
    out = analysis.baseline(cells, n_bootstrap=40, injection_bootstrap=20)
    r = {x["matrix_id"]: x for x in out.result.collect()}
    assert r["rank2"]["verdict"] == "REJECTED" and 0 < r["rank1"]["p_value"] <= 1
    names = {(x["matrix_id"], x["check"]) for x in out.checks.collect()}
    assert ("rank1", "synthetic_injection") in names and ("rank1", "variance_explained") in names and len(names) == 10
