import glob
import hashlib
import json
import re
import tempfile

import numpy as np
import pandas as pd
import pytest
from conftest import frame
from pyspark.sql import functions as F

from crossfactor.operators import cells as cellops, checks, covariance as cov, curves, fit as fitops, spectrum, validate, wrangle
from crossfactor.operators.fit import FitOptions
from crossfactor.schemas import PUBLISHED_TABLE
from crossfactor.sources import files, observations, provenance, published


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def labelled(spark, synthetic):
    c = frame(spark, {k: synthetic[k][:2] for k in ("rank1", "sparse")})
    return c.withColumn("seq", F.col("row_idx").cast("long") * 10 + F.col("col_idx")).withColumn("row_label", F.concat(F.lit("r"), "row_idx")).withColumn(
        "col_label", F.concat(F.lit("μ="), "col_idx")
    )


# -------------------------------------------------------------------- storage
def test_parquet_round_trip_with_covariance(spark, synthetic, folder):
    obs = observations.complete(labelled(spark, synthetic))
    c = obs.select("matrix_id", F.col("seq").alias("i"), F.col("seq").alias("j"), F.pow("total_err", 2).alias("c"))
    observations.write_observations(obs, folder, cov=c)
    back = observations.read_observations(spark, folder)
    assert back.schema == obs.schema and sorted(back.collect()) == sorted(obs.collect())
    assert observations.read_covariance(spark, folder).count() == c.count()


def test_store_is_clustered(spark, folder):
    """Files follow from rows, not from matrices; a hot matrix is split; naming matrices prunes folders."""
    hot = spark.range(4000).select(F.lit("hot").alias("matrix_id"), F.col("id").alias("seq"), (F.col("id") % 7).cast("int").alias("row_idx"), F.lit(1).alias("col_idx"), F.rand(1).alias("value"))
    many = spark.range(2000).select(F.concat(F.lit("m"), "id").alias("matrix_id"), F.col("id").alias("seq"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.rand(2).alias("value"))
    obs = observations.complete(hot.unionByName(many))
    observations.write_observations(obs, folder + "/c", rows_per_file=1000)
    files = glob.glob(folder + "/c/obs/of=8/bucket=*/*.parquet")
    assert 8 <= len(files) <= 16
    back = observations.read_observations(spark, folder + "/c")
    assert sorted(back.collect()) == sorted(obs.collect())
    one = observations.read_observations(spark, folder + "/c", ["m17", "m18"])
    assert sorted(r["matrix_id"] for r in one.collect()) == ["m17", "m18"]
    assert re.search(r"PartitionFilters: \[[^\n]*bucket#\d+ IN \(pmod\(", one._jdf.queryExecution().executedPlan().toString())
    assert observations.read_observations(spark, folder + "/c", []).count() == 0
    observations.write_observations(obs.limit(0), folder + "/e")
    assert observations.read_observations(spark, folder + "/e").count() == 0


def test_containing(spark):
    labels = ["alpha", "beta", "al", "a", "γγ", "", None, "xalphax"]
    patterns = ["al", "a", "alpha", "", "γ", "pha", "zzz", None, "betaa"]
    got = validate.containing(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in patterns], "pattern string"))
    want = {(p, x) for p in patterns for x in labels if p is not None and x is not None and p in x}
    rows = [(r["pattern"], r["label"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_json_round_trip(spark, synthetic, folder):
    obs = observations.complete(labelled(spark, synthetic))
    observations.write_json(obs, folder + "/j")
    back, c = observations.read_json(spark, folder + "/j")
    a = sorted((r["matrix_id"], r["row_label"], r["col_label"], r["value"], r["total_err"]) for r in obs.collect())
    assert sorted((r["matrix_id"], r["row_label"], r["col_label"], r["value"], r["total_err"]) for r in back.collect()) == a
    assert c.count() == 0


def test_read_or_build(spark, synthetic, folder):
    calls = []

    def build():
        calls.append(1)
        return labelled(spark, synthetic)

    for force in (False, False, True):
        out = observations.read_or_build(spark, folder + "/m", build, force)
    assert len(calls) == 2 and out.count() > 0


def test_results_and_reports(spark, folder):
    df = spark.createDataFrame([("a", 1.5)], "matrix_id string, p_value double")
    observations.write_results(df, folder + "/r")
    assert observations.read_results(spark, folder + "/r", df.schema).collect() == df.collect()
    observations.write_report_csv(df, folder + "/c")
    assert observations.read_curated(spark, folder + "/c", "matrix_id string, p_value double").collect() == df.collect()


def test_manifest_and_checksums(spark, folder):
    for name, body in (("a.bin", b"alpha"), ("b.bin", b"beta")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(body)
    m = files.manifest(spark, folder)
    assert {r["file"]: (r["sha256"], r["size_bytes"]) for r in m.collect()} == {"a.bin": (hashlib.sha256(b"alpha").hexdigest(), 5), "b.bin": (hashlib.sha256(b"beta").hexdigest(), 4)}
    want = spark.createDataFrame(
        [("a.bin", "md5:" + hashlib.md5(b"alpha").hexdigest()), ("b.bin", "sha1:00"), ("c.bin", "00"), ("a.bin", "adler32:1")], "file string, checksum string"
    )
    got = sorted((r["file"], r["algorithm"], r["status"]) for r in files.verify_checksums(m, want).collect())
    assert got == [("a.bin", "adler32", "skipped"), ("a.bin", "md5", "ok"), ("b.bin", "sha1", "mismatch"), ("c.bin", "sha256", "missing")]


def test_provenance(spark, folder):
    ids = spark.createDataFrame([("a",), ("b",)], "matrix_id string")
    lost = spark.createDataFrame([("a", "load_a", "empty", "table")], "matrix_id string, step string, reason string, fallback_to string")
    src = spark.createDataFrame([("a", "api", "1", "10.1/x"), ("b", "api", "2", "10.1/x")], "matrix_id string, source_type string, identifier string, doi string")
    p = provenance.build(ids, F.when(F.col("matrix_id") == "b", "placeholder").otherwise("api"), sources=src, fallbacks=lost)
    provenance.write(p, folder + "/p")
    back = provenance.flags(provenance.read(spark, folder + "/p"))
    r = {x["matrix_id"]: x for x in back.collect()}
    assert r["a"]["has_fallbacks"] and not r["b"]["has_fallbacks"] and r["b"]["is_placeholder"]
    assert r["a"]["build_timestamp"].endswith("Z") and provenance.distinct_dois(p).count() == 1 and provenance.warnings(p).count() == 2


# ----------------------------------------------------------- published tables
def _table(spark, body):
    return spark.createDataFrame([(1, json.dumps(body))], "id int, json string").select("id", F.from_json("json", PUBLISHED_TABLE).alias("t")).select("id", "t.*")


def test_variable_style(spark):
    t = _table(
        spark,
        {
            "name": "T", "independent_variables": [{"header": {"name": "x"}, "values": [{"value": 1}, {"value": 2}, {"value": 3}]}, {"header": {"name": "bin"}, "values": [{"low": 0, "high": 10}, {"low": 10, "high": 20}, {"low": 20, "high": 30}]}],
            "dependent_variables": [{"header": {"name": "y"}, "values": [{"value": 10, "errors": [{"label": "stat", "symerror": 1}, {"label": "lumi", "asymerror": {"plus": 4, "minus": -2}}, {"label": "other", "symerror": 4}]}, {"value": 20}, {"value": "-"}]}],
        },
    )
    rows = published.flat_table(t, ["id"]).orderBy("pos").collect()
    assert [r["x"]["x"]["centre"] for r in rows] == [1, 2, 3] and [r["x"]["bin"]["centre"] for r in rows] == [5, 15, 25]
    y = rows[0]["y"]["y"]
    assert (y["value"], y["stat_err"], y["sys_err"]) == (10, 1, 5) and y["total_err"] == pytest.approx(26**0.5)
    assert rows[1]["y"]["y"]["total_err"] == 0 and rows[2]["y"]["y"]["value"] is None


def test_row_style_splits_headers_by_x(spark):
    t = _table(
        spark,
        {
            "headers": [{"name": "Q2"}, {"name": "BETA"}, {"name": "XP"}, {"name": "SIGMA"}],
            "values": [{"x": [{"value": "4.0"}, {"value": "0.1"}, {"value": "0.001"}], "y": [{"value": "0.03", "errors": [{"label": "stat", "symerror": 0.003}, {"label": "sys", "asymerror": {"plus": 0.004, "minus": -0.004}}]}]}],
        },
    )
    wide = published.usable_tables(t, ["id"], ["stat", "sys"]).first()
    assert (wide["Q2"], wide["beta"], wide["xP"], wide["value"]) == (4.0, 0.1, 0.001, 0.03) and wide["total_err"] == pytest.approx(0.005)
    assert published.first_xy(t, ["id"]).first()["t"] == 4.0


def test_roles():
    r = wrangle.resolve_roles(["Q**2 [GEV**2]", "BETA", "X(NAME=POMERON)", "SIG(C=REDUCED)", "SIG(C=REDUCED)_stat"])
    assert r["Q2"] == "Q**2 [GEV**2]" and r["stat_err"] == "SIG(C=REDUCED)_stat"
    with pytest.raises(ValueError, match="beta, value, xP"):
        wrangle.resolve_roles(["q2", "other"])
    assert wrangle.curve_roles(["|t|", "dsigma/dt", "stat_uncertainty"]) == {"t": "|t|", "dsigma_dt": "dsigma/dt", "stat_err": "stat_uncertainty"}


def test_correlation_files(spark, folder):
    with open(folder + "/c.json", "w") as f:
        json.dump({"correlation": [[1, 0.5], [0.5, 1]]}, f)
    with open(folder + "/c.csv", "w") as f:
        f.write("1,0.5\n0.5,1\n")
    a = sorted(published.correlation_file(spark, folder + "/c.json", "m").collect())
    assert a == sorted(published.correlation_csv(spark, folder + "/c.csv", "m").collect()) and len(a) == 4
    tables = spark.createDataFrame([(1, "Correlation matrix"), (1, "T correlation"), (2, "T")], "record_id long, name string")
    res = spark.createDataFrame([(2, "Correlation data", "x.csv"), (1, "correlation", "y.csv")], "record_id long, description string, location string")
    got = {r["record_id"]: (r["name"], r["kind"]) for r in cov.pick_correlation_table(tables, res, "T").collect()}
    assert got == {1: ("T correlation", "table"), 2: ("x.csv", "resource")}


# ----------------------------------------------------------------------- cuts
def test_cuts_count_and_refuse_empty(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    kept, seen = wrangle.apply_cuts(df, {"x": (2.0, 5.0)})
    assert kept.count() == 4 and wrangle.require_rows(seen) == {"n_before": 10, "n_after": 4}
    none, seen = wrangle.apply_cuts(df, {"x": (20.0, None)}, "other")
    none.count()
    with pytest.raises(ValueError):
        wrangle.require_rows(seen)


def test_clean_and_labels(spark):
    df = spark.createDataFrame(
        [("m", 1.0, 3.0, 4.0, 0.0), ("m", float("nan"), 1.0, 0.0, 0.0), ("m", 2.0, 0.0, 0.0, 0.0), ("m", 3.0, 0.0, 0.0, 9.0)],
        "matrix_id string, value double, stat_err double, sys_err double, total_err double",
    )
    assert sorted(r["total_err"] for r in cellops.clean(df).collect()) == [5.0, 9.0]
    q = spark.createDataFrame([("m", 10.0, 0.1, 0.001), ("m", 4.0, 0.1, 0.002)], "matrix_id string, Q2 double, beta double, xP double")
    got = {r["row_label"]: r["row_idx"] for r in cellops.index_labels(wrangle.dis_labels(q)).collect()}
    assert got == {"Q2=10.0_beta=0.100": 0, "Q2=4.0_beta=0.100": 1}


def test_category_cells(spark):
    text = spark.createDataFrame([("VBF in diphoton",), ("gluon fusion",), ("nothing",)], "t string")
    r = [(x["a"], x["b"]) for x in text.select(wrangle.tag_first_match(F.col("t"), wrangle.ROW_MODES).alias("a"), wrangle.tag_first_match(F.col("t"), wrangle.ROW_MODE_PHRASES).alias("b")).collect()]
    assert r[0][0] == "VBF" and r[1][1] == "ggF"


# --------------------------------------------------------------------- curves
def test_curves(spark):
    t = np.linspace(0.01, 0.5, 60)
    df = spark.createDataFrame(
        pd.concat([pd.DataFrame({"matrix_id": k, "t": t + s, "y": a * np.exp(-b * (t + s)), "total_err": 0.05 * a * np.exp(-b * (t + s))}) for k, s, a, b in (("8", 0.0, 500, 19.9), ("13", 0.007, 600, 20.4))])
    )
    sl = {r["matrix_id"]: r["slope"] for r in curves.log_slope(df, 0.02, 0.10).collect()}
    assert sl["8"] == pytest.approx(19.9) and 18 < sl["13"] < 22
    c = curves.shape_curves(df, 0.02, 0.3, 20).toPandas()
    assert len(c) == 40 and c["t"].min() == pytest.approx(0.02) and c["t"].max() == pytest.approx(0.3)
    one = c[c.row_label == "8"].sort_values("t")
    assert one["value"].to_numpy() == pytest.approx(np.log(500) - 19.9 * one["t"].to_numpy(), rel=1e-9)
    assert one["total_err"].to_numpy() == pytest.approx(np.full(20, 0.05), rel=1e-9)
    n = curves.shape_curves(df, 0.02, 0.3, 20, log=False, normalize=True).toPandas().query("row_label == '13'").sort_values("t")
    assert np.trapezoid(n["value"], n["t"]) == pytest.approx(1)
    r = curves.strict_range(df.withColumn("t", F.when(F.col("matrix_id") == "8", F.col("t") + 10).otherwise(F.col("t"))), 0.02, 0.3).first()
    assert (r["t_lo"], r["t_hi"]) == (0.02, 0.3)


# ----------------------------------------------------------------- covariance
@pytest.fixture(scope="module")
def correlated(spark, synthetic):
    y, e, _ = synthetic["rank1"]
    obs = frame(spark, {"m": (y, e)}).withColumn("seq", F.col("row_idx").cast("long") * 4 + F.col("col_idx"))
    n = y.size
    rho = np.array([[0.4 ** abs(i - j) if i // 4 == j // 4 else 0.0 for j in range(n)] for i in range(n)])
    c = rho * np.outer(e.ravel(), e.ravel())
    i, j = np.nonzero(c)
    return obs, spark.createDataFrame(pd.DataFrame({"matrix_id": "m", "i": i, "j": j, "c": c[i, j]})), c, y


def test_precision_and_factor(spark, correlated):
    _, table, c, _ = correlated
    for df, col, want in ((cov.precision(table), "p", np.linalg.inv(c)), (cov.lower_factor(table), "l", np.linalg.cholesky(c))):
        p = df.toPandas()
        got = np.zeros_like(c)
        got[p["i"], p["j"]] = p[col]
        assert got == pytest.approx(want, rel=1e-8, abs=1e-8 * np.abs(want).max())


def test_full_chi2_and_noise(spark, correlated):
    obs, table, c, y = correlated
    r = obs.select("matrix_id", "seq", F.col("value").alias("r"))
    assert cov.full_chi2(r, cov.precision(table)).first()["chi2"] == pytest.approx(y.ravel() @ np.linalg.inv(c) @ y.ravel(), rel=1e-8)
    z = cov.correlated_noise(cov.lower_factor(table), 3000).toPandas().pivot(index="replicate", columns="seq", values="noise").to_numpy()
    assert np.cov(z.T) == pytest.approx(c, abs=0.15 * c.max())


def test_generalised_fits_agree(spark, correlated):
    obs, table, c, y = correlated
    prec = cov.precision(table)
    group = cov.gls_fit(obs, prec, FitOptions(max_iter=2, tol=0.0)).first()
    _, _, chi2 = cov.gls_rank1(obs, prec, rounds=2, inner=6)
    assert chi2.first()["chi2"] == pytest.approx(group["chi2_rank1"], rel=1e-3)
    assert group["chi2_rank2"] < group["chi2_rank1"]
    diag = obs.select("matrix_id", F.col("seq").alias("i"), F.col("seq").alias("j"), F.pow("total_err", 2).alias("c"))
    same = cov.gls_fit(obs, cov.precision(diag), FitOptions(rank=1)).first()
    assert same["chi2_rank1"] == pytest.approx(fitops.fit(obs.drop("seq"), FitOptions(rank=1)).summary.first()["chi2_rank1"], rel=1e-6)


def test_flat_correlations_need_a_square(spark):
    flat = spark.createDataFrame([("a", i, float(i)) for i in range(9)] + [("b", i, 1.0) for i in range(7)], "t string, pos int, value double")
    got = cov.from_flat(flat, ["t"]).collect()
    assert len(got) == 9 and {(r["i"], r["j"]): r["c"] for r in got}[(1, 2)] == 5.0
    rho = spark.createDataFrame([("m", 0, 0, 4.0), ("m", 0, 1, 1.0), ("m", 1, 0, 1.0), ("m", 1, 1, 0.0)], "matrix_id string, i long, j long, c double")
    r = {(x["i"], x["j"]): x["rho"] for x in cov.to_correlation(rho).collect()}
    assert r == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 1.0}


def test_singular_values(spark, synthetic):
    y, e, _ = synthetic["rank2"]
    c = frame(spark, {"m": (y, e)})
    want = np.linalg.svd(y / e, compute_uv=False)
    for limit in (1000, 5):
        s = sorted((r["s"] for r in spectrum.singular_values(c, 2, group_max_cells=limit).collect()), reverse=True)
        assert s == pytest.approx(want[:2], rel=1e-9)


def test_block_spectrum(spark):
    """Several matrices at once in the block form: wide, of low rank, with few columns, and one that cannot settle in time."""
    rng = np.random.default_rng(5)
    q = lambda n, m: np.linalg.qr(rng.standard_normal((n, m)))[0]
    decay = q(60, 40) @ np.diag(0.7 ** np.arange(40)) @ q(40, 40).T
    low = rng.standard_normal((30, 3)) @ rng.standard_normal((3, 50))
    tables = {"decay": decay, "low": low, "narrow": rng.standard_normal((45, 4))}
    c = frame(spark, {n: (m, np.ones_like(m)) for n, m in tables.items()})
    got = spectrum.singular_values(c, 6, weighted=False, group_max_cells=50).toPandas()
    assert got.settled.all()
    for name, m in tables.items():
        mine = got[got.matrix_id == name].sort_values("k").s.to_numpy()
        want = np.linalg.svd(m, compute_uv=False)[:6]
        assert len(mine) == min(6, *m.shape) and np.abs(mine - want).max() < 1e-7 * want[0]
    short = spectrum.singular_values(c.filter("matrix_id = 'decay'"), 6, weighted=False, group_max_cells=50, rounds=1)
    assert not short.first()["settled"]
    cond = spectrum.condition_number(spectrum.singular_values(c.filter("matrix_id = 'narrow'"), 4, weighted=False, group_max_cells=50)).first()
    assert cond["condition_number"] == pytest.approx(np.linalg.cond(tables["narrow"]), rel=1e-8)


# ----------------------------------------------------------------- validation
def test_spot_checks(spark):
    cells = spark.createDataFrame(
        [("ggF", "γγ", 1.04, 0.1, 0), ("VBF_x", "t=0.100", -2.0, 0.1, 1), ("VBF_y", "t=0.200", 2.0, 0.1, 2)], "row_label string, col_label string, value double, total_err double, seq int"
    )
    want = spark.createDataFrame(
        [(1, "ggF", "γγ", 1.0, 0.1, False), (2, "VBF", "0.1", 0.13, 0.1, True), (3, "VBF_q", "t=0.2", 3.0, 0.1, False), (4, "no", "no", 1.0, 0.1, False)],
        "check_id int, row_label string, col_label string, expected double, tolerance double, is_log boolean",
    )
    r = {x["check_id"]: x for x in validate.spot_checks(cells, want).collect()}
    assert r[1]["passed"] and r[1]["tier"] == 0 and r[2]["passed"] and r[2]["tier"] == 1
    assert r[3]["tier"] == 2 and r[3]["matched_row"] == "VBF_x" and not r[3]["passed"] and not r[4]["passed"] and "not found" in r[4]["message"]
    plan = validate.spot_checks(cells, want)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    rep = validate.identity_report(validate.spot_checks(cells, want)).first()
    assert rep["n_checks"] == 4 and rep["n_passed"] == 2 and not rep["all_passed"]


def test_compare_runs(spark):
    a = spark.createDataFrame([("x", 1.0, "u"), ("y", 2.0, "v"), ("z", 3.0, "w")], "k string, a double, b string")
    b = spark.createDataFrame([("x", 1.0 + 1e-12, "u"), ("y", 2.1, "q")], "k string, a double, b string")
    r = {x["k"]: x["mismatches"] for x in validate.compare_runs(a, b, ["k"]).collect()}
    assert r == {"x": [], "y": ["a", "b"], "z": ["missing in second"]}
    assert not validate.reproducible(validate.compare_runs(a, b, ["k"])).first()["passed"]
    assert validate.reproducible(validate.compare_runs(a, a, ["k"])).first()["passed"]
    assert validate.result_hash(a, ["k"]).select("hash").distinct().count() == 3


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p = np.round(np.concatenate([rng.random(500), np.full(250, 0.2)]), 3)
    r = validate.ks_uniform(spark.createDataFrame(pd.DataFrame({"g": "a", "p": p})), ["g"]).first()
    s = np.sort(p)
    i = np.arange(1, len(s) + 1)
    assert r["ks_statistic"] == pytest.approx(max(np.max(i / len(s) - s), np.max(s - (i - 1) / len(s)))) and r["ks_pvalue"] < 1e-6


def test_checks(spark, synthetic):
    c = labelled(spark, synthetic)
    r = {(x["matrix_id"], x["check"]): x["passed"] for x in checks.coverage(c).collect()}
    assert r[("rank1", "data_coverage")] and r[("rank1", "matrix_completeness")]
    o = {x["matrix_id"]: x for x in checks.overall(checks.run_checks([checks.coverage(c), checks.value_ranges(c)]), ["matrix_id"]).collect()}
    assert o["rank1"]["n_checks"] == 6


def test_interpolation_of_long_curves(spark):
    t = np.linspace(1, 50, 400)
    df = spark.createDataFrame(pd.DataFrame({"matrix_id": "c", "t": t, "y": np.sin(t)}))
    grid = curves.even_grid(spark.createDataFrame([(0.5, 49.0)], "t_lo double, t_hi double"), 33)
    for spread in (False, True):
        got = curves.interpolate(df, grid, ["y"], spread=spread).toPandas().sort_values("col_idx")
        assert len(got) == 33 and got["y"].isna().tolist()[0]
        ok = got[got["y"].notna()]
        assert ok["y"].to_numpy() == pytest.approx(np.interp(ok["t"], t, np.sin(t)))
