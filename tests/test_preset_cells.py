"""Cells made preset by preset."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossfactor.operators import preset_cells
from crossfactor.operators.presets import ELASTIC_PRESETS, Preset


def curves(spark):
    rows = [(m, round(0.01 * k, 2), float(np.exp(-b * 0.01 * k)), 0.01, src) for m, b, src in (("a", 20, "H1"), ("b", 18, "ZEUS"), ("c", 15, "H1")) for k in range(1, 36)]
    return spark.createDataFrame(rows, "matrix_id string, t double, y double, total_err double, source string")


def test_published_curve_presets(spark):
    got = preset_cells.curve_cells(curves(spark), ELASTIC_PRESETS, 0.01, 0.35, 20).toPandas()
    assert set(got.preset) == {p.name for p in ELASTIC_PRESETS}
    for p in ELASTIC_PRESETS:
        own = got[got.preset == p.name]
        assert len(own) == 3 * (p.n_points or 20) and own["mode"].eq(p.mode or "normalized").all()
        assert own.axis_value.min() == pytest.approx(p.range_min or 0.01) and own.axis_value.max() == pytest.approx(p.range_max or 0.35)
        a = own[own.row_label == "a"].sort_values("col_idx")
        # an exponential is a straight line in ln y, whatever the grid
        assert np.allclose(np.diff(a.value) / np.diff(a.axis_value), -20, atol=1e-6)
    raw = got[(got.preset == "raw_mode") & (got.row_label == "a")].sort_values("col_idx")
    assert np.allclose(raw.value, -20 * raw.axis_value)
    unit = got[(got.preset == "res_200") & (got.row_label == "a")].sort_values("col_idx")
    assert np.trapezoid(np.exp(unit.value), unit.axis_value) == pytest.approx(1.0, abs=1e-9)


def test_presets_choose_curves(spark):
    some = [Preset("h1", subset="h1"), Preset("without", exclude_element="a"), Preset("two", include_rows=("a", "b")), Preset("none", subset="nobody")]
    got = preset_cells.curve_cells(curves(spark), some, 0.05, 0.2, 5)
    kept = {r["preset"]: r["rows"] for r in got.groupBy("preset").agg(F.array_sort(F.collect_set("row_label")).alias("rows")).collect()}
    assert kept == {"h1": ["a", "c"], "without": ["b", "c"], "two": ["a", "b"]}
    with pytest.raises(ValueError, match="cuts are for facts"):
        preset_cells.curve_cells(curves(spark), [Preset("cut", cuts=(("t_min", 1.0),))], 0.05, 0.2)


def test_fact_presets_cut_before_the_cells(spark):
    rng = np.random.default_rng(0)
    rows = [("m", f"r{rng.integers(3)}", f"c{rng.integers(4)}", float(rng.integers(0, 20)), float(rng.random()), float(rng.normal(5))) for _ in range(600)]
    rows += [("m", "thin", "c0", 15.0, 0.5, 1.0), ("m", "thin", "c0", 15.0, 0.5, 3.0), ("m", "r0", "c0", None, 0.5, 2.0)]
    facts = spark.createDataFrame(rows, "matrix_id string, row_label string, col_label string, Q2 double, beta double, x double")
    some = [Preset("all"), Preset("high", cuts=(("Q2_min", 10.0),)), Preset("mid", cuts=(("beta_min", 0.2), ("beta_max", 0.8))), Preset("dense", cuts=(("min_xP_points", 2.0),))]
    got = preset_cells.fact_cells(facts, some, F.col("x")).toPandas().set_index(["preset", "row_label", "col_label"])
    pdf = facts.toPandas()
    for name, keep in (("all", pdf.x.notna()), ("high", pdf.Q2 >= 10), ("mid", pdf.beta.between(0.2, 0.8)), ("dense", pdf.row_label != "thin")):
        want = pdf[keep].groupby(["row_label", "col_label"]).x.agg(["count", "mean", "std"])
        want = want[want["count"] >= 2]
        own = got.loc[name]
        assert set(own.index) == set(want.index)
        assert np.allclose(own.value.loc[want.index], want["mean"]) and (own.n_obs.loc[want.index] == want["count"]).all()
        assert np.allclose(own.total_err.loc[want.index], want["std"] / np.sqrt(want["count"]))
    with pytest.raises(ValueError, match="no column"):
        preset_cells.fact_cells(facts, [Preset("lost", cuts=(("W_min", 1.0),))], F.col("x"))
