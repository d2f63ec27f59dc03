"""Sums that do not depend on layout, held against exact fractions."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from crossfactor.operators import exactsum


def _rows():
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        rows.append(("mixed", rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-12, 18)))
        rows.append(("plain", rng.uniform(1, 1e5)))
        rows.append(("negative", -rng.expovariate(1)))
    rows += [("cancels", 1e22), ("cancels", 1.0), ("cancels", -1e22), ("cancels", 2.0**-40)]
    rows += [("edges", x) for x in (2.0**32, -(2.0**32), 2.0**-32, 2.0**64, 1.5 * 2.0**960, -1.5 * 2.0**960, 0.1)]
    rows += [("zero", 0.0), ("zero", -0.0), ("none", None), (None, 2.5), (None, 0.5)]
    rows += [("inf", math.inf), ("inf", 1.0), ("nan", math.inf), ("nan", -math.inf)]
    return rows


def test_sums_are_exact_and_the_same_on_any_layout(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, x double")
    outs = [
        {r.k: r.total for r in exactsum.exact_sums(d, ["k"], {"total": F.col("x")}).collect()}
        for d in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("x")).repartition(3, "x"))
    ]
    for k in {k for k, _ in rows}:
        got = [o[k] for o in outs]
        xs = [x for key, x in rows if key == k and x is not None]
        if k == "none":
            assert got == [None] * 3
        elif k == "inf":
            assert got == [math.inf] * 3
        elif k == "nan":
            assert all(math.isnan(g) for g in got)
        else:
            assert len({g.hex() for g in got}) == 1
            want = float(sum(Fraction(x) for x in xs))
            assert got[0] == pytest.approx(want, rel=4e-16, abs=0)


def test_no_rows_give_no_groups(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert exactsum.exact_sums(df, ["k"], {"total": F.col("x")}).count() == 0
    assert exactsum.exact_moments(df, ["k"], F.col("x")).count() == 0


def test_moments_keep_their_digits(spark):
    rng = random.Random(6)
    xs = [1e9 + rng.random() for _ in range(500)]
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", None)], "k string, x double")
    got = {r.k: r for r in exactsum.exact_moments(df, ["k"], F.col("x"), F.lit(1e9)).collect()}
    fr = [Fraction(x) for x in xs]
    mean = sum(fr) / len(fr)
    assert got["a"].n == 500 and got["a"].mean == pytest.approx(float(mean), rel=1e-15)
    assert got["a"].m2 == pytest.approx(float(sum((x - mean) ** 2 for x in fr)), rel=1e-12)
    assert (got["b"].n, got["b"].mean, got["b"].m2) == (0, None, None)


def test_chi2_is_exact(spark):
    rng = random.Random(7)
    rows = [("m", rng.gauss(10, 1), 10.0, 0.5 + rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "matrix_id string, value double, pred1 double, total_err double")
    got = [exactsum.exact_chi2(d, ["matrix_id"]).first() for d in (df, df.repartition(5, "value"))]
    want = sum(Fraction((y - p) / e) ** 2 for _, y, p, e in rows)
    assert got[0] == got[1] and got[0].n_cells == 300
    assert got[0].chi2 == pytest.approx(float(want), rel=4e-16)


def test_rows_meet_plain_arithmetic_only(spark):
    """No function of arrays runs once a row: those are not compiled, and made the query several times as slow."""
    df = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    plan = exactsum.exact_moments(df, ["k"], F.col("x"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    deepest = max(i for i, line in enumerate(plan) if "Aggregate [" in line)
    assert "lambda" not in "".join(plan[deepest:])


def test_counts_of_the_first_column(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", None, 2.0), ("a", math.inf, None), ("b", None, None)], "k string, x double, y double")
    got = exactsum.exact_sums(df, ["k"], {"s": [F.col("x"), F.col("y")], "t": F.col("y")}, counts=True)
    assert {(r.k, r.s, r.s_n, r.t, r.t_n) for r in got.collect()} == {("a", math.inf, 2, 7.0, 2), ("b", None, 0, None, 0)}
