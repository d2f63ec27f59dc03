import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossfactor.functions import special
from crossfactor.functions.noise import hashed_normal, hashed_uniform


def test_gamma_tail_closed_forms():
    x = np.array([0.0, 0.3, 1.0, 5.0, 40.0, 300.0])
    assert special.gamma_tail(1.0, x) == pytest.approx(np.exp(-x))
    assert special.gamma_tail(3.0, x) == pytest.approx(np.exp(-x) * (1 + x + x * x / 2), rel=1e-10)
    assert special.gamma_tail(0.5, x) == pytest.approx([math.erfc(math.sqrt(v)) for v in x], rel=1e-10)


def test_beta_cdf_is_a_binomial_tail():
    for n, k, p in ((10, 3, 0.2), (50, 49, 0.97), (1000, 12, 0.01), (7, 1, 0.5)):
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert special.beta_cdf(np.array([k]), np.array([n - k + 1]), np.array([p]))[0] == pytest.approx(tail, rel=1e-9)


def test_intervals(spark):
    df = spark.createDataFrame([(0, 20), (20, 20), (0, 0), (3, 40)], "k long, n long")
    r = {(x["k"], x["n"]): x for x in df.select("k", "n", special.clopper_pearson("k", "n", F.lit(0.05)).alias("c"), special.posterior_interval("k", "n", F.lit(0.05)).alias("q")).collect()}
    assert r[(0, 20)]["c"]["lower"] == 0 and r[(0, 20)]["c"]["upper"] == pytest.approx(1 - 0.025 ** (1 / 20), rel=1e-9)
    assert r[(20, 20)]["c"]["upper"] == 1 and r[(20, 20)]["c"]["lower"] == pytest.approx(0.025 ** (1 / 20), rel=1e-9)
    assert tuple(r[(0, 0)]["c"]) == (0, 1)
    lo, hi = r[(3, 40)]["c"]
    tail = lambda p, ks: sum(math.comb(40, i) * p**i * (1 - p) ** (40 - i) for i in ks)
    assert tail(lo, range(3, 41)) == pytest.approx(0.025) and tail(hi, range(0, 4)) == pytest.approx(0.025)
    assert r[(0, 20)]["q"]["lower"] == pytest.approx(1 - 0.975 ** (1 / 21), rel=1e-9)


def test_chi2_pvalue(spark):
    df = spark.createDataFrame([(3.0, 2), (7.0, 4), (1.0, 0), (1.0, -5)], "x double, n int")
    r = [x["p"] for x in df.select(special.chi2_pvalue("x", "n").alias("p")).collect()]
    assert r[0] == pytest.approx(math.exp(-1.5)) and r[1] == pytest.approx(math.exp(-3.5) * 4.5) and r[2] is None and r[3] is None


def test_correlation_pvalue(spark):
    df = spark.createDataFrame([(0.5, 4), (0.9, 2), (0.0, 10), (1.0, 9)], "r double, n long")
    p = [x["p"] for x in df.select(special.correlation_pvalue("r", "n").alias("p")).collect()]
    t = 0.5 * math.sqrt(2 / 0.75)
    assert p[0] == pytest.approx(1 - t / math.sqrt(2 + t * t)) and p[1] == 1 and p[2] == pytest.approx(1) and p[3] == pytest.approx(0)


def test_noise_is_standard_and_layout_free(spark):
    df = spark.range(20000).select("id", hashed_normal(1, F.col("id")).alias("z"), hashed_uniform(1, F.col("id")).alias("u"))
    m = df.agg(F.avg("z"), F.stddev("z"), F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(m[0]) < 0.03 and abs(m[1] - 1) < 0.03 and abs(m[2] - 0.5) < 0.01 and m[3] > 0 and m[4] < 1
    a = df.filter("id < 50").orderBy("id").collect()
    b = spark.range(20000).repartition(7).select("id", hashed_normal(1, F.col("id")).alias("z"), hashed_uniform(1, F.col("id")).alias("u")).filter("id < 50").orderBy("id").collect()
    assert a == b
