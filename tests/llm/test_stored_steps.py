"""What stored steps leave on disk, and components by either join."""

import glob
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossfactor.llm import components as c
from crossfactor.session import CLEANUP, cut


def shuffle_files(spark):
    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", "/tmp")
    return {f for d in top.split(",") for f in glob.glob(f"{d}/blockmgr-*/*/shuffle_*")}


def test_stored_rows_leave_no_shuffle_files(spark):
    def counted():
        return spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("s"))

    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    counted().collect()
    assert shuffle_files(spark) - before  # a plain query's files stay, so this test sees where they are
    before = shuffle_files(spark)
    stored = cut(counted().join(counted().withColumnRenamed("s", "t"), "k"))
    left = 1
    for _ in range(50):
        left = len(shuffle_files(spark) - before)
        if not left:
            break
        time.sleep(0.2)
    assert left == 0
    assert stored.where("s = t").count() == 97 == stored.count()
    assert spark.conf.get(CLEANUP, None) == setting


@pytest.mark.parametrize("sent", [0, 100_000])
def test_components_by_either_join(spark, monkeypatch, sent):
    monkeypatch.setattr(c, "SENT", sent)
    rng = np.random.default_rng(5)
    edges = [tuple(map(int, x)) for x in rng.integers(0, 400, (300, 2))] + [(1000, k) for k in range(1001, 1200)] + [(2000 + k, 2001 + k) for k in range(40)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    rows = c.components(spark.createDataFrame(edges + [(None, 1), (3, None), (5, 5)], "a long, b long"), "a", "b").collect()
    assert len(rows) == len(label) and {r["node"]: r["component"] for r in rows} == label
