"""Registered queries against DuckDB. A cross-section runs by default; CROSSFACTOR_ALL=1 runs every one at sf0.01."""

import os
import re
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import check  # noqa: E402

DATA = "/root/testdata/sf0.01"
SOME = [
    "rank1_chi2", "cells_cut_counts", "last_wins", "gini", "window_share", "trapezoid_norm", "source_priority", "mode_cosine_pairs",
    "rerun_compare", "ks_uniform", "chi2_tail", "clopper_pearson", "row_style_tables", "p_value", "preset_catalogue", "page_records",
]
entry = check.load_entry()
SQL = entry.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("CROSSFACTOR_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return check.duck(DATA)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert check.compare(entry.queries()[name](spark, DATA), con, SQL[name]) == ""
    spark.catalog.clearCache()


def test_entry_returns_a_verdict(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data here")
    r = entry.entry(spark).collect()
    assert len(r) == 1 and r[0]["verdict"] in ("REJECTED", "NOT_REJECTED", "INCONCLUSIVE")


def test_registry_is_complete():
    q = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
    assert set(SQL) < set(entry.queries()) and len(q) > 100
    assert sorted(q - set(SQL)) == ["baseline_analysis", "mode_analysis"]


def test_no_shortcuts_in_the_library():
    for folder, _, names in os.walk(os.path.join(ROOT, "crossfactor")):
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    body = f.read()
                assert not re.search(r"localCheckpoint|crossJoin|toPandas\(|\.sample\(", body), n
