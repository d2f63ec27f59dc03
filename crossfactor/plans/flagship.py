"""The smallest complete question the library answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crossfactor.operators.fit import FitOptions
from crossfactor.operators.ranktest import rank_test, verdict
from crossfactor.plans.cellsets import order_value_cells


def order_value_test(spark: SparkSession, sf_dir: str, n_bootstrap: int = 1000, opt: FitOptions = FitOptions()) -> DataFrame:
    """Rank test of the nation x segment table of mean order values, with its verdict."""
    test = rank_test(order_value_cells(spark, sf_dir), n_bootstrap=n_bootstrap, opt=opt)
    return verdict(test.summary)
