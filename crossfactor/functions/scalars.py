"""Column expressions shared by the operators; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(col: Column) -> Column:
    """Neither null, NaN nor infinite."""
    inf = float("inf")
    return col.isNotNull() & ~F.isnan(col) & (col != F.lit(inf)) & (col != F.lit(-inf))


def total_error(stat: Column, sys: Column, total: Column | None = None) -> Column:
    """Quadrature sum where no total is given and a part is positive; otherwise the given total."""
    stat, sys = F.coalesce(stat, F.lit(0.0)), F.coalesce(sys, F.lit(0.0))
    given = F.coalesce(total, F.lit(0.0)) if total is not None else F.lit(0.0)
    return F.when((given == 0.0) & ((stat > 0) | (sys > 0)), F.hypot(stat, sys)).otherwise(given)


def default_error(err: Column, value: Column, share: float) -> Column:
    """The error where present and positive, else a share of the magnitude."""
    return F.when(err > 0, err).otherwise(share * F.abs(value))


def weight(err: Column) -> Column:
    """Inverse variance; 1 when there is no error."""
    return F.when(err > 0, 1.0 / (err * err)).otherwise(F.lit(1.0))


def fit_weight(err: Column, ridge: float) -> Column:
    return 1.0 / (err * err + ridge)


def pull(value: Column, predicted: Column, err: Column) -> Column:
    """Standardised residual."""
    return (value - predicted) / err


def label_number(label: str) -> Column:
    """The number behind the last '=' of the label column, null when there is none."""
    return F.element_at(F.split(F.col(label), "="), -1).try_cast("double")


def significant(col: Column, digits: int) -> Column:
    """Round to a number of significant digits."""
    mag = F.floor(F.log10(F.abs(col)))
    factor = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - mag)
    return F.when(col == 0, F.lit(0.0)).otherwise(F.round(col * factor) / factor)
