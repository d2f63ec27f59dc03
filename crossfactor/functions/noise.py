"""Reproducible noise: a value depends on its key only, never on partitioning or row order."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_TWO32 = 4294967296.0


def _key(parts) -> Column:
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *cols).cast("binary"))


def _unit(digest: Column, start: int) -> Column:
    return (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 0.5) / _TWO32


def hashed_uniform(*parts) -> Column:
    """Uniform on (0, 1) from the md5 of the joined parts."""
    return _unit(_key(parts), 1)


def hashed_normal(*parts) -> Column:
    """Standard normal (Box-Muller) from the md5 of the joined parts."""
    digest = _key(parts)
    return F.sqrt(-2.0 * F.log(_unit(digest, 1))) * F.cos(2.0 * math.pi * _unit(digest, 9))
