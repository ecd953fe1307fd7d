"""Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(text: Column, width: int = 20) -> Column:
    """Sorts runs of digits as numbers and letters without case: every run of digits is padded with zeros."""
    padded = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p))
    return F.array_join(padded, "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: the optimizer would else write it out within lambdas of use, which run for every row of pixels."""
    return F.element_at(F.transform(F.array(value), use), 1)


def window_start(centre: Column, side: int, limit: Column | int) -> Column:
    """First pixel of a window of `side` pixels around centre, slid (not cut) to lie in 0..limit."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.least(F.greatest(centre - side // 2, F.lit(0)), limit - side)


def whole(v: Column) -> Column:
    """Rounded half to even."""
    return F.rint(v).cast("int")
