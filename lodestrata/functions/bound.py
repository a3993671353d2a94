"""A name for a value within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value worked out once, however often `of` refers to it.

    Spark writes an expression out at each place that refers to it; the element of an array of one,
    which a lambda is given, stands for it instead.
    """
    return F.get(F.transform(F.array(value), of), F.lit(0))
