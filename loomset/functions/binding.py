"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row. An expression that is used inside a lambda, or several times,
    would otherwise be computed each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
