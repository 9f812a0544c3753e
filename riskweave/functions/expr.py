"""Small helpers over Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value evaluated once; keeps generated code small where it is used often."""
    return F.get(F.transform(F.array(value), f), 0)
