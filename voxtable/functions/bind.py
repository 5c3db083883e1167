"""A value that an expression uses many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once a row: inside a lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)
