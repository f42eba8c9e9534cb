"""Name an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Column expressions are trees: a value used five times at each of four levels would be
    planned, and inside array functions also computed, hundreds of times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
