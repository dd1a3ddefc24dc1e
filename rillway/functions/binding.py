"""A computed value used more than once in one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once.

    Written out twice, it would be computed twice wherever a lambda or a condition is involved. As
    the variable of a lambda over a one-element array it is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
