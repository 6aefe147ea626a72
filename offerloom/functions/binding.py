"""Name an intermediate value inside one expression.

A Column used twice is computed twice and, worse, copied twice into the plan.
Mapping over a one-element array gives the value a name instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_if(value: Column, test: Callable[[Column], Column]) -> Column:
    """The value when it passes the test, else null."""
    return F.get(F.filter(F.array(value), test), F.lit(0))
