"""Binding a value once inside an array expression.

An expression that stands inside a lambda is worked out again for every
element. ``let`` binds it to a lambda variable first, so that a maximum, a mean
or a sorted array costs one pass for a field and not one for each pixel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
