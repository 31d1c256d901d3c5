"""Threshold vectors as array columns. Comparisons with them are exact, so the order of operations is part of each definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.binding import let


def linspace(low: Column, high: Column, n: int) -> Column:
    """``n`` even steps from low to high: low + k * ((high - low) / (n - 1)), the last one high itself."""
    if n == 1:
        return F.array(low)

    def steps(end: Column) -> Column:
        a, b, step = end["low"], end["high"], end["step"]
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == n - 1, b).otherwise(a + k.cast("double") * step))

    ends = F.struct(low.alias("low"), high.alias("high"), ((high - low) / F.lit(n - 1)).alias("step"))
    return F.when(low.isNotNull() & high.isNotNull(), let(ends, steps))


def finite(vals: Column) -> Column:
    return F.filter(vals, lambda v: ~F.isnan(v))


def even(fields: DataFrame, n: int, descending: bool = False) -> DataFrame:
    """Adds levels: linspace from the least to the largest value of the field, reversed if ``descending``."""
    levels = let(finite(F.col("vals")), lambda vals: linspace(F.array_min(vals), F.array_max(vals), n))
    return fields.withColumn("levels", F.reverse(levels) if descending else levels)


def positive(fields: DataFrame, n: int) -> DataFrame:
    """Adds levels: linspace over the range of the positive values (null where there is none)."""
    over = F.filter(finite(F.col("vals")), lambda v: v > 0)
    return fields.withColumn("levels", let(over, lambda x: linspace(F.array_min(x), F.array_max(x), n)))


def quantiles(fields: DataFrame, n: int) -> DataFrame:
    """Adds levels: ``n`` even quantiles (linear interpolation, equal ones kept), descending.

    On the sorted array: rank q * (size - 1), between its neighbours.
    """

    def levels(ordered: Column) -> Column:
        size = F.size(ordered)

        def at(k: Column) -> Column:
            rank = k.cast("double") / F.lit(float(n - 1)) * (size - 1)
            low = F.floor(rank).cast("int")
            a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, size - 1))
            return a + (b - a) * (rank - low)

        return F.when(size > 0, F.transform(F.reverse(F.sequence(F.lit(0), F.lit(n - 1))), at))

    return fields.withColumn("levels", let(F.array_sort(finite(F.col("vals"))), levels))


def cohort(ranges: DataFrame) -> DataFrame:
    """One row: low = the largest of the images' minima, high = the least of their maxima (columns low and high)."""
    return ranges.agg(F.max("low").alias("low"), F.min("high").alias("high"))


def exploded(fields: DataFrame, *keys: str) -> DataFrame:
    return fields.select(*(keys or ("image_id",)), F.posexplode("levels").alias("k", "t"))
