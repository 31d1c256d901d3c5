"""Pixel expressions: display bytes, gray values, intensity filters, masks and z-scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.binding import let


def display_byte(v: Column) -> Column:
    """Clipped to 0..255 and cut to a whole number."""
    return F.greatest(F.least(v, F.lit(255.0)), F.lit(0.0)).cast("int")


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.round(0.299 * r + 0.587 * g + 0.114 * b)


def bright_or_black(b: Column, g: Column, r: Column, least: float = 128) -> tuple[Column, Column, Column]:
    """A pixel stays as it is if any channel reaches ``least``, else it turns black."""
    keep = F.greatest(b, g, r) >= least
    return tuple(F.when(keep, x).otherwise(F.lit(0)) for x in (b, g, r))


def binary_mask(mask: Column) -> Column:
    """Array of 1 where the mask is positive, else 0."""
    return F.transform(mask, lambda m: (m > 0).cast("double"))


def masked(vals: Column, mask: Column) -> Column:
    """Values times a 0/1 mask."""
    return F.zip_with(vals, mask, lambda v, m: v * m)


def z_scores(vals: Column) -> Column:
    """(v - mean) / population standard deviation over the whole array; null where the deviation is 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def scores(x: Column) -> Column:
        n = F.size(x).cast("double")
        around = lambda mean: F.transform(x, lambda v: v - mean)
        over = lambda y: let(F.nullif(F.sqrt(total(F.transform(y, lambda v: v * v)) / n), F.lit(0.0)), lambda dev: F.transform(y, lambda v: v / dev))
        return let(let(total(x) / n, around), over)

    return let(vals, scores)


def grounded(vals: Column, mask: Column) -> Column:
    """Shifted so that the least value is 0, and 0 outside the mask (the least counts what the mask has zeroed)."""
    return let(vals, lambda x: let(F.array_min(x), lambda least: F.zip_with(x, mask, lambda v, m: F.when(m > 0, v - least).otherwise(F.lit(0.0)))))


def flipped(vals: Column, h: Column, w: Column, horizontal: bool) -> Column:
    """Row-major values mirrored left to right, or top to bottom."""
    at = lambda i: (i / w).cast("int") * w + (w - 1 - i % w) if horizontal else (h - 1 - (i / w).cast("int")) * w + i % w
    return F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: F.get(vals, at(i).cast("int")))
