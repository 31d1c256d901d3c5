"""Curves of area, perimeter and Euler characteristic over superlevel sets {v >= t}.

Every measure is a sum of weighted events (value, weight): a cell of the pixel
lattice (face, edge or vertex) enters the set with its brightest pixel, and a
pair of neighbours is boundary from the brighter one down to the darker one.
The sweep puts an image's events and its thresholds into one descending order
and reads the running sums at the thresholds: one pass for all levels, however
many there are. Equal values of an image are summed before they are shuffled.

A pixel that is NaN or null is in no set and in no pair. The image's edge is
never boundary. Foreground is 8-connected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Measures by the weight column they sum.
MEASURES = ("area", "perimeter_closed", "perimeter_open", "euler")


def lattice(fields: DataFrame, *keys: str) -> DataFrame:
    """One row for each vertex of the pixel lattice with the four pixels around it: nw, ne, sw, se (null outside)."""
    h, w, i = F.col("h"), F.col("w"), F.col("i")
    at = fields.select(*keys, "h", "w", "vals", F.explode(F.sequence(F.lit(0), (h + 1) * (w + 1) - 1)).alias("i"))
    r, c = F.floor(i / (w + 1)).cast("int"), i % (w + 1)

    def pixel(dr: int, dc: int) -> Column:
        row, col = r - dr, c - dc
        return F.when((row >= 0) & (row < h) & (col >= 0) & (col < w), F.nullif(F.get("vals", row * w + col), F.lit(float("nan"))))

    return at.select(*keys, pixel(1, 1).alias("nw"), pixel(1, 0).alias("ne"), pixel(0, 1).alias("sw"), pixel(0, 0).alias("se"))


def events(fields: DataFrame, *keys: str) -> DataFrame:
    """value, area, pairs, chi: weights of all events of each field, equal values summed."""
    zero, one = F.lit(0), F.lit(1)
    event = lambda value, area, pairs, chi: F.struct(value.alias("value"), area.alias("area"), pairs.alias("pairs"), chi.alias("chi"))
    nw, ne, sw, se = (F.col(c) for c in ("nw", "ne", "sw", "se"))
    both = lambda a, b, x: F.when(a.isNotNull() & b.isNotNull(), x)
    made = F.array(
        event(F.greatest(nw, ne, sw, se), zero, zero, one),  # the vertex
        event(F.greatest(ne, se), zero, zero, -one),  # the edge to the right of it
        event(F.greatest(sw, se), zero, zero, -one),  # the edge below it
        event(se, one, zero, one),  # the pixel itself
        event(both(sw, se, F.greatest(sw, se)), zero, one, zero),
        event(both(sw, se, F.least(sw, se)), zero, -one, zero),
        event(both(ne, se, F.greatest(ne, se)), zero, one, zero),
        event(both(ne, se, F.least(ne, se)), zero, -one, zero),
    )
    rows = lattice(fields, *keys).select(*keys, F.inline(made)).where("value is not null")
    return rows.groupBy(*keys, "value").agg(*[F.sum(c).alias(c) for c in ("area", "pairs", "chi")])


def curves(fields: DataFrame, *keys: str) -> DataFrame:
    """keys, k, t, area, perimeter_closed, perimeter_open, euler at each of the field's ``levels``.

    Closed: pairs with min < t <= max, the boundary of {v >= t}. Open: pairs
    with min <= t < max, the boundary of {v > t}.
    """
    keys = keys or ("image_id",)
    found = events(fields, *keys).withColumns({"k": F.lit(None).cast("int")})
    marks = fields.select(*keys, F.posexplode("levels").alias("k", "value")).withColumns({c: F.lit(0) for c in ("area", "pairs", "chi")})
    sweep = found.unionByName(marks.where("value is not null"))
    order = Window.partitionBy(*keys).orderBy(F.desc("value"))
    through = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # all of the same value
    own = Window.partitionBy(*keys, "value")
    summed = sweep.select(
        *keys, "k", "value", F.sum("area").over(through).alias("area"), F.sum("pairs").over(through).alias("perimeter_closed"),
        F.sum("chi").over(through).alias("euler"), F.sum("pairs").over(own).alias("here"),
    )
    return summed.where("k is not null").select(*keys, "k", F.col("value").alias("t"), "area", "perimeter_closed", (F.col("perimeter_closed") - F.col("here")).alias("perimeter_open"), "euler")
