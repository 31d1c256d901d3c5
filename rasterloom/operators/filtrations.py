"""Filtrations of binarised fields, and cubical persistence of a field's sublevel sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.binding import let
from rasterloom.operators.components import SHIFTS

#: The eight compass directions (row, column).
DIRECTIONS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
#: Centres of radial filtrations as shares of the side, three by three.
CENTRES = tuple((a, b) for a in (0.25, 0.5, 0.75) for b in (0.25, 0.5, 0.75))


def binarized(fields: DataFrame, threshold: float = 0.4, fitted: Column | None = None) -> DataFrame:
    """vals turned to 1 where v over the collection's maximum exceeds ``threshold``, else 0.

    ``fitted`` is the maximum of another (training) collection, as a column or a literal.
    """
    most = fitted if fitted is not None else fields.agg(F.max(F.array_max("vals"))).scalar()
    scaled = fields.withColumn("_most", F.nullif(most, F.lit(0.0)))
    return scaled.withColumn("vals", F.transform("vals", lambda v: F.coalesce(v / F.col("_most") > threshold, F.lit(False)).cast("double"))).drop("_most")


def _placed(value) -> Column:
    """vals with foreground pixels at value(r, c), background at the largest of these plus 1."""
    w = F.col("w")
    place = F.transform(F.sequence(F.lit(0), F.col("h") * w - 1), lambda i: value(F.floor(i / w).cast("double"), (i % w).cast("double")))
    return let(place, lambda p: let(F.array_max(p) + 1, lambda top: F.zip_with("vals", p, lambda v, x: F.when(v > 0, x).otherwise(top))))


def height_values(direction: tuple[int, int]) -> Column:
    """Distance along the unit direction, from the corner where that is least."""
    length = float(np.hypot(*direction))
    dr, dc = direction[0] / length, direction[1] / length
    least_r = F.lit(0.0) if dr >= 0 else (F.col("h") - 1).cast("double") * dr
    least_c = F.lit(0.0) if dc >= 0 else (F.col("w") - 1).cast("double") * dc
    return _placed(lambda r, c: r * dr + c * dc - least_r - least_c)


def radial_values(centre: tuple[float, float]) -> Column:
    """Euclidean distance to a centre, given in pixels (row, column)."""
    return _placed(lambda r, c: F.sqrt((r - centre[0]) * (r - centre[0]) + (c - centre[1]) * (c - centre[1])))


def height(binary: DataFrame, direction: tuple[int, int]) -> DataFrame:
    return binary.withColumn("vals", height_values(direction))


def radial(binary: DataFrame, centre: tuple[float, float]) -> DataFrame:
    return binary.withColumn("vals", radial_values(centre))


def all_filtrations(binary: DataFrame, centres: tuple[tuple[float, float], ...]) -> DataFrame:
    """Every height and radial filtration of each field in one pass, with a column filtration that names it."""
    forms = [(f"height_{n}", height_values(d)) for n, d in enumerate(DIRECTIONS)] + [(f"radial_{n}", radial_values(c)) for n, c in enumerate(centres)]
    return binary.select("image_id", "h", "w", F.inline(F.array(*[F.struct(F.lit(name).alias("filtration"), vals.alias("vals")) for name, vals in forms])))


# -- cubical persistence

DIAGRAM = pa.schema([("image_id", pa.int64()), ("filtration", pa.string()), ("dim", pa.int32()), ("birth", pa.float64()), ("death", pa.float64())])
FOUR = [s for s in SHIFTS if 0 in s]


def merge_tree(grid: np.ndarray, shifts: list[tuple[int, int]]) -> tuple[list[tuple[float, float]], list[float]]:
    """Finite (birth, death) pairs of positive length, and births that never die, of the components of sublevel sets (elder rule).

    Every pixel belongs to the basin of the minimum that its steepest descent
    ends in, a path that lies in each sublevel set that the pixel is in. So
    basins merge where the lowest passes between them are; only these, a small
    part of the pixels, are merged one by one.
    """
    h, w = grid.shape
    vals = grid.ravel()
    order = np.argsort(vals, kind="stable")
    rank = np.empty(len(vals), np.int64)
    rank[order] = np.arange(len(vals))
    square = rank.reshape(h, w)
    least = np.pad(square, 1, constant_values=len(vals))
    down = np.minimum.reduce([square, *(least[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w] for dr, dc in shifts)]).ravel()[order]
    while (further := down[down]).tobytes() != down.tobytes():
        down = further
    basin = down[rank].reshape(h, w)
    passes = []
    for dr, dc in (x for x in shifts if x > (0, 0)):
        here = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
        there = (slice(dr, h), slice(max(0, dc), w + min(0, dc)))
        x, y, height = basin[here].ravel(), basin[there].ravel(), np.maximum(square[here], square[there]).ravel()
        apart = np.flatnonzero(x != y)
        passes.append(np.stack([np.minimum(x, y)[apart], np.maximum(x, y)[apart], height[apart]]))
    low, high, height = np.concatenate(passes, axis=1) if passes else np.zeros((3, 0), np.int64)
    by = np.lexsort((height, high, low))
    low, high, height = low[by], high[by], height[by]
    lowest = np.ones(len(low), bool)
    lowest[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    by = np.flatnonzero(lowest)
    by = by[np.argsort(height[by], kind="stable")]
    minima = np.flatnonzero(down == np.arange(len(down)))
    parent, pairs, sorted_vals = {x: x for x in minima.tolist()}, [], vals[order]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y, at in zip(low[by].tolist(), high[by].tolist(), height[by].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            old, young = min(x, y), max(x, y)
            parent[young] = old
            if sorted_vals[young] < sorted_vals[at]:
                pairs.append((float(sorted_vals[young]), float(sorted_vals[at])))
    return pairs, [float(sorted_vals[x]) for x in parent if parent[x] == x]


def persistence(grid: np.ndarray) -> list[tuple[int, float, float]]:
    """(dim, birth, death) of a field's sublevel sets, pixels as top cells (8-connected).

    Loops come by duality: a hole is a bounded 4-connected component of the
    complement, so the negated field, ringed by a background that was always
    there, is swept upwards and births and deaths change places.
    """
    pairs, forever = merge_tree(grid, SHIFTS)
    out = [(0, b, d) for b, d in pairs] + [(0, b, float("inf")) for b in forever]
    ringed = np.pad(-grid, 1, constant_values=-np.inf)
    holes, _ = merge_tree(ringed, FOUR)
    return out + [(1, -d, -b) for b, d in holes if np.isfinite(b)]


def _diagrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for image, name, h, w, vals in zip(*(b.column(c).to_pylist() for c in ("image_id", "filtration", "h", "w", "vals")), strict=True):
            rows += [(image, name, *x) for x in persistence(np.array(vals, float).reshape(h, w))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), DIAGRAM, strict=True)], schema=DIAGRAM)


def cubical(filtered: DataFrame) -> DataFrame:
    """image_id, filtration, dim, birth, death of each field; a component that never dies has death infinity."""
    named = filtered if "filtration" in filtered.columns else filtered.withColumn("filtration", F.lit("values"))
    return named.select("image_id", "filtration", "h", "w", "vals").mapInArrow(_diagrams, "image_id long, filtration string, dim int, birth double, death double")


# -- all filtrations of a binary field, with their diagrams, in one step


def value_grids(h: int, w: int, centres: tuple[tuple[float, float], ...]) -> dict[str, np.ndarray]:
    """The values of foreground pixels in each height and radial filtration of a field of this shape."""
    r, c = np.mgrid[:h, :w].astype(float)
    out = {}
    for n, (dr, dc) in enumerate(DIRECTIONS):
        length = float(np.hypot(dr, dc))
        out[f"height_{n}"] = r * (dr / length) + c * (dc / length) - min(0.0, (h - 1) * (dr / length)) - min(0.0, (w - 1) * (dc / length))
    for n, (a, b) in enumerate(centres):
        out[f"radial_{n}"] = np.sqrt((r - a) * (r - a) + (c - b) * (c - b))
    return out


def all_diagrams(binary: DataFrame, centres: tuple[tuple[float, float], ...]) -> DataFrame:
    """``cubical(all_filtrations(binary, centres))`` without a row for each field and filtration in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[tuple[int, int], dict[str, np.ndarray]] = {}
        for b in batches:
            rows: list[tuple] = []
            for image, h, w, vals in zip(*(b.column(c).to_pylist() for c in ("image_id", "h", "w", "vals")), strict=True):
                inside = np.array(vals, float).reshape(h, w) > 0
                if (h, w) not in grids:
                    grids = {(h, w): value_grids(h, w, centres)}
                for name, grid in grids[h, w].items():
                    rows += [(image, name, *x) for x in persistence(np.where(inside, grid, grid.max() + 1))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), DIAGRAM, strict=True)], schema=DIAGRAM)

    return binary.select("image_id", "h", "w", "vals").mapInArrow(run, "image_id long, filtration string, dim int, birth double, death double")
