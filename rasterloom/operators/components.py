"""8-connected components of superlevel sets at all levels of a field.

Labelling is the one step that relational operators express badly, so each
field is swept once in numpy: pixels join in descending levels, each new pixel
is tied to its neighbours that are in already, and labels are settled by rounds
of vectorised minimum hooking and pointer jumping. A component's label is its
smallest row-major pixel, which makes labels, and all ties, independent of any
library's order. What comes out is one row for each component or birth and
level, not for each pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHIFTS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]

STATS = pa.schema([("image_id", pa.int64()), ("k", pa.int32()), ("comp", pa.int32()), ("birth_k", pa.int32()), ("area", pa.int64()), ("per", pa.int64()), ("chi", pa.int64())])
STATS_DDL = "image_id long, k int, comp int, birth_k int, area long, per long, chi long"
BIRTHS = pa.schema([("image_id", pa.int64()), ("rep", pa.int32()), ("birth_k", pa.int32()), ("k", pa.int32()), ("comp", pa.int32()), ("area", pa.int64()), ("per", pa.int64()), ("chi", pa.int64())])
BIRTHS_DDL = "image_id long, rep int, birth_k int, k int, comp int, area long, per long, chi long"
LABELS = pa.schema([("image_id", pa.int64()), ("k", pa.int32()), ("pix", pa.int32()), ("comp", pa.int32())])
LABELS_DDL = "image_id long, k int, pix int, comp int"


def first_levels(vals: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """First level (levels descending) that each value reaches; ``len(levels)`` if none (NaN too)."""
    rising = -levels
    k = np.searchsorted(rising, -vals, "left")
    return np.where(np.isnan(vals), len(levels), k)


class Sweep:
    """Labels of a field's superlevel sets, level after level."""

    def __init__(self, vals: np.ndarray, h: int, w: int, levels: np.ndarray) -> None:
        self.h, self.w, self.levels = h, w, levels
        self.k0 = first_levels(vals, levels)
        self.parent = np.arange(h * w)
        grid = np.pad(np.arange(h * w).reshape(h, w), 1, constant_values=-1)
        self.near = np.stack([grid[1 + a : 1 + a + h, 1 + b : 1 + b + w].ravel() for a, b in SHIFTS])

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, pixels in the set, their labels)."""
        for k in range(len(self.levels)):
            new = np.flatnonzero(self.k0 == k)
            if len(new):
                a, b = np.repeat(new[None, :], 8, 0).ravel(), self.near[:, new].ravel()
                ok = b >= 0
                a, b = a[ok], b[ok]
                ok = self.k0[b] <= k
                self._join(a[ok], b[ok])
            inside = np.flatnonzero(self.k0 <= k)
            yield k, inside, self.parent[inside]

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]

    def shares(self, k: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pixel adds to its component's closed perimeter and Euler characteristic.

        A vertex or edge shared by pixels is counted with the first of them in row-major order.
        """
        there = (self.near[:, inside] >= 0) & (self.k0[self.near[:, inside]] <= k)
        nw, n, ne, west, east, _, south, _ = there
        edge = self.near[:, inside] >= 0
        per = sum((edge[i] & ~there[i]).astype(np.int64) for i in (1, 3, 4, 6))
        edges = 4 - n.astype(int) - west
        vertices = 1 + (~(nw | n | west)).astype(int) + ~(n | ne) + ~west
        return per, 1 - edges + vertices


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Sweep]]:
    for b in batches:
        for image, h, w, vals, levels in zip(*(b.column(c).to_pylist() for c in ("image_id", "h", "w", "vals", "levels")), strict=True):
            if levels is not None:
                yield image, Sweep(np.array([np.nan if v is None else v for v in vals]), h, w, np.array(levels))


def _table(schema: pa.Schema, parts: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[f.name] for p in parts]), f.type) for f in schema], schema=schema)


def _measured(sweep: Sweep) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(k, comp, birth_k, area, per and chi of its components) of each level."""
    for k, inside, label in sweep:
        comp, of = np.unique(label, return_inverse=True)
        per, chi = sweep.shares(k, inside)
        birth = np.full(len(comp), len(sweep.levels))
        np.minimum.at(birth, of, sweep.k0[inside])
        add = lambda x, of=of, n=len(comp): np.bincount(of, weights=x, minlength=n).astype(np.int64)
        yield k, {"comp": comp, "birth_k": birth, "area": np.bincount(of, minlength=len(comp)), "per": add(per), "chi": add(chi)}


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for image, sweep in _fields(batches):
        parts = [{"image_id": np.full(len(found["comp"]), image), "k": np.full(len(found["comp"]), k), **found} for k, found in _measured(sweep)]
        if parts:
            yield _table(STATS, parts)


def _births(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for image, sweep in _fields(batches):
        parts, rep, born = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, found in _measured(sweep):
            new = found["comp"][found["birth_k"] == k]
            rep, born = np.append(rep, new), np.append(born, np.full(len(new), k))
            at = np.searchsorted(found["comp"], sweep.parent[rep])
            parts.append({"image_id": np.full(len(rep), image), "rep": rep, "birth_k": born, "k": np.full(len(rep), k), **{c: found[c][at] for c in ("comp", "area", "per", "chi")}})
        if parts:
            yield _table(BIRTHS, parts)


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for image, sweep in _fields(batches):
        for k, inside, label in sweep:
            if len(inside):
                yield _table(LABELS, [{"image_id": np.full(len(inside), image), "k": np.full(len(inside), k), "pix": inside, "comp": label}])


def _needed(fields: DataFrame) -> DataFrame:
    return fields.select("image_id", "h", "w", "vals", "levels")


def component_stats(fields: DataFrame) -> DataFrame:
    """image_id, k, comp, birth_k, area, per, chi of each component at each of the field's ``levels`` (descending).

    birth_k is the first level at which any pixel of the component is in the set.
    """
    return _needed(fields).mapInArrow(_stats, STATS_DDL)


def births(fields: DataFrame) -> DataFrame:
    """image_id, rep, birth_k, k, comp, area, per, chi: the component that holds each birth's first pixel, at every level from then on."""
    return _needed(fields).mapInArrow(_births, BIRTHS_DDL)


def component_labels(fields: DataFrame) -> DataFrame:
    """image_id, k, pix, comp of every pixel in each level's set."""
    return _needed(fields).mapInArrow(_labels, LABELS_DDL)
