"""Random affine augmentation of fields, with a seed for each image.

Rotation, shifts, shear and zoom are drawn within limits; pixels are resampled
linearly, places beyond the edge take the nearest pixel. Flips are drawn too.
The same id and seed give the same image on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    rotation: float = 11.45916  # degrees
    shift: float = 0.2  # of the side
    shear: float = 0.2  # degrees
    zoom: float = 0.2
    flips: bool = True


def transformed(grid: np.ndarray, rng: np.random.Generator, limits: Limits) -> np.ndarray:
    h, w = grid.shape
    turn, shear = np.deg2rad(rng.uniform(-limits.rotation, limits.rotation)), np.deg2rad(rng.uniform(-limits.shear, limits.shear))
    dr, dc = rng.uniform(-limits.shift, limits.shift) * h, rng.uniform(-limits.shift, limits.shift) * w
    zr, zc = rng.uniform(1 - limits.zoom, 1 + limits.zoom, 2)
    matrix = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]]) @ np.array([[1, -np.sin(shear)], [0, np.cos(shear)]]) @ np.diag([zr, zc])
    centre = np.array([(h - 1) / 2, (w - 1) / 2])
    place = np.stack(np.meshgrid(np.arange(h), np.arange(w), indexing="ij"), -1) - centre
    source = place @ matrix.T + centre + [dr, dc]
    r, c = np.clip(source[..., 0], 0, h - 1), np.clip(source[..., 1], 0, w - 1)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = r - r0, c - c0
    out = grid[r0, c0] * (1 - fr) * (1 - fc) + grid[r1, c0] * fr * (1 - fc) + grid[r0, c1] * (1 - fr) * fc + grid[r1, c1] * fr * fc
    if limits.flips and rng.random() < 0.5:
        out = out[:, ::-1]
    if limits.flips and rng.random() < 0.5:
        out = out[::-1]
    return out


def augmented(fields: DataFrame, seed: int, limits: Limits = Limits()) -> DataFrame:
    """``fields`` with vals replaced; all channels of an image get the same transform."""
    seeded = fields.withColumn("_seed", F.xxhash64("image_id", F.lit(seed)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf["vals"] = [transformed(np.asarray(v, float).reshape(h, w), np.random.default_rng(s & (2**63 - 1)), limits).ravel() for v, h, w, s in zip(pdf.vals, pdf.h, pdf.w, pdf._seed, strict=True)]
            yield pdf.drop(columns="_seed")

    return seeded.mapInPandas(run, fields.schema)
