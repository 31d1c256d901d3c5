"""Field functions for SQL: ``field_curves`` and ``field_components`` as table functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from rasterloom.operators.components import Sweep


@udtf(returnType="k int, t double, area long, perimeter long, euler long, components int")
class FieldCurves:
    """Closed curves of one field: field_curves(vals, h, w, levels), levels descending."""

    def eval(self, vals: list, h: int, w: int, levels: list) -> Iterator[tuple]:
        sweep = Sweep(np.array(vals, float), h, w, np.array(levels, float))
        for k, inside, label in sweep:
            per, chi = sweep.shares(k, inside)
            yield k, float(levels[k]), len(inside), int(per.sum()), int(chi.sum()), len(np.unique(label))


@udtf(returnType="k int, pix int, comp int")
class FieldComponents:
    """Labels of one field's pixels: field_components(vals, h, w, levels), levels descending."""

    def eval(self, vals: list, h: int, w: int, levels: list) -> Iterator[tuple]:
        for k, inside, label in Sweep(np.array(vals, float), h, w, np.array(levels, float)):
            yield from ((k, int(p), int(c)) for p, c in zip(inside, label, strict=True))


def register(spark: SparkSession) -> None:
    spark.udtf.register("field_curves", FieldCurves)
    spark.udtf.register("field_components", FieldComponents)
