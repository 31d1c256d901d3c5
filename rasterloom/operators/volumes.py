"""Masked volumes: slice choice, cohort range, z-scores and curves of the chosen slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import pixels as px
from rasterloom.functions import thresholds as th
from rasterloom.operators.curves import curves


def chosen_slices(volumes: DataFrame, masks: DataFrame) -> DataFrame:
    """volume_id, slice, h, w, vals, mask, mask_area of the slice with most foreground (the first on ties).

    Volumes without a mask are left out.
    """
    both = volumes.join(masks.select("volume_id", "slice", px.binary_mask(F.col("mask")).alias("mask")), ["volume_id", "slice"])
    area = F.aggregate("mask", F.lit(0.0), lambda s, m: s + m)
    place = F.row_number().over(Window.partitionBy("volume_id").orderBy(F.desc("mask_area"), "slice"))
    return both.withColumn("mask_area", area.cast("long")).withColumn("place", place).where("place = 1").select("volume_id", "slice", "h", "w", "vals", "mask", "mask_area")


def without_mask(volumes: DataFrame, masks: DataFrame) -> DataFrame:
    """volume_id, slice of the slices that no mask belongs to: what ``chosen_slices`` leaves out."""
    return volumes.select("volume_id", "slice").join(masks.select("volume_id", "slice"), ["volume_id", "slice"], "left_anti")


def prepared(chosen: DataFrame, z_score: bool = False) -> DataFrame:
    """Masked, optionally z-scored over the whole slice, shifted to a least value of 0, and 0 outside the mask."""
    vals = px.masked(F.col("vals"), F.col("mask"))
    out = chosen.withColumn("vals", vals)
    if z_score:
        out = out.withColumn("vals", px.z_scores(F.col("vals")))
    return out.withColumn("vals", px.grounded(F.col("vals"), F.col("mask")))


def positive_range(slices: DataFrame) -> DataFrame:
    """volume_id, low, high of the positive values (volumes without one are left out)."""
    over = F.filter("vals", lambda v: v > 0)
    return slices.select("volume_id", F.array_min(over).alias("low"), F.array_max(over).alias("high")).where("low is not null")


def cohort_levels(slices: DataFrame, n: int, descending: bool = False) -> DataFrame:
    """Adds levels: the same for all volumes, over the range that all of them have; computed once."""
    low, high = (th.cohort(positive_range(slices)).select(c).scalar() for c in ("low", "high"))
    levels = th.linspace(F.col("_low"), F.col("_high"), n)
    return slices.withColumns({"_low": low, "_high": high}).withColumn("levels", F.reverse(levels) if descending else levels).drop("_low", "_high")


def eap_curves(chosen: DataFrame, n: int = 100) -> DataFrame:
    """volume_id, k, t, area, perimeter_open, euler of each z-scored slice, over the range of its own positive values."""
    return curves(th.positive(prepared(chosen, z_score=True), n).where("levels is not null"), "volume_id").select("volume_id", "k", "t", "area", "perimeter_open", "euler")


def eap_curves_in_range(chosen: DataFrame, n: int = 100) -> DataFrame:
    """The same without z-scores, over the cohort's range."""
    return curves(cohort_levels(prepared(chosen), n), "volume_id").select("volume_id", "k", "t", "area", "perimeter_open", "euler")
