"""Curves of images as they arrive.

Features of one image need no state; what is fitted on a collection (thresholds
of a cohort, the largest value for binarising, scaler statistics) is frozen
beforehand and passed in as constants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.functions import thresholds as th
from rasterloom.operators.curves import curves


def field_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of fields (image_id, h, w, vals) as a stream."""
    return spark.readStream.schema("image_id long, h int, w int, vals array<double>").parquet(path)


def curve_stream(fields: DataFrame, out: str, checkpoint: str, n: int) -> StreamingQuery:
    """Writes each batch's curves under its batch number, so that a batch done twice is there once."""

    def write(batch: DataFrame, number: int) -> None:
        curves(th.even(batch, n)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fields.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pixel_counts(fields: DataFrame, threshold: float) -> DataFrame:
    """Area over a frozen threshold, image by image, as a plain append stream."""
    return fields.select("image_id", F.size(F.filter("vals", lambda v: v >= threshold)).alias("area"))
