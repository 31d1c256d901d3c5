"""Fields (scalar rasters) as DataFrames.

A field is one row: image_id, h, w and vals, the row-major values as doubles;
``pixels`` gives the long form image_id, r, c, v. Colour fields have a channel
column too (0, 1, 2 = blue, green, red, 3 = gray).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions.binding import let

#: Bytes of one image that Spark's image source can decode, in BGR order, row by row.
IMAGE_COLUMNS = ("origin", "height", "width", "nChannels", "data")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- views over the driver's tables


def doubles(column: str | Column) -> Column:
    return F.transform(column, lambda x: x.cast("double"))


def field8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding of 64 numbers as an 8x8 field, with its label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), doubles("embedding").alias("vals"), "label")


def rgbg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as four 4x4 channels: blue, green, red, gray."""
    return parts4(table(spark, sf_dir, "embeddings"), "channel")


def volume4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a volume of four 4x4 slices."""
    return parts4(table(spark, sf_dir, "embeddings"), "slice").withColumnRenamed("image_id", "volume_id")


def parts4(embeddings: DataFrame, name: str) -> DataFrame:
    parts = F.array(*[F.slice(doubles("embedding"), 16 * k + 1, 16) for k in range(4)])
    return embeddings.select(F.col("vec_id").alias("image_id"), F.lit(4).alias("h"), F.lit(4).alias("w"), F.posexplode(parts).alias(name, "vals"))


def mask4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask for each volume: where the volume with the opposite id is positive.

    The mapping of masks to volumes is an equi-join on volume_id; the first mask of a volume counts.
    """
    vectors = table(spark, sf_dir, "embeddings")
    last = vectors.agg(F.max("vec_id")).scalar()
    masks = parts4(vectors, "slice").select((last - F.col("image_id")).alias("volume_id"), F.col("image_id").alias("mask_pos"), "slice", F.transform("vals", lambda x: (x > 0).cast("double")).alias("mask"))
    return masks.groupBy("volume_id", "slice").agg(F.min_by("mask", "mask_pos").alias("mask"))


def from_counts(rows: DataFrame, image_id: Column, r: Column, c: Column, h: int, w: int) -> DataFrame:
    """Fields of how many rows fall on each cell; cells without a row are 0."""
    counts = rows.select(image_id.alias("image_id"), (r * w + c).cast("int").alias("pos")).groupBy("image_id", "pos").agg(F.count("*").cast("double").alias("v"))
    cells = counts.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("at"))
    vals = F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0)))
    return cells.select("image_id", F.lit(h).alias("h"), F.lit(w).alias("w"), vals.alias("vals"))


def sales_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by quantity (1 to 50) and discount (0 to 10 %), a field for each return flag."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(1, 50) & F.col("l_discount").between(0, 0.10))
    return from_counts(rows, F.ascii("l_returnflag").cast("long"), F.col("l_quantity").cast("int") - 1, F.round(F.col("l_discount") * 100).cast("int"), 50, 11)


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day of month (31) and hour (24), a field for each event type, numbered by name."""
    events = table(spark, sf_dir, "events")
    names = events.select("event_type").distinct().withColumn("image_id", F.dense_rank().over(Window.orderBy("event_type")).cast("long"))  # as many rows as types
    return from_counts(events.join(F.broadcast(names), "event_type"), F.col("image_id"), F.dayofmonth("ts") - 1, F.hour("ts"), 31, 24)


def field224(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of 224 x 224: the components of 784 vectors on end, from every 64th vector on."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", doubles("embedding").alias("e"))
    first = F.greatest(F.ceil((F.col("vec_id") - 783) / 64), F.lit(0)).cast("long")
    rows = rows.withColumn("image_id", F.explode(F.sequence(first, F.floor(F.col("vec_id") / 64)))).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "e")))["e"].alias("rows"))
    return rows.where(F.size("rows") == 784).select("image_id", F.lit(224).alias("h"), F.lit(224).alias("w"), F.flatten("rows").alias("vals"))


def pixels(fields: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("image_id",)
    long = fields.select(*keys, "w", F.posexplode("vals").alias("pos", "v"))
    return long.select(*keys, (F.col("pos") / F.col("w")).cast("int").alias("r"), (F.col("pos") % F.col("w")).alias("c"), "v")


# -- image files


def read_images(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Images under ``path``, the first ``limit`` by path; files that aren't images are left out."""
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select(*[F.col(f"image.{c}") for c in IMAGE_COLUMNS])
    found = found.withColumn("image_id", F.xxhash64("origin"))
    return found.orderBy("origin").limit(limit) if limit is not None else found


def with_class(images: DataFrame) -> DataFrame:
    """split, class and label from a path like .../train/benign/x.png (label 1 = malignant)."""
    part = lambda n: F.regexp_extract("origin", r"(train|test)/([^/]+)/[^/]+$", n)
    return images.withColumns({"split": part(1), "class": part(2)}).withColumn("label", (F.col("class") == "malignant").cast("int"))


def _decoded(images: DataFrame, make, schema: str) -> DataFrame:
    """Rows of ``make``: for each image's bytes, as h x w x channels, (channel or None, values) of its fields, inverted (max - v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for image, h, w, n, data in zip(*(b.column(c).to_pylist() for c in ("image_id", "height", "width", "nChannels", "data")), strict=True):
                for channel, vals in make(np.frombuffer(data, np.uint8).reshape(h, w, n).astype(float)):
                    rows.append((image, channel, h, w, (vals.max() - vals).ravel()))
            if rows:
                columns = dict(zip(("image_id", "channel", "h", "w", "vals"), zip(*rows, strict=True), strict=True))
                arrow = {"image_id": pa.int64(), "channel": pa.int32(), "h": pa.int32(), "w": pa.int32(), "vals": pa.list_(pa.float64())}
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(columns[x], arrow[x]) for x in names], names=names)

    return images.select("image_id", "height", "width", "nChannels", "data").mapInArrow(run, schema)


def channels(images: DataFrame, keep: int = 3) -> DataFrame:
    """The first ``keep`` channels of each colour image, each inverted (max - v), as fields."""
    return _decoded(images.where(F.col("nChannels") >= keep), lambda x: [(k, x[:, :, k]) for k in range(keep)], "image_id long, channel int, h int, w int, vals array<double>")


def gray_fields(images: DataFrame) -> DataFrame:
    """Each image's gray values, round(0.299 R + 0.587 G + 0.114 B), inverted, as a field.

    An image decoder's own gray may differ by one.
    """
    weigh = lambda x: x[:, :, 0] if x.shape[2] < 3 else np.floor(0.299 * x[:, :, 2] + 0.587 * x[:, :, 1] + 0.114 * x[:, :, 0] + 0.5)
    return _decoded(images, lambda x: [(None, weigh(x))], "image_id long, h int, w int, vals array<double>")


def inverted(vals: Column) -> Column:
    """max - v of an array, so that dark is high."""
    return let(F.array_max(vals), lambda most: F.transform(vals, lambda v: most - v))


def write_fields(fields: DataFrame, path: str) -> None:
    """Fields (thresholded, filtered or feature rows alike) as Parquet."""
    fields.write.mode("overwrite").parquet(path)


def png(pixels: np.ndarray) -> bytes:
    """A gray image (h x w bytes) as a PNG file."""
    h, w = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.hstack([np.zeros((h, 1), np.uint8), pixels]).tobytes()  # each line begins with its filter, none
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def write_images(fields: DataFrame, folder: str, threshold: float | None = None) -> None:
    """Each field as a gray image ``image_id``.png in a folder that all machines share.

    Values are rounded and clipped to 0..255; with a ``threshold``, pixels at
    least that high are white and all others black. A task that is run again
    writes the same files.
    """

    def write(rows) -> None:
        files, path = pa.fs.FileSystem.from_uri(folder)
        for r in rows:
            vals = np.array(r.vals, float).reshape(r.h, r.w)
            pixels = np.where(vals >= threshold, 255, 0) if threshold is not None else np.clip(np.rint(vals), 0, 255)
            with files.open_output_stream(f"{path}/{r.image_id}.png") as f:
                f.write(png(pixels.astype(np.uint8)))

    pa.fs.FileSystem.from_uri(folder)[0].create_dir(pa.fs.FileSystem.from_uri(folder)[1], recursive=True)
    fields.select("image_id", "h", "w", "vals").foreachPartition(write)
