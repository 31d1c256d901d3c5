"""Feature assembly: named blocks in long form, and vectors for Spark ML."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import thresholds as th
from rasterloom.operators import curves as cv

BLOCKS = ("area", "perimeter_open", "euler")
CHANNELS = ("b", "g", "r", "gray")


def geometric_long(channels: DataFrame, n: int) -> DataFrame:
    """image_id, block, position, value: 12 blocks of ``n``, area of the four channels, then open perimeter, then Euler characteristic."""
    found = cv.curves(th.even(channels, n), "image_id", "channel")
    parts = F.array(*[F.struct((F.lit(4 * j) + F.col("channel")).cast("int").alias("block"), F.col(m).alias("value")) for j, m in enumerate(BLOCKS)])
    return found.select("image_id", "k", F.inline(parts)).select("image_id", "block", (F.col("block") * n + F.col("k")).alias("position"), F.col("value").cast("double").alias("value"))


def to_vector(long: DataFrame, name: str = "features") -> DataFrame:
    """image_id and a dense vector of the values in order of position."""
    pairs = F.array_sort(F.collect_list(F.struct("position", "value")))
    return long.groupBy("image_id").agg(array_to_vector(F.transform(pairs, lambda p: p["value"])).alias(name))


def column_names(n: int) -> list[str]:
    return [f"{m}_{c}_{k:03d}" for m in ("area", "per", "chi") for c in CHANNELS for k in range(n)]


def boundary_corrected(curves: DataFrame, side: Column | float, perimeter: str = "perimeter_closed") -> DataFrame:
    """image_id, k, area, per, chi: curves corrected for what the image's edge cuts off, for square images of ``side`` pixels."""
    s = F.lit(float(side)) if not isinstance(side, Column) else side.cast("double")
    a, p, x = F.col("area"), F.col(perimeter), F.col("euler")
    per = p - 4.0 / s * a
    chi = x - 4.0 / (2 * math.pi * s) * p + (1.0 / (2 * math.pi) * (4.0 / s) * (4.0 / s) - 1.0 / s) * a
    return curves.select("image_id", "k", a.cast("double").alias("area"), per.alias("per"), chi.alias("chi"))


def fused(corrected: DataFrame, topology: DataFrame, entropy: DataFrame, n: int) -> DataFrame:
    """image_id, position, value: topological columns, then area, perimeter and Euler curves, then the entropy.

    ``topology`` is image_id, position, value with positions from 0 (their
    number is taken from the largest); images are matched by id.
    """
    wide = topology.agg(F.coalesce(F.max("position") + 1, F.lit(0))).scalar()
    parts = F.array(*[F.struct((wide + j * n + F.col("k")).cast("int").alias("position"), F.col(c).alias("value")) for j, c in enumerate(("area", "per", "chi"))])
    last = entropy.select("image_id", (wide + 3 * n).cast("int").alias("position"), F.col("entropy").alias("value"))
    return topology.select("image_id", F.col("position").cast("int").alias("position"), "value").unionByName(corrected.select("image_id", F.inline(parts))).unionByName(last)


def top_per_class(rows: DataFrame, limit: int, order: str, *groups: str) -> DataFrame:
    """The first ``limit`` rows of each group by ``order``."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*groups).orderBy(order))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def mix_id(column: str, seed: int) -> Column:
    """A scrambled number of an id, by 31-bit arithmetic that every SQL engine has; the order for shuffles and splits."""
    x = F.col(column) + seed
    return (x * 48271 + F.floor(x / 7) * 69621 + 12345) % 2147483647


def shuffled(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """Adds place: the row's place (from 1) in a seeded order that any table with the same ids shares."""
    from pyspark.sql import Window

    ranked = rows.withColumn("draw", mix_id(column, seed))
    # global ranks without one task for all rows: ranks within ranges of draws, plus the rows in ranges before
    width = 2147483647 // 256 + 1
    ranged = ranked.withColumn("bin", F.floor(F.col("draw") / width))
    before = ranged.groupBy("bin").agg(F.count("*").alias("n"))
    before = before.select("bin", (F.sum("n").over(Window.orderBy("bin")) - F.col("n")).alias("before"))  # 256 rows at most
    own = F.row_number().over(Window.partitionBy("bin").orderBy("draw", column))
    return ranged.join(F.broadcast(before), "bin").withColumn("place", (own + F.col("before")).cast("long")).drop("bin", "before")


def hash_split(rows: DataFrame, column: str, share: float, seed: int) -> DataFrame:
    """Adds is_test: whether the row is among the first ``share`` of all in the seeded order."""
    total = rows.agg(F.count("*")).scalar()
    placed = shuffled(rows, column, seed)
    return placed.withColumn("is_test", F.col("place") <= F.floor(total * share)).drop("place", "draw")


def mutual_information(long: DataFrame, labels: DataFrame, bins: int = 10) -> DataFrame:
    """position, information: mutual information (in nats, rounded to nine places) of each feature's bin and the label.

    ``long`` has image_id, position, value; ``labels`` image_id, label. Bins are
    of equal width over the feature's range; a constant feature has one bin.
    Counts are summed per feature, bin and label before they meet.
    """
    ends = long.groupBy("position").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    at = F.least(F.floor((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins), F.lit(bins - 1))
    both = long.join(ends, "position").withColumn("bin", F.coalesce(at, F.lit(0))).join(labels.select("image_id", "label"), "image_id").groupBy("position", "bin", "label").agg(F.count("*").alias("n"))
    rows = both.groupBy("position", "bin").agg(F.sum("n").alias("of_bin"))
    columns = both.groupBy("position", "label").agg(F.sum("n").alias("of_label"))
    total = both.groupBy("position").agg(F.sum("n").alias("total"))
    joined = both.join(rows, ["position", "bin"]).join(columns, ["position", "label"]).join(total, "position")
    part = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("of_bin") * F.col("of_label")))
    return joined.groupBy("position").agg(F.round(F.sum(part), 9).alias("information"))


def most_informative(long: DataFrame, labels: DataFrame, n: int = 100, bins: int = 10) -> DataFrame:
    """position, information of the ``n`` features that tell most about the label (ties to the smaller position)."""
    return mutual_information(long, labels, bins).orderBy(F.desc("information"), "position").limit(n)
