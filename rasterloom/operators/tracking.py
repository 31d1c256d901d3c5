"""Component tracking over descending levels, as joins and windows on component tables.

A component that is new at a level is born there, with its first pixel as
representative. Where several meet, the champion lives on: the earliest born,
then (by rule ``id``) the one with the larger number, or (by rule
``perimeter``) the one with the larger perimeter summed so far, then number.
The first level at which another is champion of its component is its death.
As that looks at each level by itself, no loop over levels is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.components import births, component_stats


def occurrences(fields: DataFrame) -> DataFrame:
    """image_id, gem, rep, birth_k, k, comp, per, area, chi, n_levels: each birth in the component that holds it, at every level."""
    number = F.dense_rank().over(Window.partitionBy("image_id").orderBy("birth_k", "rep"))
    levels = fields.select("image_id", F.size("levels").alias("n_levels"))
    return births(fields).withColumn("gem", number).join(levels, "image_id")


def champions(occ: DataFrame, rule: str = "id") -> DataFrame:
    """Adds winner, the gem that holds the component at the level."""
    before = F.coalesce(F.sum("per").over(Window.partitionBy("image_id", "gem").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    key = F.struct(-F.col("birth_k"), F.col("gem")) if rule == "id" else F.struct(-F.col("birth_k"), F.col("before"), F.col("gem"))
    ranked = occ if rule == "id" else occ.withColumn("before", before)
    return ranked.withColumn("winner", F.max_by("gem", key).over(Window.partitionBy("image_id", "k", "comp"))).select(*occ.columns, "winner")


def alive(fields: DataFrame, rule: str = "id") -> DataFrame:
    """The occurrences before each gem's death (death_k, null if it never dies)."""
    death = F.min(F.when(F.col("winner") != F.col("gem"), F.col("k"))).over(Window.partitionBy("image_id", "gem"))
    return champions(occurrences(fields), rule).withColumn("death_k", death).where(F.col("death_k").isNull() | (F.col("k") < F.col("death_k"))).drop("winner")


def histories(fields: DataFrame, rule: str = "id") -> DataFrame:
    """image_id, gem, rep, k, per, area, chi for every gem and every level: 0 before its birth and from its death on."""
    live = alive(fields, rule)
    dense = live.select("image_id", "gem", "rep", "n_levels").distinct().select("image_id", "gem", "rep", F.explode(F.sequence(F.lit(0), F.col("n_levels") - 1)).alias("k"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return dense.join(live.select("image_id", "gem", "k", "per", "area", "chi"), ["image_id", "gem", "k"], "left").select("image_id", "gem", "rep", "k", zero("per"), zero("area"), zero("chi"))


def diagram(fields: DataFrame, rule: str = "id", essential: str = "last", literal_persistence: bool = False) -> DataFrame:
    """image_id, gem, rep, b, d, life_birth, life_death, bar_birth, bar_death, persistence, sum_per, sum_area, norm_per.

    Intervals go by perimeter: b is the first level with boundary, d one after
    the last; a gem without any is left out. A gem that has boundary at the
    last level dies there (``last``) or never (``inf``). Bars count from 1.
    ``literal_persistence`` gives such a gem the number of levels, not d - b.
    """
    live = alive(fields, rule)
    by = live.groupBy("image_id", "gem", "rep", "n_levels").agg(
        F.min(F.when(F.col("per") > 0, F.col("k"))).alias("b"), (F.max(F.when(F.col("per") > 0, F.col("k"))) + 1).alias("d"),
        F.sum("per").alias("sum_per"), F.sum("area").alias("sum_area"), F.sqrt(F.sum(F.col("per") * F.col("per")).cast("double")).alias("norm_per"),
    )
    level = lambda i: F.get("levels", F.col(i))
    open_ = F.col("d") >= F.col("n_levels")
    last = F.get("levels", F.col("n_levels") - 1) if essential == "last" else F.lit(float("inf"))
    length = F.when(open_, F.col("n_levels")).otherwise(F.col("d") - F.col("b")) if literal_persistence else F.col("d") - F.col("b")
    return by.where("b is not null").join(fields.select("image_id", "levels"), "image_id").select(
        "image_id", "gem", "rep", "b", "d", level("b").alias("life_birth"), F.when(open_, last).otherwise(level("d")).alias("life_death"),
        (F.col("b") + 1).alias("bar_birth"), (F.col("d") + 1).alias("bar_death"), length.alias("persistence"), "sum_per", "sum_area", "norm_per",
    )


def merges(fields: DataFrame, rule: str = "id") -> DataFrame:
    """image_id, k, loser, winner: who ends whom, where."""
    all_ = champions(occurrences(fields), rule).where(F.col("winner") != F.col("gem"))
    return all_.groupBy("image_id", F.col("gem").alias("loser")).agg(F.min("k").alias("k"), F.min_by("winner", "k").alias("winner"))


def betti0(fields: DataFrame) -> DataFrame:
    """image_id, k, components at each level (0 where the set is empty)."""
    levels = fields.select("image_id", F.posexplode("levels").alias("k", "t"))
    counts = component_stats(fields).groupBy("image_id", "k").agg(F.count("*").alias("components"))
    return levels.join(counts, ["image_id", "k"], "left").select("image_id", "k", F.coalesce("components", F.lit(0).cast("long")).alias("components"))


def perimeter_profile(fields: DataFrame, rule: str = "id") -> DataFrame:
    """image_id, k, profile: perimeters over the component's area summed over levels, added up by level."""
    whole = F.sum("area").over(Window.partitionBy("image_id", "gem"))
    return histories(fields, rule).withColumn("whole", whole).where("whole > 0").groupBy("image_id", "k").agg(F.sum(F.col("per") / F.col("whole")).alias("profile"))
