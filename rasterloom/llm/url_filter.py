"""URL filter: host and path rules, then a character language-model ratio.

Only DataFrame functions are used. URLs that a rule allows or blocks train two
variable-order Markov models of characters (Witten-Bell interpolation from
order 0 up to ``order``); a URL without a rule gets the mean log-likelihood
difference for each character, held against a threshold calibrated on the rule
verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut

#: Fixed values of the contract: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path; both are empty for a null url or one without ``://``."""
    mark = F.locate("://", F.col("url"))
    rest = F.when(mark > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1))


def ruled(rules=RULES) -> tuple[Column, Column]:
    """The fitting rule of most characters, and its verdict; null where none fits."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    pick = lambda value: F.coalesce(*[F.when(fits(h, p), F.lit(value(h, p, v))) for h, p, v in longest])
    return pick(lambda h, p, v: h + p), pick(lambda h, p, v: v)


def _grams(strings: DataFrame, order: int) -> DataFrame:
    """Every character of ``norm`` with up to ``order`` characters before it (\x02 stands before the first)."""
    return strings.withColumn("place", F.explode(F.sequence(F.lit(1), F.length("norm")))).withColumn(
        "gram", F.expr(f"substring(concat(repeat('\\u0002', {order}), norm), place, {order + 1})")
    )


def ratios(strings: DataFrame, order: int = 4) -> DataFrame:
    """gram, weight: log-likelihood ratio of each gram's last character after the others.

    ``strings`` has norm, allow and block (how many rows with this norm the
    rules allow and block). Lower orders are grams with their head cut off, so
    each level is an equi-join of tables of distinct grams.
    """
    full = cut(_grams(strings, order).groupBy("gram").agg(F.sum("allow").alias("a"), F.sum("block").alias("b")))
    alphabet = full.select(F.expr("right(gram, 1)").alias("gram")).agg(F.count_distinct("gram")).scalar()
    low = None
    for k in range(order + 1):
        level = full.groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")) if k < order else full
        level = level.withColumn("context", F.expr(f"left(gram, {k})"))
        seen = level.groupBy("context").agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb")
        )
        level = level.join(seen, "context")
        if low is None:
            level = level.withColumns({"pa": 1.0 / (alphabet + 1), "pb": 1.0 / (alphabet + 1)})
        else:
            level = level.withColumn("short", F.expr(f"right(gram, {k})")).join(low, "short")
        interpolate = lambda n, total, kinds, below: F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(below)) / (F.col(total) + F.col(kinds))).otherwise(F.col(below))
        level = level.select("gram", interpolate("a", "na", "ta", "pa").alias("pa"), interpolate("b", "nb", "tb", "pb").alias("pb"))
        low = level.withColumnRenamed("gram", "short")
    return level.select("gram", (F.ln("pa") - F.ln("pb")).alias("weight"))


def judge(pages: DataFrame, rules=RULES, order: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of ``pages``.

    Where no rule fits, the verdict is ``allow`` if the score reaches the
    threshold: the midpoint of the mean scores of allowed and of blocked URLs,
    or 0 where the rules allow or block nothing. Score is the mean
    log-likelihood difference of the characters after ``://``, ASCII
    lower-cased, digits as 0; null for a null url, one without ``://`` or with
    nothing after it, whose verdict is ``block``. Every URL, repeated or not, counts in
    training. An empty table gives an empty result; extra columns are ignored.
    Distinct normalised URLs are counted before anything is exploded, so a hot
    URL costs one row.
    """
    rule, verdict = ruled(rules)
    rest = F.translate(F.expr("substring(url, locate('://', url) + 3)"), UPPER + "123456789", LOWER + "0" * 9)
    base = with_parts(pages.select("page_id", "url")).withColumns({"rule": rule, "fixed": verdict, "norm": F.when(F.locate("://", F.col("url")) > 0, F.nullif(rest, F.lit("")))}).drop("url")
    strings = cut(base.where("norm is not null").groupBy("norm").agg(F.count_if(F.col("fixed") == "allow").alias("allow"), F.count_if(F.col("fixed") == "block").alias("block")))
    weights = ratios(strings, order)
    scored = _grams(strings, order).join(weights, "gram").groupBy("norm").agg(F.avg("weight").alias("score"), F.first("allow").alias("allow"), F.first("block").alias("block"))
    # A text's grams are summed in any order: rounding makes the score the same for every partitioning.
    scored = cut(scored.withColumn("score", F.round("score", 9)))
    mean = lambda n: F.try_divide(F.sum(F.col("score") * F.col(n)), F.sum(n))
    threshold = scored.agg(F.coalesce((mean("allow") + mean("block")) / 2, F.lit(0.0))).scalar()
    marked = scored.select("norm", "score")
    out = base.join(marked, "norm", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")
