"""Where to try next: tree-structured Parzen estimates over a table of trials."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*key: Column) -> Column:
    """A number above 0 and at most 1 by the MD5 of a key, the same on any engine."""
    text = F.concat_ws("|", *[k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 1) / float(1 << 32)


def normal(*key: Column) -> Column:
    """A standard normal number of a key, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(*key, F.lit("r")))) * F.cos(2 * math.pi * uniform(*key, F.lit("a")))


def sides(trials: DataFrame, study: str, x: str, value: str, share: float = 0.25) -> DataFrame:
    """trials (rows with null or non-finite numbers left out) with `good`: whether the value is among the best share of its study."""
    sound = trials.where(F.col(x).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(value).cast("double")))
    least = sound.groupBy(study).agg(F.expr(f"percentile_disc({1 - share}) WITHIN GROUP (ORDER BY `{value}`)").alias("__least"))
    return sound.join(least, study).withColumn("good", F.col(value) >= F.col("__least")).drop("__least")


def suggestions(trials: DataFrame, study: str, trial: str, x: str, value: str, share: float = 0.25, candidates: int = 24) -> DataFrame:
    """(study, candidate, x, score): candidates for each study and how much likelier each is among good trials than among the others.

    The density of a side is a mixture of a normal kernel for each of its trials and, with the weight of one
    trial, the uniform density over the study's range; a kernel's width is 1.06 s n^(-1/5), but a hundredth of the range at
    least. A candidate is a good trial, picked by hash, moved by its kernel, within the range. score is the difference of the log densities.
    A study without a second trial has no range and no candidates. Sums over trials are partial aggregations; the
    candidates of a study are few.
    """
    rows = sides(trials.select(F.col(study).alias("study"), F.col(trial).alias("trial"), F.col(x).cast("double").alias("x"), F.col(value).alias("value")), "study", "x", "value", share)
    low, high = F.min("x"), F.max("x")
    side = lambda good: [F.count_if(F.col("good") == good).alias(f"n_{good}".lower()), F.stddev_samp(F.when(F.col("good") == good, F.col("x"))).alias(f"s_{good}".lower())]
    facts = rows.groupBy("study").agg(low.alias("low"), high.alias("high"), *side(True), *side(False)).where("high > low")
    width = lambda s: F.greatest(1.06 * F.coalesce(f"s_{s}", F.lit(0.0)) * F.pow(F.greatest(f"n_{s}", F.lit(1)).cast("double"), F.lit(-0.2)), (F.col("high") - F.col("low")) / 100)
    facts = facts.select("study", "low", "high", "n_true", "n_false", width("true").alias("h_true"), width("false").alias("h_false"))
    rows = rows.join(facts, "study")

    drawn = rows.where("good").withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    key = F.md5(F.concat_ws("|", "study", "candidate", F.col("trial").cast("string")).cast("binary"))
    drawn = drawn.groupBy("study", "candidate").agg(F.min(F.struct(key.alias("k"), "x", "low", "high", "h_true")).alias("c"))
    moved = F.col("c.x") + F.col("c.h_true") * normal(F.col("study"), F.col("candidate"))
    drawn = drawn.select("study", "candidate", F.greatest(F.col("c.low"), F.least(F.col("c.high"), moved)).alias("at"))

    h = F.when(F.col("good"), F.col("h_true")).otherwise(F.col("h_false"))
    kernel = F.exp(-F.pow((F.col("at") - F.col("x")) / h, F.lit(2.0)) / 2) / (h * math.sqrt(2 * math.pi))
    sums = rows.join(drawn, "study").groupBy("study", "candidate", "at").agg(F.sum(F.when(F.col("good"), kernel).otherwise(0.0)).alias("k_true"), F.sum(F.when(F.col("good"), 0.0).otherwise(kernel)).alias("k_false"))
    prior = 1 / (F.col("high") - F.col("low"))
    density = lambda s: (F.col(f"k_{s}") + prior) / (F.col(f"n_{s}") + 1)
    return sums.join(facts, "study").select("study", "candidate", F.col("at").alias("x"), (F.log(density("true")) - F.log(density("false"))).alias("score"))


def next_trials(scored: DataFrame) -> DataFrame:
    """(study, candidate, x, score): the best candidate of each study, the first of equal ones."""
    best = F.max_by(F.struct("candidate", "x", "score"), F.struct("score", -F.col("candidate"))).alias("b")
    return scored.groupBy("study").agg(best).select("study", "b.*")
