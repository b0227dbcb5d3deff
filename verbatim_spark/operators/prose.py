"""What a report says of numbers: thresholds that choose the wording, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tone(mean: Column) -> Column:
    """Of a stage's or theme's mean valence."""
    return (
        F.when(mean < -0.25, "consistently negative").when(mean < -0.05, "negative on balance").when(mean > 0.25, "consistently positive")
        .when(mean > 0.05, "positive on balance").otherwise("mixed")
    )


def cell_tone(valence: Column) -> Column:
    return F.when(valence > 0.15, "positive").when(valence < -0.15, "negative").otherwise("mixed")


def reach(low: Column, high: Column) -> Column:
    """From where to where accounts range on a category."""
    worst = F.when(low < -0.4, "strongly negative").when(low < 0, "mildly negative").otherwise("neutral")
    best = F.when(high > 0.4, "strongly positive").when(high > 0, "mildly positive").otherwise("neutral")
    return F.format_string("from %s to %s", worst, best)


def stage_reading(stage: Column, mean: Column, reviewers: Column, total: Column) -> Column:
    share = F.bround(100 * reviewers / F.greatest(total, F.lit(1))).cast("int")
    return F.format_string("%s: raised by %d%% of reviewers and %s (mean valence %.2f)", stage, share, tone(mean), mean)


def saturation_reading(points: DataFrame, order: str = "document_id") -> DataFrame:
    """One row: whether and where new items ran dry (saturated), or too few documents."""
    facts = points.agg(F.count("*").alias("n"), F.min(F.when(F.col("saturated"), F.col(order))).alias("at"))
    verdict = F.when(F.col("at").isNotNull(), "provisional saturation").when(F.col("n") < 4, "too few documents").otherwise("still climbing")
    return facts.select("n", "at", verdict.alias("verdict"))


def headline(indicators: DataFrame, scores: DataFrame, mine: str, theirs: str, by: str, dimension: str) -> DataFrame:
    """A comparison in a line: who leads on net sentiment (beyond 5 points), where the
    gap lies (the first three dimensions 0.6 or more behind) and what to defend (the
    first two 0.6 or more ahead)."""
    pick = lambda name: F.max(F.when(F.col(by) == name, F.col("nss")))
    gap = indicators.agg((pick(mine) - pick(theirs)).alias("gap"))
    side = lambda name, alias: scores.where(F.col(by) == name).select(dimension, F.col("score").alias(alias))
    both = side(mine, "a").join(side(theirs, "b"), dimension).withColumn("d", F.round(F.col("a") - F.col("b"), 6))
    first = lambda test, order, n: F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(order.alias("o"), F.col(dimension).cast("string").alias("x"))))), lambda s: s["x"]), 1, n), ", ")
    facts = both.agg(first(F.col("d") <= -0.6, F.col("d"), 3).alias("behind"), first(F.col("d") >= 0.6, -F.col("d"), 2).alias("ahead"))
    lead = (
        F.when(F.col("gap") < -5, F.format_string("%s leads on net sentiment by %d points.", F.lit(theirs), F.abs("gap")))
        .when(F.col("gap") > 5, F.format_string("%s leads on net sentiment by %d points.", F.lit(mine), F.col("gap")))
        .otherwise(F.format_string("Net sentiment is close (%d points apart).", F.col("gap")))
    )
    more = F.concat_ws(" ", lead, F.when(F.col("behind") != "", F.concat(F.lit("Behind on "), "behind", F.lit("."))), F.when(F.col("ahead") != "", F.concat(F.lit("Ahead on "), "ahead", F.lit("."))))
    return gap.join(F.broadcast(facts)).select("gap", "behind", "ahead", more.alias("headline"))
