"""Methodology readings over coded units: narrative, framework, grounded theory,
experiential and content analysis.

Codes are rows (participant, ord, theme_id, valence, confidence, ...); ``ord``
orders a participant's codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kept import keep


def _series(by: str, order: str) -> tuple:
    return Window.partitionBy(by).orderBy(order), Window.partitionBy(by)


def relative_position(codes: DataFrame, by: str = "participant", order: str = "ord") -> DataFrame:
    """Adds pos, from 0 for a participant's first code to 1 for the last."""
    inside, whole = _series(by, order)
    i, n = F.row_number().over(inside) - 1, F.count("*").over(whole)
    return codes.withColumn("pos", i / F.greatest(n - 1, F.lit(1)))


def turning_points(codes: DataFrame, by: str = "participant", order: str = "ord", least: float = 0.7, top: int = 4) -> DataFrame:
    """The largest jumps of valence between neighbouring codes, up or down."""
    inside, _ = _series(by, order)
    delta = F.round(F.col("valence") - F.lag("valence").over(inside), 6)
    jumps = codes.withColumn("delta", delta).where(F.abs("delta") >= least)
    best = Window.partitionBy(by).orderBy(F.desc(F.abs("delta")), order)
    ranked = jumps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select(by, order, "delta", "rank", F.when(F.col("delta") > 0, "upturn").otherwise("downturn").alias("direction"))


def plot_shape(codes: DataFrame, by: str = "participant", order: str = "ord") -> DataFrame:
    """The slope of valence over a participant's codes and the plot it makes,
    from the means of three thirds (cut at n / 3 and 2 n / 3, rounded down)."""
    inside, whole = _series(by, order)
    ranked = codes.withColumns({"i": F.row_number().over(inside) - 1, "n": F.count("*").over(whole)})
    one, two = F.floor(F.col("n") / 3), F.floor(2 * F.col("n") / 3)
    mean = lambda test: F.avg(F.when(test, F.col("valence")))
    facts = ranked.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.regr_slope("valence", F.col("i").cast("double")), 6).alias("slope"),
        F.round(mean(F.col("i") < one), 6).alias("a"), F.round(mean((F.col("i") >= one) & (F.col("i") < two)), 6).alias("b"),
        F.round(mean(F.col("i") >= two), 6).alias("c"),
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    shape = (
        F.when(F.col("n") < 3, "fragment").when((b < a - 0.25) & (c > b + 0.25), "redemptive").when((b > a + 0.25) & (c < b - 0.25), "contaminative")
        .when(F.col("slope") > 0.02, "progressive").when(F.col("slope") < -0.02, "regressive").otherwise("stable")
    )
    return facts.withColumn("shape", shape)


# Where each part of a story is expected, and how fast that fades.
LABOV = {"orientation": (0.05, 2.2), "complication": (0.35, 2.0), "evaluation": (0.55, 2.0), "resolution": (0.82, 2.2), "coda": (0.97, 2.6)}


def labov_elements(codes: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """The part of a story that each code is: cues, a prior that fades away from
    the part's usual place, and the pull of valence; ties by the order of the
    parts. ``pos`` is needed."""
    pos, v, zero = F.col("pos"), F.col("valence"), F.lit(0.0)
    pull = {"evaluation": F.when(F.abs(v) > 0.35, 0.6), "complication": F.when(v < -0.4, 0.5), "resolution": F.when(v > 0.35, 0.35)}
    scores = [
        F.struct(
            F.round(hits[n].cast("double") + F.greatest(zero, 1 - F.abs(pos - place) * fade) + F.coalesce(pull.get(n, zero), zero), 9).alias("s"),
            F.lit(-i).alias("o"), F.lit(n).alias("n"),
        )
        for i, (n, (place, fade)) in enumerate(LABOV.items())
    ]
    return codes.withColumn("element", F.array_max(F.array(*scores))["n"])


def agency(counts: DataFrame) -> DataFrame:
    """Share of active among active and passive cues, a half without any."""
    total = F.col("active") + F.col("passive")
    ratio = F.when(total == 0, 0.5).otherwise(F.round(F.col("active") / total, 6))
    return counts.withColumn("ratio", ratio).withColumn("band", F.when(total == 0, "unmarked").when(F.col("ratio") > 0.65, "agent").when(F.col("ratio") < 0.35, "acted upon").otherwise("mixed"))


def saturation(pairs: DataFrame, order: str = "document_id", item: str = "item", least_documents: int = 3, rate: float = 0.12) -> DataFrame:
    """New items of each document in order, the running total, and whether the
    share of new ones is at or below ``rate`` from the third document on. An
    item's first document is an aggregate; only one row a document is put in order."""
    each = pairs.select(order, item).distinct()
    first = each.groupBy(item).agg(F.min(order).alias(order)).groupBy(order).agg(F.count("*").alias("new"))
    sizes = each.groupBy(order).agg(F.count("*").alias("items")).join(first, order, "left").fillna(0, ["new"])
    numbered = running_total(sizes, order, "new", "seen")
    share = F.round(F.col("new") / F.col("items"), 6)
    return numbered.withColumns({"rate": share, "saturated": (F.col("place") >= least_documents) & (share <= rate)}).drop("place")


def running_total(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the running sum of a column in the order of another, and each row's
    place (from 1). Rows are cut into ranges of the order, summed up in each, and
    raised by what the ranges before hold, of which there is a row each."""
    laid = keep(rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = laid.groupBy("_part").agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_part").orderBy(order)
    told = laid.withColumns({"_own": F.sum(value).over(inside), "_place": F.row_number().over(inside)}).join(F.broadcast(offsets), "_part")
    return told.withColumns({name: F.col("_own") + F.col("_sum"), "place": F.col("_place") + F.col("_n")}).drop("_part", "_own", "_place", "_sum", "_n")


def cells(codes: DataFrame, row: str, column: str, shown: int = 3) -> DataFrame:
    """Framework cells that hold something: all codes counted, the best ``shown`` by
    score times confidence named, their mean valence."""
    best = Window.partitionBy(row, column).orderBy(F.desc("weight"), "example")
    ranked = codes.withColumn("weight", F.round(F.col("score") * F.col("confidence"), 6)).withColumn("rank", F.row_number().over(best))
    top = F.col("rank") <= shown
    return ranked.groupBy(row, column).agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(top, F.col("valence"))), 6).alias("mean_valence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(top, F.struct("rank", "example")))), lambda x: x["example"].cast("string")), ",").alias("examples"),
    )


def chart(codes: DataFrame, row: str, column: str, shown: int = 3) -> DataFrame:
    """The framework's matrix: a line for each row and column, empty cells filled
    in. Columns are the framework's categories and few; they come to each row as
    one array, so rows are not multiplied before they are distinct."""
    columns = codes.agg(F.array_sort(F.collect_set(column)).alias("_columns"))
    grid = codes.select(row).distinct().join(F.broadcast(columns)).select(row, F.explode("_columns").alias(column))
    return grid.join(cells(codes, row, column, shown), [row, column], "left").fillna(0, ["n"])


def mapping(found: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Coverage, mean and spread of each category's cells and the pattern they make,
    from the cells that hold something and the rows of the matrix. No grid is made."""
    total = rows.agg(F.count("*").alias("_rows"))
    facts = found.groupBy(column).agg(
        F.count("*").alias("present"), F.round(F.avg("mean_valence"), 6).alias("mean"), F.round(F.max("mean_valence") - F.min("mean_valence"), 6).alias("spread"),
    ).join(F.broadcast(total))
    pattern = F.when(F.col("spread") > 0.8, "divided").when(F.col("mean") < -0.2, "consistently negative").when(F.col("mean") > 0.2, "consistently positive").otherwise("mixed")
    return facts.select(column, F.round(F.col("present") / F.col("_rows"), 6).alias("coverage"), "mean", "spread", pattern.alias("pattern"))


def gaps(found: DataFrame, rows: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Categories that some rows, but not all, lack; the first ``top`` in order."""
    total = rows.agg(F.count("*").alias("cells"))
    counts = found.groupBy(column).agg(F.count("*").alias("present")).join(F.broadcast(total))
    return counts.where("present < cells").select(column, (F.col("cells") - F.col("present")).alias("empty"), "cells").orderBy(column).limit(top)


def latent(codes: DataFrame, category: str, by: str = "participant") -> DataFrame:
    """Share, spread over participants, mean valence and prevailing mood of categories."""
    total = codes.agg(F.count("*").alias("all_codes"), F.countDistinct(by).alias("all_by"))
    moods = codes.groupBy(category, "mood").agg(F.count("*").alias("k"))
    top = moods.groupBy(category).agg(F.max_by("mood", F.struct("k", "mood")).alias("mood"))
    facts = codes.groupBy(category).agg(F.count("*").alias("n"), F.countDistinct(by).alias("reach"), F.round(F.avg("valence"), 6).alias("mean_valence"))
    return facts.join(F.broadcast(total)).join(top, category).select(
        category, "n", F.round(F.col("n") / F.col("all_codes"), 6).alias("share"), F.round(F.col("reach") / F.col("all_by"), 6).alias("spread"), "mean_valence", "mood"
    )


def reliability(codes: DataFrame, coded: Column, low: float = 0.5) -> DataFrame:
    return codes.agg(
        F.count("*").alias("units"), F.round(F.count_if(coded) / F.count("*"), 6).alias("coverage"), F.round(F.avg("confidence"), 6).alias("confidence"),
        F.count_if(F.col("alternatives") > 1).alias("ambiguous"), F.count_if(F.col("confidence") < low).alias("low"),
    )


def convergence(codes: DataFrame, by: str = "participant", least: float = 0.5) -> DataFrame:
    """Themes over participants: who has them, who doesn't, and whether their
    valences part by more than ``least``."""
    everyone = codes.agg(F.countDistinct(by).alias("all_by"))
    means = codes.groupBy("theme_id", by).agg(F.avg("valence").alias("m"))
    facts = means.groupBy("theme_id").agg(F.count("*").alias("present"), F.round(F.max("m") - F.min("m"), 6).alias("range"))
    return facts.join(F.broadcast(everyone)).select(
        "theme_id", "present", (F.col("all_by") - F.col("present")).alias("absent"), F.round(F.col("present") / F.col("all_by"), 6).alias("share"),
        "range", (F.col("range") > least).alias("divergent"),
    )


def exemplars(codes: DataFrame, by: str = "participant", top: int = 5) -> DataFrame:
    """Each theme's most confident code of each participant, the best ``top``."""
    own = Window.partitionBy("theme_id", by).orderBy(F.desc("confidence"), "example")
    best = codes.withColumn("r", F.row_number().over(own)).where("r = 1")
    over = Window.partitionBy("theme_id").orderBy(F.desc("confidence"), "example")
    return best.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top).select("theme_id", by, "example", "rank")


def properties(codes: DataFrame, phrase: str, top: int = 6) -> DataFrame:
    """A category's most frequent phrases, its range of valence and its four most
    frequent moods but the neutral one."""
    counts = codes.groupBy("theme_id", phrase).agg(F.count("*").alias("k"), F.min("valence").alias("lo"), F.max("valence").alias("hi"))
    over = Window.partitionBy("theme_id").orderBy(F.desc("k"), phrase)
    ranked = counts.withColumn("rank", F.row_number().over(over))
    facts = ranked.groupBy("theme_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", phrase)))), lambda x: x[phrase]), ",").alias("phrases"),
        F.round(F.min("lo"), 6).alias("low"), F.round(F.max("hi"), 6).alias("high"),
    )
    felt = codes.where("mood <> 'neutral'").groupBy("theme_id", "mood").agg(F.count("*").alias("k"))
    often = F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("k"), "mood"))
    felt = felt.withColumn("rank", often).where("rank <= 4").groupBy("theme_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "mood"))), lambda x: x["mood"]), ",").alias("moods")
    )
    return facts.join(felt, "theme_id", "left").fillna("", ["moods"])


def core_category(categories: DataFrame) -> DataFrame:
    """The category with the highest centrality, raised by density (filled paradigm
    slots) and participants."""
    value = F.round(F.col("centrality") * (1 + 0.12 * F.col("density")) * (1 + 0.08 * F.col("participants")), 6)
    return categories.withColumn("weight", value).orderBy(F.desc("weight"), "theme_id").limit(1)


def contrary_valence(codes: DataFrame) -> DataFrame:
    """Negative cases: codes against the mood of their theme."""
    means = codes.groupBy("theme_id").agg(F.round(F.avg("valence"), 6).alias("mean"))
    v, m = F.col("valence"), F.col("mean")
    return codes.join(means, "theme_id").where(((m < -0.1) & (v > 0.25)) | ((m > 0.1) & (v < -0.25)))


def theme_summary(codes: DataFrame, by: str = "participant", min_quotes: int = 3, min_participants: int = 2, least_confidence: float = 0.55) -> DataFrame:
    """Members, participants, coverage, confidence, status and negative cases of
    each theme. Among more than 30 codes a theme has at least two members, or three
    if ``min_quotes`` asks for as many; thinner groups are no themes."""
    everyone = codes.agg(F.count("*").alias("all_codes"))
    facts = codes.groupBy("theme_id").agg(
        F.count("*").alias("members"), F.countDistinct(by).alias("participants"), F.avg("confidence").alias("conf"), F.round(F.avg("valence"), 6).alias("mean_valence"),
        F.max("cohesion").alias("cohesion"), F.count_if(F.col("valence") > 0.25).alias("high"), F.count_if(F.col("valence") < -0.25).alias("low"),
    ).join(F.broadcast(everyone))
    conf = F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.col("conf") * (0.7 + 0.3 * F.least(2 * F.col("cohesion"), F.lit(1.0)))))
    conf = F.round(F.round(conf, 12), 6)  # halves are halves whatever the order of the sum was
    enough = F.col("participants") >= min_participants
    status = (
        F.when((F.col("members") >= min_quotes) & enough & (conf >= least_confidence), "confirmed")
        .when((F.col("members") >= max(2, min_quotes - 1)) | enough, "review").otherwise("candidate")
    )
    opposed = F.when(F.col("mean_valence") < -0.1, F.col("high")).when(F.col("mean_valence") > 0.1, F.col("low")).otherwise(0)
    least = F.when(F.col("all_codes") > 30, max(2, min(min_quotes, 3))).otherwise(1)
    return facts.where(F.col("members") >= least).select(
        "theme_id", "members", "participants", F.round(F.col("members") / F.col("all_codes"), 6).alias("coverage"), conf.alias("confidence"), "mean_valence",
        status.alias("status"), opposed.alias("negative_cases"),
    )
