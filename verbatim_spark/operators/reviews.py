"""Review intelligence: indicators, time, categories, bottlenecks, scores and
comparison of businesses. Reviews are rows (review_id, business, rating,
valence, months, responded); codes are rows (review_id, theme_id, valence, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ["0-3", "3-6", "6-12", "12+", "unknown"]


def sentiment_label(valence: Column) -> Column:
    return F.when(valence >= 0.12, "positive").when(valence <= -0.12, "negative").otherwise("neutral")


def blended_sentiment(valence: Column, rating: Column) -> Column:
    """Text and stars, 0.65 to 0.35; without a rating the text alone."""
    return F.coalesce(valence * 0.65 + (rating - 3) / 2.0 * 0.35, valence)


def bucket_for(months: Column) -> Column:
    return F.when(months.isNull(), "unknown").when(months < 3, "0-3").when(months < 6, "3-6").when(months < 12, "6-12").otherwise("12+")


def severity_grade(x: Column) -> Column:
    return F.when(x >= 0.66, 3).when(x >= 0.33, 2).otherwise(1)


def kpis(reviews: DataFrame, by: str = "business") -> DataFrame:
    """Counts and shares of sentiments, net sentiment score, mean rating,
    response rate and theme split of each business."""
    label = F.col("sentiment")
    n = F.count("*")
    p, m = F.count_if(label == "positive"), F.count_if(label == "negative")
    return reviews.groupBy(by).agg(
        n.alias("reviews"), p.alias("positive"), m.alias("negative"), F.count_if(label == "neutral").alias("neutral"),
        F.bround((p - m) / n * 100).cast("bigint").alias("nss"), F.round(F.avg("rating"), 4).alias("mean_rating"),
        F.round(p / n, 6).alias("positive_ratio"), F.round(m / n, 6).alias("negative_ratio"),
        F.round(F.count_if("responded") / n, 6).alias("response_rate"),
    )


def temporal_buckets(reviews: DataFrame) -> DataFrame:
    """Sentiments, mean rating and negative share by age; empty buckets don't appear."""
    n, negative = F.count("*"), F.count_if(F.col("sentiment") == "negative")
    return reviews.groupBy("bucket").agg(
        n.alias("reviews"), F.count_if(F.col("sentiment") == "positive").alias("positive"), negative.alias("negative"),
        F.count_if(F.col("sentiment") == "neutral").alias("neutral"), F.round(F.avg("rating"), 4).alias("mean_rating"),
        F.round(negative / n, 6).alias("negative_ratio"), F.round(F.avg("valence"), 6).alias("mean_valence"),
    )


def trend(reviews: DataFrame, least: float = 0.12) -> DataFrame:
    """The newest dated bucket's share of negative reviews against the oldest's."""
    order = F.when(F.col("bucket") == BUCKETS[0], 0).when(F.col("bucket") == BUCKETS[1], 1).when(F.col("bucket") == BUCKETS[2], 2).otherwise(3)
    shares = reviews.where("bucket <> 'unknown'").groupBy("bucket").agg(F.round(F.count_if(F.col("sentiment") == "negative") / F.count("*"), 3).alias("m")).withColumn("o", order)
    ends = shares.agg(F.min_by("m", "o").alias("newest"), F.max_by("m", "o").alias("oldest"), F.count("*").alias("buckets"))
    delta = F.round(F.col("newest") - F.col("oldest"), 6)
    return ends.select("buckets", delta.alias("delta"), F.when(F.col("buckets") < 2, "too few").when(delta > least, "rising").when(delta < -least, "falling").otherwise("stable").alias("trend"))


def bands(reviews: DataFrame, by: str = "business", least: int = 2, most: int = 8) -> DataFrame:
    """Equal-width bands of age, newest last: band number by arithmetic, so no
    range join; (low, high] in months, and age 0 in the newest."""
    span = reviews.where("months IS NOT NULL").groupBy(by).agg(F.greatest(F.max("months"), F.lit(1.0)).alias("span"), F.count("*").alias("n"))
    count = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.col("n") / 2)))
    sized = reviews.where("months IS NOT NULL").join(span, by).withColumn("bands", count.cast("int"))
    width = F.col("span") / F.col("bands")
    band = F.least(F.floor((F.col("span") - F.col("months")) / width), F.col("bands") - 1).cast("int")
    return sized.groupBy(by, band.alias("band")).agg(F.count("*").alias("reviews"), F.round(F.avg("valence"), 6).alias("mean_valence"))


def band_direction(banded: DataFrame, by: str = "business", least: float = 0.15) -> DataFrame:
    """Weighted means of the first and last third of the bands."""
    order = Window.partitionBy(by).orderBy("band")
    ranked = banded.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy(by))})
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    mean = lambda test: F.sum(F.when(test, F.col("mean_valence") * F.col("reviews"))) / F.sum(F.when(test, F.col("reviews")))
    delta = F.round(F.col("last") - F.col("first"), 6)
    return (
        ranked.groupBy(by).agg(mean(F.col("i") <= third).alias("first"), mean(F.col("i") > F.col("n") - third).alias("last"))
        .select(by, delta.alias("delta"), F.when(delta >= least, "improving").when(delta <= -least, "declining").otherwise("steady").alias("direction"))
    )


def category_counts(codes: DataFrame, by: list[str]) -> DataFrame:
    """Mentions and mean valence of each category, with totals over all rows of
    a category and over everything (null marks a total)."""
    return codes.cube(*by).agg(F.count("*").alias("mentions"), F.countDistinct("review_id").alias("reviews"), F.round(F.avg("valence"), 6).alias("mean_valence"))


def journey(codes: DataFrame, row: str, stage: str, keep: int = 2) -> DataFrame:
    """Cells of a matrix: number, mean valence, and the strongest examples in order."""
    strongest = Window.partitionBy(row, stage).orderBy(F.desc(F.abs("valence")), "example")
    ranked = codes.withColumn("rank", F.row_number().over(strongest))
    return ranked.groupBy(row, stage).agg(
        F.count("*").alias("n"), F.round(F.avg("valence"), 6).alias("mean_valence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= keep, F.struct("rank", "example")))), lambda x: x["example"].cast("string")), ",").alias("examples"),
    )


def synthesis(codes: DataFrame, row: str, stage: str) -> DataFrame:
    """Per stage: how many rows it reaches and the most negative example."""
    total = codes.agg(F.countDistinct(row).alias("all_rows"))
    return codes.groupBy(stage).agg(
        F.countDistinct(row).alias("rows"), F.min_by("example", F.struct("valence", "example")).alias("worst"), F.min("valence").alias("lowest")
    ).join(F.broadcast(total)).select(stage, "rows", F.round(F.col("rows") / F.col("all_rows"), 6).alias("coverage"), "worst", "lowest")


def is_complaint(valence: Column, rating: Column, friction: Column) -> Column:
    return (valence <= -0.12) | ((rating <= 2) & (valence <= 0.08)) | (friction & (valence <= 0.02))


def bottlenecks(codes: DataFrame, category: str, reviews: DataFrame, top: int = 12) -> DataFrame:
    """Complaints by category, ranked by severity, then mentions; a General service
    group of one goes. Coverage is of all reviews; ``friction`` counts the words of
    operational complaint in a code, ``months`` its age."""
    bad = codes.where(is_complaint(F.col("valence"), F.col("rating"), F.col("friction") > 0))
    total = reviews.agg(F.greatest(F.count("*"), F.lit(1)).alias("all_reviews"))
    grouped = bad.groupBy(category).agg(
        F.count("*").alias("mentions"), F.countDistinct("reviewer").alias("reviewers"), F.avg("valence").alias("mean"), F.sum("friction").alias("frictions"),
        F.round(F.avg("rating"), 2).alias("mean_rating"), F.count_if(F.col("months") <= 6).alias("recent"),
    ).join(F.broadcast(total))
    coverage = F.col("reviewers") / F.col("all_reviews")
    severity = F.round(F.least(F.lit(1.0), F.abs("mean") * 0.55 + coverage * 0.9 + F.least(F.col("frictions") / F.col("mentions"), F.lit(2.0)) * 0.12), 6)
    return (
        grouped.where((F.col(category) != "General service") | (F.col("mentions") > 1))
        .select(
            category, "mentions", "reviewers", F.round(coverage, 6).alias("coverage"), F.round("mean", 6).alias("mean_valence"), "mean_rating",
            F.round(F.col("recent") / F.col("mentions"), 2).alias("recent_share"), severity.alias("severity"), severity_grade(severity).alias("grade"),
        )
        .orderBy(F.desc("severity"), F.desc("mentions"), category).limit(top)
    )


def issue_phrases(codes: DataFrame, category: str) -> DataFrame:
    """The phrase that names each category's complaints: the most frequent, words of
    friction counted on top, the longer and then the last in order of equals."""
    bad = codes.where(is_complaint(F.col("valence"), F.col("rating"), F.col("friction") > 0))
    weighed = bad.groupBy(category, "phrase").agg(F.sum(1 + F.col("friction")).alias("w"))
    return weighed.groupBy(category).agg(F.max_by("phrase", F.struct("w", F.size(F.split("phrase", " ")), "phrase")).alias("issue"))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, ..."""
    last = F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), last)


def band_label(low: Column, high: Column) -> Column:
    """How a band of ages in months is called."""
    low = F.greatest(low, F.lit(0.0))
    whole = lambda x: F.bround(x).cast("bigint").cast("string")
    return F.when(high <= 1.5, "this month").when(low < 0.6, F.concat(F.lit("0-"), whole(high), F.lit(" mo"))).otherwise(F.concat(whole(low), F.lit("-"), whole(high), F.lit(" mo")))


def dimension_scores(codes: DataFrame, reviews: DataFrame, by: str, dimension: str, prior: float = 2.0, names: list[str] | None = None) -> DataFrame:
    """Scores of 1 to 10 from mean valences, shrunk to the business's rating (1 to 5
    stars on the same scale, 5.5 without any) as if ``prior`` mentions had said it;
    without mentions that baseline. Dimensions are the given ones or those that any
    code has; they come to each business as one array."""
    baseline = reviews.groupBy(by).agg(F.coalesce((F.avg("rating") - 1) / 4 * 9 + 1, F.lit(5.5)).alias("baseline"))
    if names is None:
        every = baseline.join(F.broadcast(codes.agg(F.collect_set(dimension).alias("_names")))).withColumn(dimension, F.explode("_names"))
    else:
        every = baseline.withColumn(dimension, F.explode(F.array(*map(F.lit, names))))
    means = codes.groupBy(by, dimension).agg(F.count("*").alias("n"), F.avg("valence").alias("m"))
    raw = F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.lit(5.5) + F.col("m") * 4.5))
    score = F.coalesce((raw * F.col("n") + F.col("baseline") * prior) / (F.col("n") + prior), F.col("baseline"))
    bounded = F.greatest(F.lit(1.0), F.least(F.lit(10.0), score))
    return every.join(means, [by, dimension], "left").select(by, dimension, F.coalesce("n", F.lit(0)).alias("mentions"), F.round(bounded, 6).alias("score"))


def theme_summary(codes: DataFrame, reviews_total: int | Column, keep: int = 4) -> DataFrame:
    """Per theme: evidence, coverage, means and the most negative examples."""
    worst = Window.partitionBy("theme_id").orderBy("valence", "example")
    ranked = codes.withColumn("rank", F.row_number().over(worst))
    return ranked.groupBy("theme_id").agg(
        F.count("*").alias("evidence"), F.round(F.countDistinct("reviewer") / reviews_total, 6).alias("coverage"),
        F.round(F.avg("valence"), 6).alias("mean_valence"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.round(F.avg("confidence"), 6).alias("confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= keep, F.struct("rank", "example")))), lambda x: x["example"].cast("string")), ",").alias("worst"),
    )


def theme_poles(codes: DataFrame, cut: float = 0.25) -> DataFrame:
    """Themes with codes at both poles: best and worst example and a severity
    that is higher if they come from different reviewers."""
    poles = codes.groupBy("theme_id").agg(
        F.count_if(F.col("valence") >= cut).alias("positive"), F.count_if(F.col("valence") <= -cut).alias("negative"),
        F.max_by(F.struct("example", "reviewer"), F.struct("valence", "example")).alias("best"), F.min_by(F.struct("example", "reviewer"), F.struct("valence", "example")).alias("worst"),
        F.max("valence").alias("high"), F.min("valence").alias("low"),
    )
    across = F.col("best.reviewer") != F.col("worst.reviewer")
    severity = F.least(F.lit(1.0), F.when(across, 0.7).otherwise(0.45) + (F.col("high") - F.col("low")) * 0.25)
    return poles.where("positive > 0 AND negative > 0").select(
        "theme_id", "positive", "negative", F.col("best.example").alias("best"), F.col("worst.example").alias("worst"), F.round(severity, 6).alias("severity")
    )


def rating_vs_text(reviews: DataFrame) -> DataFrame:
    """Stars that the text contradicts: four or more with a mean of -0.2 or
    below, two or fewer with 0.2 or above."""
    high = (F.col("rating") >= 4) & (F.col("valence") <= -0.2)
    low = (F.col("rating") <= 2) & (F.col("valence") >= 0.2)
    severity = F.when(high, F.least(F.lit(1.0), (F.col("rating") - 3) / 2.0 + F.abs("valence"))).otherwise(0.35)
    return reviews.where(high | low).select("review_id", "rating", F.round("valence", 6).alias("valence"), F.round(severity, 6).alias("severity"), F.when(high, "high stars").otherwise("low stars").alias("kind"))


def compare(scores: DataFrame, mine: str, theirs: str, by: str, dimension: str, defend: float = 0.8) -> DataFrame:
    """Two businesses dimension by dimension; a dimension that the other lacks counts as 5.5."""
    side = lambda name, alias: scores.where(F.col(by) == name).select(dimension, F.col("score").alias(alias))
    both = side(mine, "mine").join(side(theirs, "theirs"), dimension, "full").fillna(5.5, ["mine", "theirs"])
    gap = F.round(F.col("mine") - F.col("theirs"), 6)
    return both.select(dimension, "mine", "theirs", gap.alias("gap"), F.when(gap >= defend, "defend").when(gap <= -0.6, "adopt").otherwise("watch").alias("action"))


def kpi_delta(indicators: DataFrame, mine: str, theirs: str, by: str) -> DataFrame:
    """One row: net sentiment, mean rating and negative share, mine less theirs."""
    pick = lambda c, name: F.max(F.when(F.col(by) == name, F.col(c)))
    delta = lambda c, places: F.round(pick(c, mine) - pick(c, theirs), places).alias(c)
    return indicators.agg((pick("nss", mine) - pick("nss", theirs)).alias("nss"), delta("mean_rating", 2), delta("negative_ratio", 3))


def matrix(scores: DataFrame, mine: str, by: str, dimension: str, defend: float = 0.6) -> DataFrame:
    """Each dimension's best business among all, ours if none is strictly better,
    the gap to it, and whether our lead over all others is to be defended."""
    facts = scores.groupBy(dimension).agg(F.max(F.when(F.col(by) == mine, F.col("score"))).alias("own"), F.max(F.when(F.col(by) != mine, F.col("score"))).alias("other"))
    first = scores.where(F.col(by) != mine).groupBy(dimension).agg(F.min_by(by, F.struct(-F.col("score"), by)).alias("rival"))
    told = facts.join(first, dimension, "left").withColumn("own", F.coalesce("own", F.lit(5.5)))
    ahead = F.coalesce(F.col("other") > F.col("own"), F.lit(False))
    lead = F.round(F.col("own") - F.coalesce("other", F.col("own")), 6)
    return told.select(dimension, F.col("own").alias("mine"), F.when(ahead, F.col("rival")).otherwise(F.lit(mine)).alias("best"), F.when(ahead, lead).otherwise(0.0).alias("gap_to_best"), (lead > defend).alias("defend"))


def leaders(scores: DataFrame, by: str, dimension: str) -> DataFrame:
    """The best business in each dimension, the first by name of equals."""
    first = Window.partitionBy(dimension).orderBy(F.desc("score"), by)
    return scores.withColumn("rank", F.row_number().over(first)).where("rank = 1").select(dimension, F.col(by).alias("leader"), "score")


def ranking(indicators: DataFrame, by: str) -> DataFrame:
    """Businesses by net sentiment. There are few, so one task ranks them."""
    order = Window.orderBy(F.desc("nss"), by)
    return indicators.select(by, "nss", "mean_rating", F.row_number().over(order).alias("place"))


def adoption(scores: DataFrame, counts: DataFrame, mine: str, by: str, dimension: str, category: str, top: int = 8) -> DataFrame:
    """What rivals do better: dimensions with a gap of 0.6 or more, and
    categories that they win (two or more mentions, 0.15 or more, and not within
    0.2 of ours); one row a parameter, the largest gap first."""
    own = scores.where(F.col(by) == mine).select(dimension, F.col("score").alias("own"))
    by_dimension = (
        scores.where(F.col(by) != mine).join(own, dimension, "left").withColumn("gap", F.col("score") - F.coalesce("own", F.lit(5.5)))
        .where(F.round("gap", 6) >= 0.6).select(F.col(dimension).alias("parameter"), F.col(by).alias("rival"), F.round("gap", 6).alias("gap"), F.lit("dimension").alias("kind"))
    )
    ours = counts.where(F.col(by) == mine).select(category, F.col("mean_valence").alias("own"))
    by_category = (
        counts.where((F.col(by) != mine) & (F.col("mentions") >= 2) & (F.col("mean_valence") >= 0.15)).join(ours, category, "left")
        .withColumn("gap", F.round(F.col("mean_valence") - F.coalesce("own", F.lit(0.0)), 6)).where("gap > 0.2")
        .select(F.col(category).alias("parameter"), F.col(by).alias("rival"), "gap", F.lit("category").alias("kind"))
    )
    first = Window.partitionBy("parameter").orderBy(F.desc("gap"), "kind", "rival")
    best = by_dimension.unionByName(by_category).withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")
    return best.orderBy(F.desc("gap"), "parameter").limit(top)
