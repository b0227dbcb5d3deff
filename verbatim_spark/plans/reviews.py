"""Queries of review intelligence and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews as rv
from .views import APPS, REVIEWS, applications
from .views import reviews as review_rows
from .views import typed

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Valences are twentieths, so thresholds are compared in whole numbers there:
#: 0.12 lies between 2 and 3 twentieths.
_R = f"""{REVIEWS}, r AS (SELECT *, v / 20.0::DOUBLE AS valence, days / 30.44::DOUBLE AS months,
CASE WHEN v >= 3 THEN 'positive' WHEN v <= -3 THEN 'negative' ELSE 'neutral' END AS sentiment,
CASE WHEN days / 30.44::DOUBLE < 3 THEN '0-3' WHEN days / 30.44::DOUBLE < 6 THEN '3-6' WHEN days / 30.44::DOUBLE < 12 THEN '6-12' ELSE '12+' END AS bucket FROM reviews)"""


def _reviews(spark, sf):
    rows = review_rows(spark, sf).withColumns({"valence": F.col("v") / 20.0, "months": F.col("days") / 30.44})
    return rows.withColumns({"sentiment": rv.sentiment_label(F.col("valence")), "bucket": rv.bucket_for(F.col("months"))})


#: Codes of reviews: applications with the order's rating; valence in fifths.
_C = f"""{APPS}, {_R}, codes AS (SELECT a.quotation_id AS review_id, ((a.quotation_id * 10 + line) * 100000 + l_partkey) * 1000 + (a.v + 5) * 10 + tax AS example, theme_id, code_id, a.v, a.valence, a.confidence,
reviewer, business, rating, greatest(quantity - 40, 0) AS friction, months, bucket FROM apps a JOIN r ON a.quotation_id = r.review_id)"""


def _codes(spark, sf):
    apps = applications(spark, sf).select(
        F.col("quotation_id").alias("review_id"), (((F.col("quotation_id") * 10 + F.col("line")) * 100000 + F.col("l_partkey")) * 1000 + (F.col("v") + 5) * 10 + F.col("tax")).alias("example"), "theme_id", "code_id", "v", "valence", "confidence",
        F.greatest(F.col("quantity") - 40, F.lit(0)).alias("friction"), F.col("l_partkey").alias("part"),
    )
    return apps.join(_reviews(spark, sf).select("review_id", "reviewer", "business", "rating", "months", "bucket"), "review_id")


_KPI = """count(*) AS reviews, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative,
count(*) FILTER (sentiment = 'neutral') AS neutral, CAST(round_even((count(*) FILTER (sentiment = 'positive') - count(*) FILTER (sentiment = 'negative')) / count(*)::DOUBLE * 100, 0) AS BIGINT) AS nss,
round(avg(rating), 4) AS mean_rating, round(count(*) FILTER (sentiment = 'positive') / count(*)::DOUBLE, 6) AS positive_ratio,
round(count(*) FILTER (sentiment = 'negative') / count(*)::DOUBLE, 6) AS negative_ratio, round(count(*) FILTER (responded) / count(*)::DOUBLE, 6) AS response_rate"""


@query(f"WITH {_R} SELECT business, {_KPI} FROM r GROUP BY 1")
def review_kpis(spark, sf):
    return rv.kpis(_reviews(spark, sf))


@query(f"""WITH {_R} SELECT bucket, count(*) AS reviews, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative,
count(*) FILTER (sentiment = 'neutral') AS neutral, round(avg(rating), 4) AS mean_rating, round(count(*) FILTER (sentiment = 'negative') / count(*)::DOUBLE, 6) AS negative_ratio,
round(avg(valence), 6) AS mean_valence FROM r GROUP BY 1""")
def sentiment_buckets(spark, sf):
    return rv.temporal_buckets(_reviews(spark, sf))


@query(f"""WITH {_R}, m AS (SELECT bucket, round(count(*) FILTER (sentiment = 'negative') / count(*)::DOUBLE, 3) AS m, CASE bucket WHEN '0-3' THEN 0 WHEN '3-6' THEN 1 WHEN '6-12' THEN 2 ELSE 3 END AS o FROM r GROUP BY 1),
e AS (SELECT count(*) AS buckets, round(arg_min(m, o) - arg_max(m, o), 6) AS delta FROM m)
SELECT buckets, delta, CASE WHEN buckets < 2 THEN 'too few' WHEN delta > 0.12 THEN 'rising' WHEN delta < -0.12 THEN 'falling' ELSE 'stable' END AS trend FROM e""")
def trend_reading(spark, sf):
    return rv.trend(_reviews(spark, sf))


_BANDS = """s AS (SELECT business, greatest(max(months), 1.0) AS span, count(*) AS n FROM r GROUP BY 1),
b AS (SELECT r.*, span, CAST(greatest(2, least(8, floor(n / 2.0))) AS INTEGER) AS bands FROM r JOIN s USING (business)),
banded AS (SELECT business, CAST(least(floor((span - months) / (span / bands)), bands - 1) AS INTEGER) AS band, count(*) AS reviews, round(avg(valence), 6) AS mean_valence FROM b GROUP BY 1, 2)"""


@query(f"WITH {_R}, {_BANDS} SELECT * FROM banded")
def sentiment_bands(spark, sf):
    return rv.bands(_reviews(spark, sf))


@query(f"""WITH {_R}, {_BANDS}, k AS (SELECT *, row_number() OVER (PARTITION BY business ORDER BY band) AS i, count(*) OVER (PARTITION BY business) AS n FROM banded),
d AS (SELECT business, round(sum(mean_valence * reviews) FILTER (i > n - greatest(floor(n / 3.0), 1)) / sum(reviews) FILTER (i > n - greatest(floor(n / 3.0), 1))
 - sum(mean_valence * reviews) FILTER (i <= greatest(floor(n / 3.0), 1)) / sum(reviews) FILTER (i <= greatest(floor(n / 3.0), 1)), 6) AS delta FROM k GROUP BY 1)
SELECT business, delta, CASE WHEN delta >= 0.15 THEN 'improving' WHEN delta <= -0.15 THEN 'declining' ELSE 'steady' END AS direction FROM d""")
def sentiment_direction(spark, sf):
    return rv.band_direction(rv.bands(_reviews(spark, sf)))


@query(f"""WITH {_C} SELECT theme_id, business, count(*) AS mentions, count(DISTINCT review_id) AS reviews, round(avg(valence), 6) AS mean_valence
FROM codes GROUP BY CUBE (theme_id, business)""")
def content_counts(spark, sf):
    return rv.category_counts(_codes(spark, sf), ["theme_id", "business"])


@query(f"""WITH {_C}, k AS (SELECT *, row_number() OVER (PARTITION BY business, theme_id ORDER BY abs(valence) DESC, example) AS rk FROM codes)
SELECT business, theme_id, count(*) AS n, round(avg(valence), 6) AS mean_valence, string_agg(CAST(example AS VARCHAR), ',' ORDER BY rk) FILTER (rk <= 2) AS examples FROM k GROUP BY 1, 2""")
def journey_matrix(spark, sf):
    return rv.journey(_codes(spark, sf), "business", "theme_id")


@query(f"""WITH {_C} SELECT theme_id, count(DISTINCT reviewer) AS rows, round(count(DISTINCT reviewer) / (SELECT count(DISTINCT reviewer) FROM codes)::DOUBLE, 6) AS coverage,
arg_min(example, (valence, example)) AS worst, min(valence) AS lowest FROM codes GROUP BY 1""")
def journey_synthesis(spark, sf):
    return rv.synthesis(_codes(spark, sf), "reviewer", "theme_id")


#: A fifth is 0.2, so the thresholds fall between whole fifths.
_BAD = "(v <= -1 OR (rating <= 2 AND v <= 0) OR (friction > 0 AND v <= 0))"


@query(f"WITH {_C} SELECT review_id, example FROM codes WHERE {_BAD}")
def complaints(spark, sf):
    return _codes(spark, sf).where(rv.is_complaint(F.col("valence"), F.col("rating"), F.col("friction") > 0)).select("review_id", "example")


@query(f"""WITH {_C}, g AS (SELECT theme_id, count(*) AS mentions, count(DISTINCT reviewer) AS reviewers, avg(valence) AS m, sum(friction) AS f, round(avg(rating), 2) AS mean_rating, count(*) FILTER (months <= 6) AS recent,
 (SELECT count(*) FROM r)::DOUBLE AS n FROM codes WHERE {_BAD} GROUP BY 1),
s AS (SELECT *, round(least(1.0, abs(m) * 0.55 + reviewers / n * 0.9 + least(f / mentions::DOUBLE, 2.0) * 0.12), 6) AS severity FROM g)
SELECT theme_id, mentions, reviewers, round(reviewers / n, 6) AS coverage, round(m, 6) AS mean_valence, mean_rating, round(recent / mentions::DOUBLE, 2) AS recent_share, severity,
CASE WHEN severity >= 0.66 THEN 3 WHEN severity >= 0.33 THEN 2 ELSE 1 END AS grade FROM s ORDER BY severity DESC, mentions DESC, theme_id LIMIT 12""")
def bottlenecks(spark, sf):
    return rv.bottlenecks(_codes(spark, sf), "theme_id", _reviews(spark, sf))


@query(f"""WITH {_C}, w AS (SELECT theme_id, code_id AS phrase, sum(1 + friction) AS w FROM codes WHERE {_BAD} GROUP BY 1, 2)
SELECT theme_id, arg_max(phrase, (w, len(string_split(phrase, ' ')), phrase)) AS issue FROM w GROUP BY 1""")
def issue_phrases(spark, sf):
    return rv.issue_phrases(_codes(spark, sf).withColumn("phrase", F.col("code_id")), "theme_id")


@query(f"""WITH {_R}, k AS (SELECT business, count(*) AS n, max(months) AS high FROM r GROUP BY 1)
SELECT business, n || CASE WHEN n % 100 BETWEEN 10 AND 20 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
CASE WHEN high <= 1.5 THEN 'this month' WHEN high / 2 < 0.6 THEN '0-' || CAST(round_even(high, 0) AS BIGINT) || ' mo' ELSE CAST(round_even(high / 2, 0) AS BIGINT) || '-' || CAST(round_even(high, 0) AS BIGINT) || ' mo' END AS band FROM k""")
def labels(spark, sf):
    facts = _reviews(spark, sf).groupBy("business").agg(F.count("*").alias("n"), F.max("months").alias("high"))
    return facts.select("business", rv.ordinal(F.col("n")).alias("ordinal"), rv.band_label(F.col("high") / 2, F.col("high")).alias("band"))


_SCORES = f"""{_C}, base AS (SELECT business, (avg(rating) - 1) / 4 * 9 + 1 AS baseline FROM r GROUP BY 1), dims AS (SELECT DISTINCT theme_id FROM codes),
mm AS (SELECT business, theme_id, count(*) AS n, avg(valence) AS m FROM codes GROUP BY 1, 2),
scores AS (SELECT business, theme_id, coalesce(n, 0) AS mentions,
 round(greatest(1.0, least(10.0, coalesce((greatest(1.0, least(10.0, 5.5 + m * 4.5)) * n + baseline * 2) / (n + 2), baseline))), 6) AS score FROM base CROSS JOIN dims LEFT JOIN mm USING (business, theme_id))"""


def _scores(spark, sf):
    return rv.dimension_scores(_codes(spark, sf), _reviews(spark, sf), "business", "theme_id")


@query(f"WITH {_SCORES} SELECT * FROM scores")
def dimension_scores(spark, sf):
    return _scores(spark, sf)


@query(f"""WITH {_SCORES}, a AS (SELECT theme_id, score AS mine FROM scores WHERE business = 'BUILDING'), b AS (SELECT theme_id, score AS theirs FROM scores WHERE business = 'MACHINERY'),
j AS (SELECT theme_id, coalesce(mine, 5.5) AS mine, coalesce(theirs, 5.5) AS theirs FROM a FULL JOIN b USING (theme_id))
SELECT *, round(mine - theirs, 6) AS gap, CASE WHEN round(mine - theirs, 6) >= 0.8 THEN 'defend' WHEN round(mine - theirs, 6) <= -0.6 THEN 'adopt' ELSE 'watch' END AS action FROM j""")
def compare_pair(spark, sf):
    return rv.compare(_scores(spark, sf), "BUILDING", "MACHINERY", "business", "theme_id")


@query(f"""WITH {_R}, k AS (SELECT business, {_KPI} FROM r GROUP BY 1), a AS (SELECT * FROM k WHERE business = 'BUILDING'), b AS (SELECT * FROM k WHERE business = 'MACHINERY')
SELECT a.nss - b.nss AS nss, round(a.mean_rating - b.mean_rating, 2) AS mean_rating, round(a.negative_ratio - b.negative_ratio, 3) AS negative_ratio FROM a, b""")
def kpi_delta(spark, sf):
    return rv.kpi_delta(rv.kpis(_reviews(spark, sf)), "BUILDING", "MACHINERY", "business")


#: Parts as dimensions: some six mentions each of a business, so that scores differ.
_PART_SCORES = f"""{_C}, pc AS (SELECT l_partkey AS part, business, valence FROM codes JOIN (SELECT l_orderkey, l_partkey, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + (CAST(round(l_discount * 100) AS INTEGER)) * 10 + CAST(round(l_tax * 100) AS INTEGER) AS example FROM lineitem) USING (example)),
base AS (SELECT business, (avg(rating) - 1) / 4 * 9 + 1 AS baseline FROM r GROUP BY 1), dims AS (SELECT DISTINCT part FROM pc), mm AS (SELECT business, part, count(*) AS n, avg(valence) AS m FROM pc GROUP BY 1, 2),
scores AS (SELECT business, part, round(greatest(1.0, least(10.0, coalesce((greatest(1.0, least(10.0, 5.5 + m * 4.5)) * n + baseline * 2) / (n + 2), baseline))), 6) AS score FROM base CROSS JOIN dims LEFT JOIN mm USING (business, part)),
counts AS (SELECT business, part, n AS mentions, round(m, 6) AS mean_valence FROM mm)"""


@query(f"""WITH {_PART_SCORES}, f AS (SELECT part, coalesce(max(score) FILTER (business = 'BUILDING'), 5.5) AS mine, max(score) FILTER (business <> 'BUILDING') AS other, arg_min(business, (-score, business)) FILTER (business <> 'BUILDING') AS rival FROM scores GROUP BY 1)
SELECT part, mine, CASE WHEN other > mine THEN rival ELSE 'BUILDING' END AS best, CASE WHEN other > mine THEN round(mine - other, 6) ELSE 0 END AS gap_to_best, round(mine - coalesce(other, mine), 6) > 0.6 AS defend FROM f""")
def competitor_matrix(spark, sf):
    scores = rv.dimension_scores(_codes(spark, sf), _reviews(spark, sf), "business", "part")
    return rv.matrix(scores, "BUILDING", "business", "part")


@query(f"""WITH {_SCORES} SELECT theme_id, business AS leader, score FROM scores QUALIFY row_number() OVER (PARTITION BY theme_id ORDER BY score DESC, business) = 1""")
def competitor_leaders(spark, sf):
    return rv.leaders(_scores(spark, sf), "business", "theme_id")


@query(f"WITH {_R}, k AS (SELECT business, {_KPI} FROM r GROUP BY 1) SELECT business, nss, mean_rating, row_number() OVER (ORDER BY nss DESC, business) AS place FROM k")
def competitor_ranking(spark, sf):
    return rv.ranking(rv.kpis(_reviews(spark, sf)), "business")


_ADOPT = f"""{_PART_SCORES}, bd AS (SELECT part AS parameter, business AS rival, round(s.score - coalesce(o.score, 5.5), 6) AS gap, 'dimension' AS kind FROM scores s LEFT JOIN (SELECT part, score FROM scores WHERE business = 'BUILDING') o USING (part) WHERE business <> 'BUILDING'),
bc AS (SELECT part AS parameter, business AS rival, round(c.mean_valence - coalesce(o.mean_valence, 0.0), 6) AS gap, 'category' AS kind FROM counts c LEFT JOIN (SELECT part, mean_valence FROM counts WHERE business = 'BUILDING') o USING (part)
 WHERE business <> 'BUILDING' AND mentions >= 2 AND c.mean_valence >= 0.15),
u AS (SELECT * FROM bd WHERE gap >= 0.6 UNION ALL SELECT * FROM bc WHERE gap > 0.2)"""


@query(f"""WITH {_ADOPT}, k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY parameter ORDER BY gap DESC, kind, rival) = 1)
SELECT parameter, rival, gap, kind FROM k ORDER BY gap DESC, parameter LIMIT 8""")
def adoption_gaps(spark, sf):
    codes = _codes(spark, sf)
    scores = rv.dimension_scores(codes, _reviews(spark, sf), "business", "part")
    counts = codes.groupBy("business", "part").agg(F.count("*").alias("mentions"), F.round(F.avg("valence"), 6).alias("mean_valence"))
    return rv.adoption(scores, counts, "BUILDING", "business", "part", "part")


@query(f"""WITH {_C}, k AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY valence, example) AS rk FROM codes)
SELECT theme_id, count(*) AS evidence, round(count(DISTINCT reviewer) / 1000.0::DOUBLE, 6) AS coverage, round(avg(valence), 6) AS mean_valence, round(avg(rating), 6) AS mean_rating,
round(avg(confidence), 6) AS confidence, string_agg(CAST(example AS VARCHAR), ',' ORDER BY rk) FILTER (rk <= 4) AS worst FROM k GROUP BY 1""")
def theme_finalise(spark, sf):
    return rv.theme_summary(_codes(spark, sf), F.lit(1000))


@query(f"""WITH {_C}, p AS (SELECT code_id AS theme_id, count(*) FILTER (v >= 2) AS positive, count(*) FILTER (v <= -2) AS negative, arg_max(example, (valence, example)) AS best,
arg_min(example, (valence, example)) AS worst, arg_max(reviewer, (valence, example)) AS br, arg_min(reviewer, (valence, example)) AS wr, max(valence) AS hi, min(valence) AS lo FROM codes GROUP BY 1)
SELECT theme_id, positive, negative, best, worst, round(least(1.0, CASE WHEN br <> wr THEN 0.7 ELSE 0.45 END + (hi - lo) * 0.25), 6) AS severity FROM p WHERE positive > 0 AND negative > 0""")
def theme_poles(spark, sf):
    return rv.theme_poles(_codes(spark, sf).withColumn("theme_id", F.col("code_id")))


@query(f"""WITH {_R} SELECT review_id, rating, round(valence, 6) AS valence, round(CASE WHEN rating >= 4 THEN least(1.0, (rating - 3) / 2.0::DOUBLE + abs(valence)) ELSE 0.35 END, 6) AS severity,
CASE WHEN rating >= 4 THEN 'high stars' ELSE 'low stars' END AS kind FROM r WHERE rating >= 4 AND v <= -4 OR rating <= 2 AND v >= 4""")
def rating_vs_text(spark, sf):
    return rv.rating_vs_text(_reviews(spark, sf))


@query(f"WITH {_R} SELECT review_id, round(coalesce(valence * 0.65 + (CASE WHEN review_id % 7 <> 0 THEN rating END - 3) / 2.0::DOUBLE * 0.35, valence), 6) AS blended FROM r")
def blended_sentiment(spark, sf):
    rating = F.when(F.col("review_id") % 7 != 0, F.col("rating"))
    return _reviews(spark, sf).select("review_id", F.round(rv.blended_sentiment(F.col("valence"), rating), 6).alias("blended"))


typed(ORACLE, {"competitor_ranking": {"place": "INTEGER"}})
