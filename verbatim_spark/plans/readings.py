"""Queries of methodology readings and vector operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus, methods, readings, vectors
from .views import APPS, applications, read, typed

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: A supplier is a participant; its codes are ordered by quotation and line.
_C = f"""{APPS}, c AS (SELECT *, l_suppkey AS participant, ((quotation_id * 10 + line) * 100000 + l_partkey) * 1000 + (v + 5) * 10 + tax AS ord, ((quotation_id * 10 + line) * 100000 + l_partkey) * 1000 + (v + 5) * 10 + tax AS example, quantity AS score,
CASE WHEN v > 1 THEN 'glad' WHEN v < -1 THEN 'sad' ELSE 'neutral' END AS mood, 1 + line % 3 AS alternatives, 0.3::DOUBLE AS cohesion FROM apps)"""


def _codes(spark, sf):
    mark = ((F.col("quotation_id") * 10 + F.col("line")) * 100000 + F.col("l_partkey")) * 1000 + (F.col("v") + 5) * 10 + F.col("tax")
    mood = F.when(F.col("v") > 1, "glad").when(F.col("v") < -1, "sad").otherwise("neutral")
    return applications(spark, sf).withColumns({
        "participant": F.col("l_suppkey"), "ord": mark, "example": mark, "score": F.col("quantity"), "mood": mood, "alternatives": 1 + F.col("line") % 3, "cohesion": F.lit(0.3),
    })


@query(f"WITH {_C} SELECT ord, round((row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY participant) - 1, 1)::DOUBLE, 6) AS pos FROM c WINDOW w AS (PARTITION BY participant ORDER BY ord)")
def relative_position(spark, sf):
    return readings.relative_position(_codes(spark, sf)).select("ord", F.round("pos", 6).alias("pos"))


@query(f"""WITH {_C}, d AS (SELECT participant, ord, round(valence - lag(valence) OVER (PARTITION BY participant ORDER BY ord), 6) AS delta FROM c)
SELECT participant, ord, delta, row_number() OVER (PARTITION BY participant ORDER BY abs(delta) DESC, ord) AS rank, CASE WHEN delta > 0 THEN 'upturn' ELSE 'downturn' END AS direction
FROM d WHERE abs(delta) >= 0.7 QUALIFY rank <= 4""")
def turning_points(spark, sf):
    return readings.turning_points(_codes(spark, sf))


#: A customer as participant: some forty codes each, so stories of all shapes.
_D = f"{_C}, cd AS (SELECT * REPLACE (document_id AS participant) FROM c)"


def _by_document(spark, sf):
    return _codes(spark, sf).withColumn("participant", F.col("document_id"))


_SHAPE = f"""{_D}, i AS (SELECT participant, valence, row_number() OVER (PARTITION BY participant ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY participant) AS n FROM cd),
f AS (SELECT participant, count(*) AS n, round(regr_slope(valence, i), 6) AS slope, round(avg(valence) FILTER (i < n // 3), 6) AS a,
round(avg(valence) FILTER (i >= n // 3 AND i < 2 * n // 3), 6) AS b, round(avg(valence) FILTER (i >= 2 * n // 3), 6) AS c FROM i GROUP BY 1)"""


@query(f"""WITH {_SHAPE} SELECT *, CASE WHEN n < 3 THEN 'fragment' WHEN b < a - 0.25 AND c > b + 0.25 THEN 'redemptive' WHEN b > a + 0.25 AND c < b - 0.25 THEN 'contaminative'
WHEN slope > 0.02 THEN 'progressive' WHEN slope < -0.02 THEN 'regressive' ELSE 'stable' END AS shape FROM f""")
def plot_shape(spark, sf):
    return readings.plot_shape(_by_document(spark, sf))


_PULL = {
    "orientation": "0", "complication": "CASE WHEN valence < -0.4 THEN 0.5 ELSE 0 END", "evaluation": "CASE WHEN abs(valence) > 0.35 THEN 0.6 ELSE 0 END",
    "resolution": "CASE WHEN valence > 0.35 THEN 0.35 ELSE 0 END", "coda": "0",
}
_PARTS = ", ".join(
    f"{{'n': '{n}', 'o': {-i}, 's': round((q = {i})::INT::DOUBLE + greatest(0.0::DOUBLE, 1 - abs(pos - {place}::DOUBLE) * {fade}::DOUBLE) + ({_PULL[n]})::DOUBLE, 9)}}"
    for i, (n, (place, fade)) in enumerate(readings.LABOV.items())
)


@query(f"""WITH {_C}, p AS (SELECT row_number() OVER () AS rid, valence, quantity % 5 AS q, (row_number() OVER (PARTITION BY participant ORDER BY ord) - 1) / greatest(count(*) OVER (PARTITION BY participant) - 1, 1)::DOUBLE AS pos FROM c),
s AS (SELECT rid, unnest([{_PARTS}]) AS x FROM p), e AS (SELECT rid, arg_max(x.n, (x.s, x.o)) AS element FROM s GROUP BY 1) SELECT element, count(*) AS n FROM e GROUP BY 1""")
def labov_elements(spark, sf):
    hits = {n: (F.col("quantity") % 5 == i).cast("int") for i, n in enumerate(readings.LABOV)}
    told = readings.labov_elements(readings.relative_position(_codes(spark, sf)), hits)
    return told.groupBy("element").agg(F.count("*").alias("n"))


@query(f"""WITH {_C}, e AS (SELECT DISTINCT document_id, code_id AS item FROM c), f AS (SELECT item, min(document_id) AS document_id FROM e GROUP BY 1), n AS (SELECT document_id, count(*) AS new FROM f GROUP BY 1),
s AS (SELECT document_id, count(*) AS items, coalesce(any_value(new), 0) AS new FROM e LEFT JOIN n USING (document_id) GROUP BY 1)
SELECT document_id, items, new, sum(new) OVER (ORDER BY document_id)::BIGINT AS seen, round(new / items::DOUBLE, 6) AS rate, row_number() OVER (ORDER BY document_id) >= 3 AND round(new / items::DOUBLE, 6) <= 0.12 AS saturated FROM s""")
def saturation_curve(spark, sf):
    return readings.saturation(_codes(spark, sf).withColumn("item", F.col("code_id")))


_CHART = f"""{_D}, r AS (SELECT *, row_number() OVER (PARTITION BY participant, code_id ORDER BY round(score * confidence, 6) DESC, example) AS rk FROM cd),
cl AS (SELECT participant, code_id, count(*) AS n, round(avg(valence) FILTER (rk <= 3), 6) AS mean_valence, string_agg(CAST(example AS VARCHAR), ',' ORDER BY rk) FILTER (rk <= 3) AS examples FROM r GROUP BY 1, 2),
cells AS (SELECT participant, code_id, coalesce(n, 0) AS n, mean_valence, examples FROM (SELECT DISTINCT participant FROM cd) CROSS JOIN (SELECT DISTINCT code_id FROM cd) LEFT JOIN cl USING (participant, code_id))"""


@query(f"WITH {_CHART} SELECT * FROM cells")
def framework_chart(spark, sf):
    return readings.chart(_by_document(spark, sf), "participant", "code_id")


def _cells(spark, sf):
    codes = _by_document(spark, sf)
    return readings.cells(codes, "participant", "code_id"), codes.select("participant").distinct()


@query(f"""WITH {_CHART}, m AS (SELECT code_id, round(count(*) FILTER (n > 0) / count(*)::DOUBLE, 6) AS coverage, round(avg(mean_valence), 6) AS mean, round(max(mean_valence) - min(mean_valence), 6) AS spread FROM cells GROUP BY 1)
SELECT *, CASE WHEN spread > 0.8 THEN 'divided' WHEN mean < -0.2 THEN 'consistently negative' WHEN mean > 0.2 THEN 'consistently positive' ELSE 'mixed' END AS pattern FROM m""")
def framework_mapping(spark, sf):
    return readings.mapping(*_cells(spark, sf), "code_id")


@query(f"WITH {_CHART} SELECT code_id, count(*) FILTER (n = 0) AS empty, count(*) AS cells FROM cells GROUP BY 1 HAVING count(*) FILTER (n = 0) BETWEEN 1 AND count(*) - 1 ORDER BY code_id LIMIT 10")
def framework_gaps(spark, sf):
    return readings.gaps(*_cells(spark, sf), "code_id")


@query(f"""WITH {_C}, k AS (SELECT code_id, mood, count(*) AS k FROM c GROUP BY 1, 2), t AS (SELECT code_id, arg_max(mood, (k, mood)) AS mood FROM k GROUP BY 1)
SELECT code_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM c)::DOUBLE, 6) AS share, round(count(DISTINCT participant) / (SELECT count(DISTINCT participant) FROM c)::DOUBLE, 6) AS spread,
round(avg(valence), 6) AS mean_valence, any_value(t.mood) AS mood FROM c JOIN t USING (code_id) GROUP BY 1""")
def latent_layer(spark, sf):
    return readings.latent(_codes(spark, sf), "code_id")


@query(f"""WITH {_C} SELECT count(*) AS units, round(count(*) FILTER (tax < 8) / count(*)::DOUBLE, 6) AS coverage, round(avg(confidence), 6) AS confidence,
count(*) FILTER (alternatives > 1) AS ambiguous, count(*) FILTER (confidence < 0.95) AS low FROM c""")
def reliability(spark, sf):
    return readings.reliability(_codes(spark, sf), F.col("tax") < 8, 0.95)


@query(f"""WITH {_C}, m AS (SELECT code_id AS theme_id, participant, avg(valence) AS m FROM c GROUP BY 1, 2), n AS (SELECT count(DISTINCT participant) AS n FROM c)
SELECT theme_id, count(*) AS present, any_value(n) - count(*) AS absent, round(count(*) / any_value(n)::DOUBLE, 6) AS share, round(max(m) - min(m), 6) AS range, round(max(m) - min(m), 6) > 0.5 AS divergent FROM m, n GROUP BY 1""")
def group_convergence(spark, sf):
    codes = _codes(spark, sf).withColumn("theme_id", F.col("code_id"))
    return readings.convergence(codes)


@query(f"""WITH {_C}, o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY theme_id, participant ORDER BY confidence DESC, example) = 1)
SELECT theme_id, participant, example, row_number() OVER (PARTITION BY theme_id ORDER BY confidence DESC, example) AS rank FROM o QUALIFY rank <= 5""")
def exemplars(spark, sf):
    return readings.exemplars(_codes(spark, sf))


@query(f"""WITH {_C}, k AS (SELECT theme_id, code_id, count(*) AS k, min(valence) AS lo, max(valence) AS hi FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY k DESC, code_id) AS rk FROM k),
m AS (SELECT theme_id, mood, count(*) AS k FROM c WHERE mood <> 'neutral' GROUP BY 1, 2), f AS (SELECT theme_id, string_agg(mood, ',' ORDER BY k DESC, mood) AS moods FROM m GROUP BY 1)
SELECT theme_id, string_agg(code_id, ',' ORDER BY rk) FILTER (rk <= 6) AS phrases, round(min(lo), 6) AS low, round(max(hi), 6) AS high, any_value(f.moods) AS moods FROM r JOIN f USING (theme_id) GROUP BY 1""")
def category_properties(spark, sf):
    return readings.properties(_codes(spark, sf), "code_id")


@query(f"""WITH {_C}, t AS (SELECT theme_id, count(DISTINCT code_id) AS density, round(count(*) / (SELECT count(*) FROM c)::DOUBLE, 6) AS centrality, count(DISTINCT participant) AS participants FROM c GROUP BY 1)
SELECT *, round(centrality * (1 + 0.12 * density) * (1 + 0.08 * participants), 6) AS weight FROM t ORDER BY weight DESC, theme_id LIMIT 1""")
def core_category(spark, sf):
    codes = _codes(spark, sf)
    total = codes.agg(F.count("*").alias("all_codes"))
    facts = codes.groupBy("theme_id").agg(F.count_distinct("code_id").alias("density"), F.count("*").alias("n"), F.count_distinct("participant").alias("participants"))
    facts = facts.join(F.broadcast(total)).select("theme_id", "density", F.round(F.col("n") / F.col("all_codes"), 6).alias("centrality"), "participants")
    return readings.core_category(facts)


@query(f"""WITH {_C}, x AS (SELECT document_id AS theme_id, valence, example FROM c), m AS (SELECT theme_id, round(avg(valence), 6) AS mean FROM x GROUP BY 1)
SELECT theme_id, example, valence, mean FROM x JOIN m USING (theme_id) WHERE mean < -0.1 AND valence > 0.25 OR mean > 0.1 AND valence < -0.25""")
def negative_cases(spark, sf):
    codes = _codes(spark, sf).withColumn("theme_id", F.col("document_id"))
    return readings.contrary_valence(codes).select("theme_id", "example", "valence", "mean")


@query(f"""WITH {_C}, x AS (SELECT * REPLACE (document_id AS theme_id) FROM c), f AS (SELECT theme_id, count(*) AS members, count(DISTINCT participant) AS participants, avg(confidence) AS cf, round(avg(valence), 6) AS mean_valence,
 count(*) FILTER (valence > 0.25) AS hi, count(*) FILTER (valence < -0.25) AS lo FROM x GROUP BY 1),
g AS (SELECT *, round(round(greatest(0.05, least(0.99, cf * (0.7 + 0.3 * 0.6))), 12), 6) AS conf FROM f WHERE members >= 3)
SELECT theme_id, members, participants, round(members / (SELECT count(*) FROM c)::DOUBLE, 6) AS coverage, conf AS confidence, mean_valence,
CASE WHEN members >= 20 AND participants >= 15 AND conf >= 0.845 THEN 'confirmed' WHEN members >= 19 OR participants >= 15 THEN 'review' ELSE 'candidate' END AS status,
CASE WHEN mean_valence < -0.1 THEN hi WHEN mean_valence > 0.1 THEN lo ELSE 0 END AS negative_cases FROM g""")
def theme_summary(spark, sf):
    return readings.theme_summary(_codes(spark, sf).withColumn("theme_id", F.col("document_id")), min_quotes=20, min_participants=15, least_confidence=0.845)


@query(f"""WITH {_C} SELECT participant, mood, count(*) AS n FROM c GROUP BY ROLLUP (participant, mood)""")
def experiential_rollup(spark, sf):
    return _codes(spark, sf).rollup("participant", "mood").agg(F.count("*").alias("n"))


@query(f"""WITH {_C} SELECT participant, theme_id, count(*) AS weight FROM c GROUP BY 1, 2""")
def dashboard_edges(spark, sf):
    return _codes(spark, sf).groupBy("participant", "theme_id").agg(F.count("*").alias("weight"))


@query(f"""WITH {_C} SELECT code_id AS label, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, label LIMIT 12""")
def open_coding(spark, sf):
    return methods.open_coding(_codes(spark, sf).withColumn("label", F.col("code_id")))


_ACT, _PAS = ["the", "of"], ["and"]
_hit = lambda c: f"CAST(regexp_matches(lower(text), '(^|[^a-z]){c}([^a-z]|$)') AS INTEGER)"


@query(f"""WITH a AS (SELECT source, sum({" + ".join(map(_hit, _ACT))})::BIGINT AS active, sum({" + ".join(map(_hit, _PAS))})::BIGINT AS passive FROM documents GROUP BY 1),
r AS (SELECT *, CASE WHEN active + passive = 0 THEN 0.5 ELSE round(active / (active + passive)::DOUBLE, 6) END AS ratio FROM a)
SELECT *, CASE WHEN active + passive = 0 THEN 'unmarked' WHEN ratio > 0.65 THEN 'agent' WHEN ratio < 0.35 THEN 'acted upon' ELSE 'mixed' END AS band FROM r""")
def agency_ratio(spark, sf):
    docs = read(spark, sf, "documents")
    counts = docs.groupBy("source").agg(F.sum(tx.cue_hits(F.col("text"), _ACT)).alias("active"), F.sum(tx.cue_hits(F.col("text"), _PAS)).alias("passive"))
    return readings.agency(counts)


_MARKS = ["the", "from", "what", "then"]


@query(f"""WITH h AS (SELECT m AS marker, count(*) AS n FROM documents, (SELECT unnest({_MARKS}) AS m) WHERE contains(' ' || lower(text) || ' ', ' ' || m || ' ') GROUP BY 1)
SELECT * FROM h ORDER BY n DESC, marker LIMIT 8""")
def temporal_markers(spark, sf):
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    found = F.filter(tx.strings(_MARKS), lambda m: padded.contains(F.concat(F.lit(" "), m, F.lit(" "))))
    return read(spark, sf, "documents").select(F.explode(found).alias("marker")).groupBy("marker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "marker").limit(8)


_TOK = "regexp_extract_all(lower(text), '[a-z][a-z''’-]*')"
_TF = f"""tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT conv_id * 100 + turn AS doc, unnest({_TOK}) AS term FROM conversations) GROUP BY 1, 2), nn AS (SELECT count(*) AS n FROM conversations),
idf AS (SELECT term, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 0.5::DOUBLE)) + 1 AS idf FROM tf, nn GROUP BY 1),
raw AS (SELECT doc, term, tf / sum(tf) OVER (PARTITION BY doc) * idf AS w FROM tf JOIN idf USING (term)), vec AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM raw)"""


def _tf(spark, sf):
    turns = read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc"), "text")
    counts = turns.select("doc", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    return counts, turns.agg(F.count("*").alias("n"))


@query(f"WITH {_TF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark, sf):
    return vectors.idf_table(*_tf(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


def _vectors(spark, sf):
    counts, total = _tf(spark, sf)
    return vectors.tfidf(counts, vectors.idf_table(counts, total))


@query(f"WITH {_TF} SELECT doc, term, round(weight, 6) AS weight FROM vec")
def tfidf_weights(spark, sf):
    return _vectors(spark, sf).select("doc", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_TF} SELECT doc, term, row_number() OVER (PARTITION BY doc ORDER BY round(weight, 6) DESC, term) AS rank FROM vec QUALIFY rank <= 6")
def top_terms(spark, sf):
    return vectors.top_terms(_vectors(spark, sf), 6).select("doc", "term", "rank")


@query(f"""WITH {APPS}, p AS (SELECT DISTINCT quotation_id AS doc, code_id AS term FROM apps), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
m AS (SELECT x.term AS a, y.term AS b, count(*) AS c FROM p x JOIN p y ON x.doc = y.doc AND x.term <> y.term GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT a, b, c, round(c / sqrt(da.df * db.df), 6) AS strength FROM m JOIN d da ON a = da.term JOIN d db ON b = db.term)
SELECT *, row_number() OVER (PARTITION BY a ORDER BY strength DESC, b) AS rank FROM s QUALIFY rank <= 4""")
def term_cooccurrence(spark, sf):
    pairs = applications(spark, sf).select(F.col("quotation_id").alias("doc"), F.col("code_id").alias("term")).distinct()
    return vectors.co_occurrence(pairs)


_U = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS u FROM embeddings)"


def _unit(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", "label", vectors.unit("embedding").alias("u"))


@query(f"WITH {_U} SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.u, b.u), 6) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.u, b.u) >= 0.35")
def similarity_edges(spark, sf):
    return vectors.dense_edges(_unit(spark, sf), 0.35).select("i", "j", F.round("sim", 6).alias("sim"))


_CENT = f"""{_U}, cx AS (SELECT label, k, avg(x) AS x FROM (SELECT label, unnest(u) AS x, unnest(range(0, len(u))) AS k FROM u) GROUP BY 1, 2), cn AS (SELECT label, k, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM cx)"""


@query(f"WITH {_CENT} SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 6) AS sim FROM cn a JOIN cn b ON a.k = b.k AND a.label < b.label GROUP BY 1, 2")
def centroid_similarity(spark, sf):
    return vectors.centroid_similarity(vectors.centroids(_unit(spark, sf), "label"), "label")


@query(f"""WITH {_U}, s AS (SELECT label, k, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM (SELECT label, unnest(u) AS x, unnest(range(0, len(u))) AS k FROM u) GROUP BY 1, 2)
SELECT label, max(n) AS members, round(CASE WHEN max(n) < 2 THEN 0.5 ELSE (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)) END, 6) AS cohesion FROM s GROUP BY 1""")
def cohesion(spark, sf):
    return vectors.cohesion(_unit(spark, sf), "label")


@query("""WITH a AS (SELECT vec_id AS member, label AS theme_id FROM embeddings), b AS (SELECT vec_id AS member, CASE WHEN vec_id % 3 = 0 THEN label + 1 ELSE label END AS other FROM embeddings),
m AS (SELECT theme_id, other, count(*) AS c FROM a JOIN b USING (member) GROUP BY 1, 2), na AS (SELECT theme_id, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT other, count(*) AS nb FROM b GROUP BY 1),
s AS (SELECT *, round(c / (na + nb - c)::DOUBLE, 6) AS jaccard FROM m JOIN na USING (theme_id) JOIN nb USING (other))
SELECT theme_id, other, jaccard, na - c AS missing, nb - c AS gained, jaccard >= 0.6 AS agrees FROM s QUALIFY row_number() OVER (PARTITION BY theme_id ORDER BY jaccard DESC, other) = 1""")
def second_pass_jaccard(spark, sf):
    first = read(spark, sf, "embeddings").select(F.col("vec_id").alias("member"), F.col("label").alias("theme_id"))
    moved = first.withColumn("theme_id", F.when(F.col("member") % 3 == 0, F.col("theme_id") + 1).otherwise(F.col("theme_id")))
    return vectors.second_pass(first, moved)


@query("""WITH n AS (SELECT item_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: true)) AS w FROM benchmark), e AS (SELECT id, len(w) AS n, unnest(w) AS word FROM n),
m AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM e x JOIN e y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2, 3, 4)
SELECT a, b, round(c / (na + nb - c)::DOUBLE, 6) AS jaccard FROM m WHERE round(c / (na + nb - c)::DOUBLE, 6) >= 0.05 ORDER BY jaccard DESC, a, b LIMIT 15""")
def jaccard_names(spark, sf):
    return vectors.name_jaccard(read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("name")), 0.05)


_V = "((vec_id * 7) % 21 - 10) / 10.0::DOUBLE"


@query(f"""WITH {_U}, c AS (SELECT vec_id AS id, label AS theme_id, vec_id % 20 AS participant, {_V} AS valence, u FROM u),
p AS (SELECT a.id AS i, b.id AS j, a.theme_id, round(abs(a.valence - b.valence), 6) AS gap, list_dot_product(a.u, b.u) AS sim, a.participant <> b.participant AS far FROM c a JOIN c b ON a.theme_id = b.theme_id AND a.id < b.id)
SELECT i, j, theme_id, gap, round(least(1.0, 1.6 * sim * gap / 2 * CASE WHEN far THEN 1.25 ELSE 0.85 END * 2.2), 6) AS severity FROM p WHERE gap >= 0.85 AND sim >= 0.27 ORDER BY severity DESC, i, j LIMIT 60""")
def contradiction_pairs(spark, sf):
    rows = _unit(spark, sf)
    codes = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("theme_id"), (F.col("vec_id") % 20).alias("participant"), (((F.col("vec_id") * 7) % 21 - 10) / 10.0).alias("valence"))
    return vectors.contradictions(codes, vectors.dense_edges(rows.withColumn("within", F.col("label")), 0.27))


@query(f"""WITH {_CENT}, s AS (SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 6) AS sim FROM cn a JOIN cn b ON a.k = b.k AND a.label < b.label GROUP BY 1, 2),
m AS (SELECT label AS theme_id, round((label * 7 % 11 - 5) / 5.0::DOUBLE, 6) AS mean FROM embeddings GROUP BY 1)
SELECT a, b, round(abs(x.mean - y.mean), 6) AS gap, round(least(1.0, 1.9 * sim * round(abs(x.mean - y.mean), 6)), 6) AS severity FROM s JOIN m x ON a = x.theme_id JOIN m y ON b = y.theme_id WHERE sim >= 0.02 AND round(abs(x.mean - y.mean), 6) >= 0.55""")
def opposed_themes(spark, sf):
    rows = _unit(spark, sf)
    means = rows.select(F.col("label").alias("theme_id")).distinct().withColumn("mean", F.round((F.col("theme_id") * 7 % 11 - 5) / 5.0, 6))
    return vectors.opposed_themes(vectors.centroid_similarity(vectors.centroids(rows, "label"), "label"), means, 0.02)


@query(None)
def located_units(spark, sf):
    """Units of conversations with their places, of which text[start:end] is the unit."""
    docs = read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("document_id"), tx.normalise(F.col("text")).alias("body"))
    turns = docs.select("document_id", F.lit(0).alias("turn_idx"), F.col("body").alias("text"))
    return corpus.locate(corpus.units(turns), docs).select("document_id", "turn_idx", "idx", "char_start", "char_end")


typed(ORACLE, {name: {"rank": "INTEGER"} for name in ("turning_points", "exemplars", "top_terms", "term_cooccurrence")})
