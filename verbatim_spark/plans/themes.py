"""Queries of theme operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews as rv
from ..operators import themes, vectors
from .readings import _C, _CENT, _U, _codes, _unit
from .reviews import _BAD, _KPI
from .reviews import _C as _REVIEW_CODES
from .reviews import _codes as _review_codes
from .reviews import _reviews
from .views import APPS, applications, read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_BOTTLE = f"""bt AS (SELECT theme_id, round(least(1.0, abs(avg(valence)) * 0.55 + count(DISTINCT reviewer) / (SELECT count(*) FROM r)::DOUBLE * 0.9 + least(sum(friction) / count(*)::DOUBLE, 2.0) * 0.12), 6) AS severity FROM codes WHERE {_BAD} GROUP BY 1)"""
_KPIS = f"k AS (SELECT business, {_KPI} FROM r GROUP BY 1)"
_SIM = f"{_CENT}, sim AS (SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 6) AS sim FROM cn a JOIN cn b ON a.k = b.k AND a.label < b.label GROUP BY 1, 2)"


def _similar(spark, sf):
    return vectors.centroid_similarity(vectors.centroids(_unit(spark, sf), "label"), "label")


@query(f"WITH {_SIM} SELECT * FROM sim WHERE sim >= 0.05")
def thematic_map(spark, sf):
    return themes.map_edges(_similar(spark, sf), 0.1)


#: The first terms of a theme are the strongest coordinates of its centroid.
_TERMS = f"""t AS (SELECT label AS theme_id, k AS term FROM cn QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(x, 6) DESC, k) <= 8)"""


@query(f"""WITH {_SIM}, {_TERMS},
sh AS (SELECT x.theme_id AS a, y.theme_id AS b, count(*) AS shared FROM t x JOIN t y ON x.term = y.term AND x.theme_id < y.theme_id GROUP BY 1, 2),
m AS (SELECT a, b, coalesce(sim, 0) AS sim, coalesce(shared, 0) AS shared FROM sim FULL JOIN sh USING (a, b))
SELECT * FROM m WHERE sim >= 0.062 OR shared >= 3 ORDER BY sim DESC, shared DESC, a, b LIMIT 12""")
def merge_suggestions(spark, sf):
    centers = vectors.centroids(_unit(spark, sf), "label").select(F.col("label").alias("doc"), F.col("k").alias("term"), F.col("x").alias("weight"))
    terms = vectors.top_terms(centers, 8).select(F.col("doc").alias("theme_id"), "term")
    return themes.merge_suggestions(_similar(spark, sf), terms, 0.1)


@query(f"WITH {_SIM} SELECT * FROM sim WHERE a < 6 AND b < 6 AND sim >= 0.02 ORDER BY sim DESC, a, b LIMIT 8")
def constant_comparison(spark, sf):
    order = read(spark, sf, "embeddings").select(F.col("label").alias("theme_id"), F.col("label").alias("ord")).distinct()
    return themes.constant_comparison(_similar(spark, sf), order, least=0.02)


#: A theme per size and type, a member's words those of its part's name, with idf over
#: parts; pairs of words are the names themselves.
_NAMED = f"""{_C}, w AS (SELECT theme_id, ord AS member, unnest(string_split(lower(p_name), ' ')) AS word, lower(p_name) AS phrase FROM c JOIN part ON l_partkey = p_partkey),
idf AS (SELECT word, ln(((SELECT count(*) FROM part) + 1) / (count(DISTINCT p_partkey) + 0.5::DOUBLE)) + 1 AS idf FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY 1)"""


@query(f"""WITH {_NAMED}, k AS (SELECT theme_id, word, count(*) AS c FROM w GROUP BY 1, 2), n AS (SELECT theme_id, count(DISTINCT member) AS size FROM w GROUP BY 1),
s AS (SELECT theme_id, word, round(c / size::DOUBLE / (1 / idf + 0.02) * (1 + 0.5 * (c - 1)), 6) AS salience FROM k JOIN n USING (theme_id) JOIN idf USING (word)),
b AS (SELECT theme_id, arg_max(word, (salience, word)) AS word FROM s GROUP BY 1), ph AS (SELECT theme_id, phrase, count(DISTINCT member) AS n FROM w GROUP BY 1, 2),
t AS (SELECT theme_id, arg_max(phrase, (n, phrase)) AS phrase FROM ph JOIN b USING (theme_id) WHERE list_contains(string_split(phrase, ' '), word) GROUP BY 1),
x AS (SELECT theme_id, array_to_string(list_transform(string_split(coalesce(phrase, word), ' '), lambda q: upper(q[1]) || q[2:]), ' ') AS name FROM b LEFT JOIN t USING (theme_id))
SELECT theme_id, name || CASE WHEN row_number() OVER (PARTITION BY lower(name) ORDER BY theme_id) > 1 THEN ' (' || row_number() OVER (PARTITION BY lower(name) ORDER BY theme_id) || ')' ELSE '' END AS name FROM x""")
def theme_names(spark, sf):
    part = read(spark, sf, "part")
    split = lambda df: F.split(F.lower(df["p_name"]), " ")
    codes = _codes(spark, sf).select("theme_id", "ord", "l_partkey").join(part, F.col("l_partkey") == part["p_partkey"])
    words = codes.select("theme_id", F.col("ord").alias("member"), F.explode(split(part)).alias("word"))
    terms = part.select(F.col("p_partkey").alias("doc"), F.explode(split(part)).alias("term"))
    idf = vectors.idf_table(terms, part.agg(F.count("*").alias("n"))).select(F.col("term").alias("word"), "idf")
    return themes.name_themes(words, idf, codes.select("theme_id", F.lower("p_name").alias("phrase")))


@query(f"""WITH {_C}, m AS (SELECT theme_id, mood, count(*) AS k FROM c GROUP BY 1, 2), b AS (SELECT theme_id, arg_max(mood, (k, mood)) AS mood, max(k) AS most, sum(k) AS n FROM m GROUP BY 1),
p AS (SELECT theme_id, code_id, count(*) AS k FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY k DESC, code_id) AS rk FROM p),
l AS (SELECT theme_id, string_agg(code_id, ', ' ORDER BY rk) AS phrases FROM r WHERE rk <= 4 GROUP BY 1), q AS (SELECT theme_id, count(DISTINCT participant) AS participants FROM c GROUP BY 1),
i AS (SELECT theme_id, arg_max(created_by, (k, created_by)) AS intent FROM (SELECT theme_id, created_by, count(*) AS k FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT theme_id, CASE WHEN most >= 0.25 * n THEN mood END AS mood, intent, phrases, participants, participants <= 2 AS narrow FROM b JOIN l USING (theme_id) JOIN q USING (theme_id) JOIN i USING (theme_id)""")
def theme_descriptions(spark, sf):
    return themes.describe(_codes(spark, sf).withColumns({"phrase": F.col("code_id"), "intent": F.col("created_by")}))


_IPA = {"one": ["the", "thing"], "two": ["with", "ation"], "three": ["whi"]}
_case = lambda n: f"({' + '.join(f'CAST(contains(lower(text), {c!r}) AS INTEGER)' for c in _IPA[n])})"


@query(f"""WITH s AS (SELECT doc_id, unnest([{", ".join(f"{{'h': {_case(n)}, 'n': '{n}'}}" for n in _IPA)}]) AS x FROM documents)
SELECT doc_id, coalesce(string_agg(x.n, ',' ORDER BY x.h DESC, x.n DESC) FILTER (x.h > 0), '') AS dimensions FROM s GROUP BY 1""")
def experiential_dimensions(spark, sf):
    found = themes.experiential_dimensions(F.col("text"), _IPA)
    return read(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("dimensions"))


def leaders_sql(order: str, edges: str) -> str:
    """Leader clustering in SQL: nodes of ``order`` (id, k: place from 1) one after the
    other, each joining its earliest leading neighbour of ``edges`` (i, j) or leading."""
    return f"""nb AS (SELECT o.k, o.id, list_sort(list_filter(list(CASE WHEN e.k < o.k THEN e.k END), lambda x: x IS NOT NULL)) AS near FROM {order} o
 LEFT JOIN (SELECT a.k AS me, b.k FROM (SELECT i, j FROM {edges} UNION ALL SELECT j, i FROM {edges}) x(p, q) JOIN {order} a ON a.id = x.p JOIN {order} b ON b.id = x.q) e ON e.me = o.k GROUP BY 1, 2),
walk(k, leads, leader) AS (SELECT 0, CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) UNION ALL
 SELECT n.k, CASE WHEN f IS NULL THEN list_append(leads, n.k) ELSE leads END, coalesce(f, n.k) FROM (SELECT w.k + 1 AS k, w.leads, n.near, list_filter(n.near, lambda x: list_contains(w.leads, x))[1] AS f FROM walk w JOIN nb n ON n.k = w.k + 1) n),
led AS (SELECT a.id, b.id AS leader FROM walk w JOIN {order} a ON a.k = w.k JOIN {order} b ON b.k = w.leader)"""


_PAIRS = "SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.u, b.u) >= {0}"


@query(f"WITH RECURSIVE {_U}, e AS ({_PAIRS.format(0.28)}), o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS k FROM u), {leaders_sql('o', 'e')} SELECT id, leader FROM led")
def leader_clusters(spark, sf):
    rows = _unit(spark, sf)
    return vectors.leader_clusters(rows.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord")), vectors.dense_edges(rows, 0.28))


@query(f"""WITH RECURSIVE {_SIM}, e AS (SELECT a AS i, b AS j FROM sim WHERE sim >= 0.14), cov AS (SELECT label AS id, count(*) / 1000.0::DOUBLE AS coverage FROM embeddings GROUP BY 1),
o AS (SELECT id, row_number() OVER (ORDER BY coverage DESC, id) AS k FROM cov), {leaders_sql('o', 'e')}
SELECT leader AS category, count(*) AS themes, round(sum(coverage), 6) AS centrality FROM led JOIN cov USING (id) GROUP BY 1""")
def axial_categories(spark, sf):
    rows = read(spark, sf, "embeddings")
    coverage = rows.groupBy(F.col("label").alias("theme_id")).agg((F.count("*") / 1000).alias("coverage"))
    return themes.axial(_similar(spark, sf), coverage, 0.1)


@query(f"""WITH RECURSIVE {_U}, e AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id < b.vec_id AND a.label = b.label WHERE list_dot_product(a.u, b.u) >= 0.2),
o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS k FROM u), {leaders_sql('o', 'e')},
s AS (SELECT u.label AS theme_id, leader AS subtheme, count(*) AS size FROM led JOIN u ON u.vec_id = led.id GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, count(*) OVER (PARTITION BY theme_id) AS groups, row_number() OVER (PARTITION BY theme_id ORDER BY size DESC, subtheme) AS rank FROM s)
SELECT theme_id, subtheme, size, CAST(rank AS INTEGER) AS rank FROM r WHERE groups >= 2 AND rank <= 5""")
def subthemes(spark, sf):
    rows = _unit(spark, sf)
    members = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("theme_id"), F.col("vec_id").alias("ord"))
    return themes.subthemes(members, vectors.dense_edges(rows.withColumn("within", F.col("label")), 0.2))


@query(f"""WITH RECURSIVE {APPS}, p AS (SELECT DISTINCT quotation_id AS doc, code_id AS term FROM apps), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
m AS (SELECT x.term AS a, y.term AS b, count(*) AS c FROM p x JOIN p y ON x.doc = y.doc AND x.term <> y.term GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT a, b, round(c / sqrt(da.df * db.df), 6) AS strength FROM m JOIN d da ON a = da.term JOIN d db ON b = db.term QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c / sqrt(da.df * db.df), 6) DESC, b) <= 4),
v AS (SELECT a AS doc, b AS term, strength / sqrt(sum(strength * strength) OVER (PARTITION BY a)) AS w FROM s),
e AS (SELECT x.doc AS i, y.doc AS j FROM v x JOIN v y ON x.term = y.term AND x.doc < y.doc GROUP BY 1, 2 HAVING sum(x.w * y.w) >= 0.18),
o AS (SELECT term AS id, row_number() OVER (ORDER BY df DESC, term) AS k FROM d), {leaders_sql('o', 'e')} SELECT id AS term, leader AS concept FROM led""")
def concept_space(spark, sf):
    pairs = applications(spark, sf).select(F.col("quotation_id").alias("doc"), F.col("code_id").alias("term")).distinct()
    strength = pairs.groupBy("term").agg(F.count("*").cast("double").alias("strength"))
    return vectors.concept_space(vectors.co_occurrence(pairs), strength)


@query(f"""WITH {_REVIEW_CODES}, {_BOTTLE}, {_KPIS},
cc AS (SELECT code_id AS category, count(*) AS mentions, round(avg(valence), 6) AS mv FROM codes GROUP BY 1 HAVING count(*) >= 2),
f AS ((SELECT 1 AS ord, 'bottleneck' AS kind, theme_id AS subject, severity AS value FROM bt ORDER BY severity DESC, theme_id LIMIT 1)
UNION ALL (SELECT 2, 'weakness', category, mv FROM cc WHERE mv <= -0.15 ORDER BY mv, category LIMIT 1) UNION ALL (SELECT 3, 'strength', category, mv FROM cc WHERE mv >= 0.15 ORDER BY mv DESC, category LIMIT 1)
UNION ALL (SELECT 4, 'rating gap', 'reviews', count(*) FROM r WHERE rating >= 4 AND v <= -4 OR rating <= 2 AND v >= 4 HAVING count(*) > 0)
UNION ALL (SELECT 5, 'few responses', business, response_rate FROM k WHERE response_rate < 0.3))
SELECT CAST(ord AS INTEGER) AS ord, kind, subject, CAST(value AS DOUBLE) AS value FROM f ORDER BY ord, subject LIMIT 6""")
def key_findings(spark, sf):
    codes, rows = _review_codes(spark, sf), _reviews(spark, sf)
    worst = rv.bottlenecks(codes, "theme_id", rows).withColumnRenamed("theme_id", "category")
    counts = codes.groupBy(F.col("code_id").alias("category")).agg(F.count("*").alias("mentions"), F.round(F.avg("valence"), 6).alias("mean_valence"))
    return themes.key_findings(worst, counts, rv.rating_vs_text(rows), rv.kpis(rows))
