"""Queries of methodology parts, workbench edits and ingest, and their DuckDB
counterparts. Documents are codes here: the source is the participant, valence,
mood, confidence and theme come from the id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators import coding, corpus, methods, prose, readings, themes, vectors
from ..operators import workbench as wb
from ..sources import reviews as ingest
from .corpus import _W, _STEMS, LEXICON, STOP
from .corpus import _HITS
from .readings import _D, _SHAPE, _by_document
from .readings import _vectors as _turn_vectors
from .readings import _TF
from .views import APPS, applications, read, typed

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_DOC = """dc AS (SELECT doc_id AS id, source AS participant, doc_id AS ord, coalesce(text, '') AS text, ((doc_id * 7) % 21 - 10) / 10.0::DOUBLE AS valence,
 0.5::DOUBLE + (doc_id % 5) / 10.0::DOUBLE AS confidence, CASE doc_id % 3 WHEN 0 THEN 'glad' WHEN 1 THEN 'sad' ELSE 'neutral' END AS mood, doc_id % 7 AS theme_id, lang AS label FROM documents)"""
_TOK = "regexp_extract_all(lower(text), '[a-z][a-z''’-]*')"


def _coded(spark, sf):
    i = F.col("doc_id")
    return read(spark, sf, "documents").select(
        i.alias("id"), F.col("source").alias("participant"), i.alias("ord"), F.coalesce("text", F.lit("")).alias("text"), ((i * 7 % 21 - 10) / 10.0).alias("valence"), (F.lit(0.5) + i % 5 / 10.0).alias("confidence"),
        F.when(i % 3 == 0, "glad").when(i % 3 == 1, "sad").otherwise("neutral").alias("mood"), (i % 7).alias("theme_id"), F.col("lang").alias("label"),
    ).withColumn("stems", tx.tokens(F.col("text")))


def _cut(limit: int, text: str = "text") -> str:
    t = f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN length({t}) <= {limit} THEN {t} ELSE regexp_replace(substr({t}, 1, {limit}), ' [^ ]*$', '') || '…' END"


_INDEX = f"ix AS (SELECT dc.*, category, hits AS score FROM dc, LATERAL (SELECT * FROM (VALUES {_HITS}) t(category, hits, o)) WHERE hits > 0)"


@query(f"WITH {_DOC}, {_INDEX} SELECT id, category, score FROM ix")
def framework_index(spark, sf):
    return methods.index(_coded(spark, sf), LEXICON).select("id", "category", "score")


SCHEME = {"near": ["that", "from"], "with": ["with", "und"], "what": ["que", "dans", "not here"]}
_SCHEME = ", ".join(
    f"('{n}', {' + '.join(f'''CAST(contains(' ' || lower(text) || ' ', ' {t} ') OR list_contains({_TOK}, '{t}') AS INTEGER)''' for t in terms)})" for n, terms in SCHEME.items()
).replace("list_contains(" + _TOK + ", 'dans')", "list_contains(" + _TOK + ", 'dan')")
_CONTENT = f"cx AS (SELECT dc.*, category, score FROM dc, LATERAL (SELECT * FROM (VALUES {_SCHEME}) t(category, score)) WHERE score > 0)"


@query(f"""WITH {_DOC}, {_CONTENT} SELECT participant, category, sum(score)::BIGINT AS hits, count(*) AS codes, arg_min({_cut(180)}, (ord, text)) AS example FROM cx GROUP BY CUBE (participant, category)""")
def content_matrix(spark, sf):
    return methods.content_matrix(methods.content_index(_coded(spark, sf), SCHEME))


@query(f"""WITH {_DOC}, {_CONTENT}, m AS (SELECT category, mood, count(*) AS k FROM cx WHERE mood <> 'neutral' GROUP BY 1, 2), t AS (SELECT category, arg_max(mood, (k, mood)) AS mood FROM m GROUP BY 1)
SELECT category, sum(score)::BIGINT AS hits, round(sum(score) / (SELECT sum(score) FROM cx)::DOUBLE, 4) AS share, count(DISTINCT participant) AS spread, round(avg(valence), 6) AS mean_valence,
coalesce(any_value(t.mood), 'no marked affect') AS mood FROM cx LEFT JOIN t USING (category) GROUP BY 1""")
def content_latent(spark, sf):
    return methods.latent_layer(methods.content_index(_coded(spark, sf), SCHEME))


_WORDS = f"""{_W}, {_STEMS}, df AS (SELECT stem, count(DISTINCT doc_id) AS df FROM wc JOIN stems USING (word) GROUP BY 1), b AS (SELECT word, stem, sum(n)::BIGINT AS n FROM wc JOIN stems USING (word) GROUP BY 1, 2),
wf AS (SELECT word, stem, n, df, round(n * (ln(((SELECT count(*) FROM docs) + 1) / (df + 0.5::DOUBLE)) + 1), 4) AS weight FROM b JOIN df USING (stem) ORDER BY n DESC, word LIMIT 200)"""


def _frequent(spark, sf):
    return corpus.word_frequency(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", STOP, 200)


@query(f"WITH {_WORDS} SELECT * FROM wf ORDER BY weight DESC, word LIMIT 30")
def manifest_terms(spark, sf):
    return methods.manifest_terms(_frequent(spark, sf))


@query(f"""WITH {_WORDS}, top AS (SELECT word AS term FROM wf ORDER BY weight DESC, word LIMIT 8), w AS (SELECT doc_id AS id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM docs),
a AS (SELECT w.*, term, list_position(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z''’-]', '', 'g')), term) AS i FROM w, top), k AS (SELECT * FROM a WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY term ORDER BY id) <= 6)
SELECT term, id, coalesce(array_to_string(w[greatest(i - 7, 1):i - 1], ' '), '') AS before, w[i] AS hit, coalesce(array_to_string(w[i + 1:i + 7], ' '), '') AS after, row_number() OVER (PARTITION BY term ORDER BY id) AS line FROM k""")
def key_lines(spark, sf):
    return methods.key_lines(read(spark, sf, "documents"), _frequent(spark, sf), "doc_id")


@query(f"""WITH {_DOC} SELECT participant, ord, {_cut(90)} AS phrase FROM dc WHERE len(regexp_extract_all(text, '\\S+')) BETWEEN 4 AND 12 AND confidence > 0.6 ORDER BY ord, participant, text LIMIT 10""")
def in_vivo(spark, sf):
    return methods.in_vivo(_coded(spark, sf))


@query(f"""WITH {_DOC}, {_INDEX}, r AS (SELECT theme_id, category AS slot, {_cut(200)} AS quote, row_number() OVER (PARTITION BY theme_id, category ORDER BY round(score * confidence, 6) DESC, ord, text) AS rk FROM ix)
SELECT theme_id, slot, count(*) AS n, array_to_string(list(quote ORDER BY rk) FILTER (rk <= 3), ' | ') AS evidence FROM r GROUP BY 1, 2""")
def paradigm_evidence(spark, sf):
    return methods.paradigm(_coded(spark, sf), LEXICON, "theme_id").withColumn("evidence", F.array_join("evidence", " | "))


_IPA = {"one": ["the", "thing"], "two": ["with", "ation"], "three": ["whi"]}
_case = lambda n: f"({' + '.join(f'CAST(contains(lower(text), {c!r}) AS INTEGER)' for c in _IPA[n])})"
_DIMS = f"""dm AS (SELECT *, list_transform(list_reverse_sort(list_filter([{", ".join(f"{{'h': {_case(n)}, 'n': '{n}'}}" for n in _IPA)}], lambda x: x.h > 0)), lambda x: x.n) AS dims FROM dc)"""
_HEDGED, _NEGATED, _STRONG = ["may", "soll"], ["not", "nicht", "pas"], ["very", "sehr"]
_has = lambda ws: f"list_has_any(string_split_regex(lower(text), '\\s+'), [{', '.join(repr(w) for w in ws)}])"
_NOTE = f"""coalesce(nullif(array_to_string(list_filter([CASE WHEN {_has(_HEDGED)} THEN 'hedged' END, CASE WHEN {_has(_NEGATED)} THEN 'negated' END, CASE WHEN {_has(_STRONG)} THEN 'emphatic' END,
CASE WHEN len(regexp_extract_all(text, ',')) >= 3 THEN 'accumulating' END, CASE WHEN {_has(["i"])} AND {_has(["they"])} THEN 'self against others' END], lambda x: x IS NOT NULL), ', '), ''), 'plain')"""


def _dims():
    return themes.experiential_dimensions(F.col("text"), _IPA)


@query(f"""WITH {_DOC}, {_DIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY confidence DESC, ord, text) AS rank FROM dm)
SELECT participant, CAST(rank AS INTEGER) AS rank, {_cut(300)} AS quote, coalesce(dims[1], 'experiential') AS dimension, {_NOTE} AS note, confidence FROM r WHERE rank <= 8""")
def experiential_statements(spark, sf):
    note = themes.linguistic_note(F.col("text"), _HEDGED, _NEGATED, _STRONG)
    return methods.statements(_coded(spark, sf), F.coalesce(F.get(_dims(), F.lit(0)), F.lit("experiential")), note)


@query(f"""WITH {_DOC}, {_DIMS}, e AS (SELECT participant, unnest(dims) AS dimension FROM dm) SELECT dimension, participant, count(*) AS n FROM e GROUP BY ROLLUP (dimension, participant) HAVING dimension IS NOT NULL""")
def dimension_profile(spark, sf):
    return methods.dimension_profile(_coded(spark, sf), _dims())


@query(f"""WITH {_DOC}, {_DIMS}, f AS (SELECT participant, count(*) AS n, round(avg(valence), 2) AS mean_valence FROM dc GROUP BY 1),
m AS (SELECT participant, arg_max(mood, (k, mood)) AS mood FROM (SELECT participant, mood, count(*) AS k FROM dc WHERE mood <> 'neutral' GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT participant, arg_max(dimension, (k, dimension)) AS dimension FROM (SELECT participant, dimension, count(*) AS k FROM (SELECT participant, unnest(dims) AS dimension FROM dm) GROUP BY 1, 2) GROUP BY 1)
SELECT f.*, coalesce(mood, 'an unmarked register') AS mood, coalesce(dimension, 'experiential') AS dimension FROM f LEFT JOIN m USING (participant) LEFT JOIN d USING (participant)""")
def case_summaries(spark, sf):
    return methods.case_summary(_coded(spark, sf), _dims())


_ACT, _PAS = ["the", "of"], ["and"]
_hit = lambda c: f"CAST(regexp_matches(lower(text), '(^|[^a-z]){c}([^a-z]|$)') AS INTEGER)"


@query(f"""WITH {_SHAPE}, s AS (SELECT CASE WHEN n < 3 THEN 'fragment' WHEN b < a - 0.25 AND c > b + 0.25 THEN 'redemptive' WHEN b > a + 0.25 AND c < b - 0.25 THEN 'contaminative'
 WHEN slope > 0.02 THEN 'progressive' WHEN slope < -0.02 THEN 'regressive' ELSE 'stable' END AS shape FROM f), {_DOC},
g AS (SELECT participant, sum({" + ".join(map(_hit, _ACT))}) AS a, sum({" + ".join(map(_hit, _PAS))}) AS p FROM dc GROUP BY 1),
d AS (SELECT participant, round(valence - lag(valence) OVER (PARTITION BY participant ORDER BY ord), 6) AS delta, ord FROM cd), t AS (SELECT * FROM d WHERE abs(delta) >= 0.7 QUALIFY row_number() OVER (PARTITION BY participant ORDER BY abs(delta) DESC, ord) <= 4)
SELECT 'plot' AS kind, shape AS name, count(*)::DOUBLE AS value FROM s GROUP BY 2 UNION ALL
SELECT 'agency', 'mean ratio', round(avg(CASE WHEN a + p = 0 THEN 0.5 ELSE round(a / (a + p)::DOUBLE, 6) END), 6) FROM g UNION ALL
SELECT 'turns', CASE WHEN delta > 0 THEN 'upturn' ELSE 'downturn' END, count(*)::DOUBLE FROM t GROUP BY 2""")
def narrative_cross(spark, sf):
    stories = _by_document(spark, sf)
    agency = readings.agency(methods.agency_counts(_coded(spark, sf), _ACT, _PAS))
    return methods.narrative_cross(readings.plot_shape(stories), agency, readings.turning_points(stories))


_MARKS = ["the", "from", "what", "then", "dann", "puis"]


@query(f"""WITH {_DOC}, c AS (SELECT participant, m AS marker, count(*) AS n FROM dc, (SELECT unnest({_MARKS}) AS m) WHERE contains(' ' || lower(text) || ' ', ' ' || m || ' ') GROUP BY 1, 2)
SELECT participant, marker, n, CAST(row_number() OVER (PARTITION BY participant ORDER BY n DESC, marker) AS INTEGER) AS rank FROM c QUALIFY rank <= 8""")
def case_temporal_markers(spark, sf):
    return methods.temporal_markers(_coded(spark, sf), _MARKS)


@query(f"""WITH {_D}, s AS (SELECT document_id AS theme_id, count(*) FILTER (v < -4) AS negative_cases, count(DISTINCT l_suppkey) AS participants, (document_id % 10) / 20.0::DOUBLE AS cohesion FROM cd GROUP BY 1),
p AS (SELECT theme_id, count(*) AS parts FROM (SELECT DISTINCT document_id AS theme_id, code_id FROM cd WHERE tax = 8) GROUP BY 1), x AS (SELECT s.*, coalesce(parts, 0) AS parts FROM s LEFT JOIN p USING (theme_id))
SELECT theme_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN parts >= 2 THEN 'splits into ' || parts END, CASE WHEN negative_cases > 0 THEN negative_cases || ' counter-cases' END, CASE WHEN participants <= 2 THEN 'few participants' END,
CASE WHEN cohesion < 0.25 THEN 'loose' END], lambda q: q IS NOT NULL), '; '), ''), 'stable') AS boundary FROM x""")
def theme_boundaries(spark, sf):
    codes = _by_document(spark, sf)
    summary = codes.groupBy(F.col("document_id").alias("theme_id")).agg(F.count_if(F.col("v") < -4).alias("negative_cases"), F.count_distinct("l_suppkey").alias("participants"))
    summary = summary.withColumn("cohesion", F.col("theme_id") % 10 / 20.0)
    parts = codes.where("tax = 8").select(F.col("document_id").alias("theme_id"), "code_id").distinct()
    return methods.boundaries(summary, parts)


@query("""SELECT 'documents' AS step, count(*) AS n FROM documents UNION ALL SELECT 'turns', count(*) FROM conversations UNION ALL SELECT 'codes', count(*) FROM lineitem""")
def analysis_phases(spark, sf):
    return methods.phases({"documents": read(spark, sf, "documents"), "turns": read(spark, sf, "conversations"), "codes": read(spark, sf, "lineitem")})


@query(f"""WITH {_DOC} SELECT 'count' AS kind, 'codes' AS name, count(*)::DOUBLE AS value FROM dc UNION ALL SELECT 'count', 'reviewers', count(DISTINCT participant)::DOUBLE FROM dc UNION ALL SELECT 'mean', 'confidence', round(avg(confidence), 3) FROM dc
UNION ALL SELECT 'mood', mood, k::DOUBLE FROM (SELECT mood, count(*) AS k FROM dc GROUP BY 1 ORDER BY k DESC, mood LIMIT 8)""")
def codes_summary(spark, sf):
    return themes.codes_summary(_coded(spark, sf).withColumn("reviewer", F.col("participant")))


@query(f"""WITH {_DOC}, l AS (SELECT unnest(['fixed', 'also fixed']) AS category, unnest([['the', 'of'], ['and']]) AS terms) SELECT id, category, len(list_intersect(list_distinct({_TOK}), terms))::INTEGER AS score FROM dc, l WHERE list_has_any({_TOK}, terms)""")
def emergent_index(spark, sf):
    terms = spark.createDataFrame([("fixed", ["the", "of"]), ("also fixed", ["and"])], "category string, terms array<string>")
    return methods.index_emergent(_coded(spark, sf), terms).select("id", "category", "score")


@query(f"""WITH {_TF}, v AS (SELECT x.doc AS i, y.doc AS j, sum(x.weight * y.weight) AS sim FROM vec x JOIN vec y ON x.term = y.term AND x.doc < y.doc GROUP BY 1, 2) SELECT i, j, round(sim, 6) AS sim FROM v WHERE sim >= 0.4""")
def sparse_similarity(spark, sf):
    return vectors.sparse_edges(_turn_vectors(spark, sf), 0.4).select("i", "j", F.round("sim", 6).alias("sim"))


#: Turns as codes: the role names them, place and length give mood and intent; the
#: concept of a term is its first letter.
_CV = f"""t AS (SELECT conv_id * 100 + turn AS doc, unnest(list_concat({_TOK}, [role, role], CASE WHEN turn % 3 = 0 THEN ['emo:glad', 'emo:glad'] ELSE [] END, ['int:' || turn % 2])) AS term FROM conversations),
tt AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY 1, 2), base AS (SELECT doc, term, count(*) AS tf FROM (SELECT conv_id * 100 + turn AS doc, unnest({_TOK}) AS term FROM conversations) GROUP BY 1, 2),
idf AS (SELECT term, ln(((SELECT count(*) FROM conversations) + 1) / (count(*) + 0.5::DOUBLE)) + 1 AS idf FROM base GROUP BY 1),
own AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM (SELECT doc, term, tf / sum(tf) OVER (PARTITION BY doc) * coalesce(idf, 1.0) AS w FROM tt LEFT JOIN idf USING (term))),
cc AS (SELECT doc, CASE WHEN term IN (SELECT term FROM idf) AND length(term) > 3 THEN 'c:' || term[1] ELSE term END AS term, sum(tf) AS tf FROM tt GROUP BY 1, 2),
con AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM (SELECT doc, term, tf / sum(tf) OVER (PARTITION BY doc) * coalesce(idf, 1.0) AS w FROM cc LEFT JOIN idf USING (term))),
b AS (SELECT doc, 'k:' || term AS term, 0.55 * w AS w FROM con UNION ALL SELECT doc, term, 0.45 * w FROM own), bl AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM b),
rel AS (SELECT 'the' AS a, 'of' AS b, 0.5 AS s UNION ALL SELECT 'the', 'and', 0.25), ex AS (SELECT doc, term, sum(w) AS w FROM (SELECT doc, term, w FROM bl UNION ALL SELECT doc, b, w * s * 0.45 FROM bl JOIN rel ON term = a) GROUP BY 1, 2)"""


@query(f"WITH {_CV} SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM ex")
def code_vectors(spark, sf):
    turns = read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", "turn", tx.tokens(F.col("text")).alias("stems"))
    codes = turns.select("id", "stems", F.col("role").alias("phrase"), F.when(F.col("turn") % 3 == 0, "glad").otherwise("neutral").alias("mood"), (F.col("turn") % 2).cast("string").alias("intent"))
    idf = vectors.idf_table(turns.select(F.col("id").alias("doc"), F.explode("stems").alias("term")), turns.agg(F.count("*").alias("n")))
    concepts = idf.where(F.length("term") > 3).select("term", F.concat(F.lit("c:"), F.substring("term", 1, 1)).alias("concept"))
    related = spark.createDataFrame([("the", "of", 0.5), ("the", "and", 0.25)], "a string, b string, strength double")
    return vectors.code_vectors(vectors.code_terms(codes), idf, concepts, related).select("doc", "term", F.round("weight", 6).alias("weight"))


@query("""WITH s AS (SELECT doc_id, text, instr(text, ' ') AS p FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, text, p + 1 AS a, least(p + 6, length(text)) AS z FROM s WHERE p > 0)
SELECT doc_id, trim(regexp_extract(substr(text, 1, a), '([^.\\n?!]*)$', 1) || substr(text, a + 1, z - a) || regexp_extract(substr(text, z + 1), '^([^.\\n?!]*[.\\n?!]?)', 1), ' ') AS sentence FROM x""")
def expanded_sentences(spark, sf):
    docs = read(spark, sf, "documents").where("text IS NOT NULL").withColumn("p", F.instr("text", " ")).where("p > 0")
    start, end = F.col("p") + 1, F.least(F.col("p") + 6, F.length("text"))
    return docs.select("doc_id", tx.expand_to_sentence(F.col("text"), start, end).alias("sentence"))


#: Parts as phrases: their names, coded with the size's mood.
_PH = """c AS (SELECT p_partkey AS id, lower(p_name) AS phrase, CASE WHEN p_size % 2 = 0 THEN 'hope' ELSE 'neutral' END AS emotion, 'describing' AS intent, p_type AS concept FROM part),
ph AS (SELECT concept, phrase, count(*) AS n FROM c GROUP BY 1, 2), w AS (SELECT concept, word, sum(n) AS n FROM (SELECT concept, n, unnest(string_split(phrase, ' ')) AS word FROM ph) WHERE word NOT IN (GENERAL) GROUP BY 1, 2),
b AS (SELECT concept, arg_max(word, (round(pow(n, 1.5), 9), word)) AS word FROM w GROUP BY 1),
pr AS (SELECT concept, arg_max(phrase, (n, phrase)) AS pair FROM ph JOIN b USING (concept) WHERE len(string_split(phrase, ' ')) = 2 AND n > 1 AND list_contains(string_split(phrase, ' '), word) GROUP BY 1)""".replace("GENERAL", ", ".join("'" + w + "'" for w in sorted({*lx.LOW_CONTENT, *lx.VERBS})))


@query(f"""WITH {_PH} SELECT id, concept, CASE WHEN emotion = 'hope' THEN 'Hope for ' ELSE 'Description of ' END || coalesce(pair, word, phrase) AS label FROM c LEFT JOIN b USING (concept) LEFT JOIN pr USING (concept)""")
def consolidated_labels(spark, sf):
    part = read(spark, sf, "part")
    codes = part.select(
        F.col("p_partkey").alias("id"), F.lower("p_name").alias("phrase"), F.when(F.col("p_size") % 2 == 0, "hope").otherwise("neutral").alias("emotion"), F.lit("describing").alias("intent"), F.lit("").alias("label"), "p_type"
    )
    # The concept is given as part of the phrase's last stem, so that it stands for the type.
    named = coding.consolidate(codes, spark.createDataFrame([], "stem string, idf double"), key=F.col("p_type"))
    return named.select("id", "concept", "label")


@query("""WITH e AS (SELECT *, event_id % 30 AS project_id FROM events), l AS (SELECT * FROM e ORDER BY ts DESC, event_id DESC LIMIT 1000)
SELECT coalesce(c_name, '') AS "user", coalesce(n_name, '') AS project, count(*) AS calls, round(sum(value), 4) AS cost, count(*) FILTER (value < 10) AS failures FROM l LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = project_id GROUP BY 1, 2""")
def usage_of_all(spark, sf):
    events = read(spark, sf, "events").withColumn("project_id", F.col("event_id") % 30)
    users = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user"))
    projects = read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("project_id"), F.col("n_name").alias("project"))
    return wb.usage_view(events, users, projects, viewer=0, owner=True)


@query("""SELECT p_partkey AS code_id, CASE WHEN p_partkey % 5 = 0 THEN 'renamed ' || p_partkey ELSE p_name END AS name FROM part""")
def renamed_codes(spark, sf):
    codes = read(spark, sf, "part").select(F.col("p_partkey").alias("code_id"), F.col("p_name").alias("name"))
    renames = codes.where("code_id % 5 = 0").select("code_id", F.concat(F.lit("renamed "), F.col("code_id").cast("string")).alias("new_name"))
    blank = codes.where("code_id % 5 = 1").select("code_id", F.lit("  ").alias("new_name"))
    return wb.rename_codes(codes, renames.unionByName(blank))


@query("""SELECT s_suppkey AS theme_id, CASE WHEN s_suppkey % 4 = 0 THEN 'New ' || s_suppkey ELSE s_name END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'rejected' ELSE 'candidate' END AS status FROM supplier""")
def edited_themes(spark, sf):
    rows = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("theme_id"), F.col("s_name").alias("name"), F.lit("candidate").alias("status"))
    i = F.col("theme_id")
    edits = rows.select(i, F.when(i % 4 == 0, F.concat(F.lit("New "), i.cast("string"))).alias("new_name"), F.when(i % 3 == 0, "rejected").when(i % 3 == 1, "unheard of").alias("new_status"))
    return wb.overlay_themes(rows, edits)


@query("SELECT c_nationkey AS project, coalesce(max(CASE WHEN c_nationkey > 3 THEN c_custkey END), 0) + 1 AS next_order FROM customer GROUP BY 1")
def next_theme_order(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_nationkey").alias("project"), F.when(F.col("c_nationkey") > 3, F.col("c_custkey")).alias("order_idx"))
    return wb.next_order(rows, "project")


@query("""SELECT event_id AS id, event_type AS kind, event_id % 2 = 1 AS flagged, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def projected_events(spark, sf):
    rows = read(spark, sf, "events").withColumn("odd", F.col("event_id") % 2)
    shown = wb.project(rows, {"event_id": "id", "event_type": "kind", "odd": "flagged", "props": "props"}, ["odd"], {"props": "k bigint"})
    return shown.select("id", "kind", "flagged", F.col("props.k").alias("k"))


_PASTED = "o AS (SELECT o_orderkey, o_custkey, substr(o_orderpriority, 1, 1) AS stars, o_orderkey % 40 + 1 AS days FROM orders)"


def _pasted(spark, sf, line, join="\n", head=""):
    """One pasted text a customer, with a line for each of their orders."""
    orders = read(spark, sf, "orders").withColumns({"stars": F.substring("o_orderpriority", 1, 1), "days": F.col("o_orderkey") % 40 + 1})
    told = orders.groupBy(F.col("o_custkey").alias("business")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line(F.col("o_orderkey").cast("string"), F.col("stars"), F.col("days").cast("string")).alias("line")))).alias("x"))
    return told.select("business", F.concat(F.lit(head), F.array_join(F.transform("x", lambda r: r["line"]), join)).alias("raw"))


@query(f"WITH {_PASTED} SELECT o_custkey AS business, CAST(stars AS DOUBLE) AS rating, 'order ' || o_orderkey || ' was fine' AS text, days || ' days ago' AS \"when\" FROM o")
def pasted_lines(spark, sf):
    raw = _pasted(spark, sf, lambda k, stars, days: F.concat(stars, F.lit(" | order "), k, F.lit(" was fine ("), days, F.lit(" days ago)")))
    return ingest.parse_lines(raw)


@query(f"WITH {_PASTED} SELECT o_custkey AS business, 'Ann ' || o_orderkey AS reviewer, CAST(stars AS DOUBLE) AS rating, 'fine, \"order\"' || chr(10) || o_orderkey AS text, days || ' days ago' AS \"when\" FROM o")
def pasted_csv(spark, sf):
    raw = _pasted(spark, sf, lambda k, stars, days: F.concat(F.lit("Ann "), k, F.lit(","), stars, F.lit(',"fine, ""order""\n'), k, F.lit('",'), days, F.lit(" days ago")), head="Author,Stars,Review,When\n")
    return ingest.parse_csv(raw).select("business", "reviewer", "rating", "text", "when")


@query(f"WITH {_PASTED} SELECT o_custkey AS business, CAST(stars AS DOUBLE) AS rating, 'order ' || o_orderkey AS text, 'Bo' AS reviewer FROM o")
def pasted_json(spark, sf):
    raw = _pasted(spark, sf, lambda k, stars, days: F.concat(F.lit('{"stars": '), stars, F.lit(', "text": "order '), k, F.lit('", "author": "Bo"}')), ",")
    raw = raw.withColumn("raw", F.concat(F.lit('{"reviews": ['), F.col("raw"), F.lit("]}")))
    return ingest.parse_json(raw).select("business", "rating", "text", "reviewer")


_SAID = "WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 40 + 1 AS days FROM orders) SELECT o_custkey AS business, 'Ann ' || o_orderkey AS reviewer, days || ' days ago' AS \"when\", 'order ' || o_orderkey || ' was quite fine' AS text FROM o"


@query(_SAID)
def pasted_blocks(spark, sf):
    raw = _pasted(spark, sf, lambda k, stars, days: F.concat(F.lit("(Review 1)\n*Ann "), k, F.lit(" ("), days, F.lit(" days ago)*\norder "), k, F.lit(" was quite fine")))
    return ingest.parse_blocks(raw)


@query(_SAID + " WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)")
def pasted_attributions(spark, sf):
    raw = _pasted(spark, sf, lambda k, stars, days: F.concat(F.lit("Ann "), k, F.lit(" ("), days, F.lit(" days ago)\norder "), k, F.lit(" was quite\nfine")))
    return ingest.parse_attributions(raw)


@query(f"WITH {_PASTED} SELECT o_custkey AS business, CAST(stars AS DOUBLE) AS rating, 'order ' || o_orderkey || ' was fine' AS text, round(days / 30.44::DOUBLE, 6) AS months FROM o")
def read_reviews(spark, sf):
    raw = _pasted(spark, sf, lambda k, stars, days: F.concat(stars, F.lit(" | order "), k, F.lit(" was fine ("), days, F.lit(" days ago)")))
    return ingest.read_any(raw, "2026-01-31 00:00:00").select("business", "rating", "text", F.round("months", 6).alias("months"))


_TONE = "CASE WHEN {0} < -0.25 THEN 'consistently negative' WHEN {0} < -0.05 THEN 'negative on balance' WHEN {0} > 0.25 THEN 'consistently positive' WHEN {0} > 0.05 THEN 'positive on balance' ELSE 'mixed' END"


@query(f"""WITH {_D}, f AS (SELECT document_id, round(avg(valence), 6) AS m, min(valence) AS lo, max(valence) AS hi, count(DISTINCT l_suppkey) AS r FROM cd GROUP BY 1), t AS (SELECT count(DISTINCT l_suppkey) AS n FROM cd)
SELECT document_id, {_TONE.format('m')} AS tone, CASE WHEN m > 0.15 THEN 'positive' WHEN m < -0.15 THEN 'negative' ELSE 'mixed' END AS cell,
'from ' || CASE WHEN lo < -0.4 THEN 'strongly negative' WHEN lo < 0 THEN 'mildly negative' ELSE 'neutral' END || ' to ' || CASE WHEN hi > 0.4 THEN 'strongly positive' WHEN hi > 0 THEN 'mildly positive' ELSE 'neutral' END AS reach,
'Stage: raised by ' || CAST(round_even(100 * r / n::DOUBLE, 0) AS INTEGER) || '% of reviewers and ' || {_TONE.format('m')} AS reading FROM f, t""")
def report_wording(spark, sf):
    codes = _by_document(spark, sf)
    facts = codes.groupBy("document_id").agg(F.round(F.avg("valence"), 6).alias("m"), F.min("valence").alias("lo"), F.max("valence").alias("hi"), F.count_distinct("l_suppkey").alias("r"))
    facts = facts.join(F.broadcast(codes.agg(F.count_distinct("l_suppkey").alias("n"))))
    reading = F.regexp_replace(prose.stage_reading(F.lit("Stage"), F.col("m"), F.col("r"), F.col("n")), r" \(mean valence .*", "")
    return facts.select("document_id", prose.tone(F.col("m")).alias("tone"), prose.cell_tone(F.col("m")).alias("cell"), prose.reach(F.col("lo"), F.col("hi")).alias("reach"), reading.alias("reading"))


@query(f"""WITH {_D}, e AS (SELECT DISTINCT document_id, code_id AS item FROM cd), f AS (SELECT item, min(document_id) AS document_id FROM e GROUP BY 1), n AS (SELECT document_id, count(*) AS new FROM f GROUP BY 1),
s AS (SELECT document_id, count(*) AS items, coalesce(any_value(new), 0) AS new FROM e LEFT JOIN n USING (document_id) GROUP BY 1),
p AS (SELECT document_id, row_number() OVER (ORDER BY document_id) >= 3 AND round(new / items::DOUBLE, 6) <= 0.12 AS saturated FROM s)
SELECT count(*) AS n, min(document_id) FILTER (saturated) AS "at", CASE WHEN min(document_id) FILTER (saturated) IS NOT NULL THEN 'provisional saturation' WHEN count(*) < 4 THEN 'too few documents' ELSE 'still climbing' END AS verdict FROM p""")
def saturation_verdict(spark, sf):
    return prose.saturation_reading(readings.saturation(_by_document(spark, sf).withColumn("item", F.col("code_id"))))


@query("""SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 9 + 1) * 1.0::DOUBLE WHEN 1 THEN (o_orderkey % 9 + 1) * 7.0::DOUBLE WHEN 2 THEN (o_orderkey % 9 + 1) * 30.44::DOUBLE
ELSE datediff('day', CAST(o_orderdate AS DATE), DATE '2026-01-31') END / 30.44::DOUBLE, 6) AS months FROM orders""")
def relative_months(spark, sf):
    n = (F.col("o_orderkey") % 9 + 1).cast("string")
    said = F.when(F.col("o_orderkey") % 4 == 0, F.concat(n, F.lit(" days ago"))).when(F.col("o_orderkey") % 4 == 1, F.concat(n, F.lit(" weeks ago"))).when(F.col("o_orderkey") % 4 == 2, F.concat(n, F.lit(" months ago")))
    when = F.coalesce(said, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, sf, "orders").select("o_orderkey", F.round(ingest.months_ago(when, "2026-01-31 00:00:00"), 6).alias("months"))


typed(ORACLE, {"key_lines": {"line": "INTEGER"}, "framework_index": {"score": "INTEGER"}, "emergent_index": {"score": "INTEGER"}})
