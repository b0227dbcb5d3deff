"""Queries over documents and conversations and their DuckDB counterparts.

The tables' prose is invented, so lexicon queries take a small lexicon of its
frequent words; the bundled lexicons are tested on written examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators import coding, corpus
from .views import read, typed

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


STOP = ["the", "of", "and", "to", "in", "is", "that", "was", "for", "with", "this", "by", "are"]
_STOP = ", ".join(f"'{w}'" for w in STOP)
LEXICON = {"first": ["the", "of the", "that"], "second": ["and", "with", "is"], "third": ["to", "in the", "was"]}
TERMS = ["that", "with", "from", "this"]

_DOCS = "docs AS (SELECT doc_id, source, text FROM documents)"
_TOKENS = "regexp_extract_all(lower(text), '[a-z][a-z''’-]*')"
_CONTENT = f"list_filter({_TOKENS}, lambda t: length(t) > 2 AND t NOT IN ({_STOP}))"
_W = f"{_DOCS}, words AS (SELECT doc_id, unnest({_CONTENT}) AS word FROM docs), wc AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY 1, 2)"
_STEMS = "stems AS (SELECT word, {0} AS stem FROM (SELECT DISTINCT word FROM wc))".format(tx.stem_sql("word", "trim(lower({w}), '''-')"))


def _docs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "source", "text")


def cue_sql(cue: str) -> str:
    return f"CAST(regexp_matches(lower(text), '(^|[^a-z]){cue}([^a-z]|$)') AS INTEGER)"


@query(f"""WITH {_DOCS} SELECT doc_id, len({_TOKENS}) AS tokens, len({_CONTENT}) AS content FROM docs""")
def token_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(tx.tokens(F.col("text"))).alias("tokens"), F.size(tx.content_tokens(F.col("text"), STOP)).alias("content"))


@query(f"WITH {_W}, {_STEMS} SELECT stem, count(*) AS words FROM stems GROUP BY 1")
def token_stems(spark, sf):
    words = _docs(spark, sf).select(F.explode(tx.content_tokens(F.col("text"), STOP)).alias("word"))
    return corpus.stem_table(words).groupBy("stem").agg(F.count("*").alias("words"))


@query(f"""WITH {_W}, {_STEMS}, df AS (SELECT stem, count(DISTINCT doc_id) AS df FROM wc JOIN stems USING (word) GROUP BY 1),
b AS (SELECT word, stem, sum(n)::BIGINT AS n FROM wc JOIN stems USING (word) GROUP BY 1, 2)
SELECT word, stem, n, df, round(n * (ln(((SELECT count(*) FROM docs) + 1) / (df + 0.5::DOUBLE)) + 1), 4) AS weight FROM b JOIN df USING (stem) ORDER BY n DESC, word LIMIT 120""")
def word_frequency(spark, sf):
    return corpus.word_frequency(_docs(spark, sf), "doc_id", STOP)


@query(f"""WITH {_DOCS}, w AS (SELECT word, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS word FROM docs) GROUP BY 1),
s AS (SELECT sum(n)::BIGINT AS total_words, sum(n) FILTER (length(word) > 2 AND word NOT IN ({_STOP}))::BIGINT AS content_words, count(*) FILTER (length(word) > 2 AND word NOT IN ({_STOP})) AS unique_words FROM w)
SELECT *, round(unique_words / content_words::DOUBLE, 4) AS ttr FROM s""")
def manifest_stats(spark, sf):
    return corpus.manifest(_docs(spark, sf), STOP)


@query(f"""WITH {_W}, {_STEMS}, d AS (SELECT stem, count(DISTINCT doc_id) AS df FROM wc JOIN stems USING (word) GROUP BY 1)
SELECT stem, df, round(df * (ln(((SELECT count(*) FROM docs) + 1) / (df + 0.5::DOUBLE)) + 1), 4) AS keyness FROM d WHERE df > 1 ORDER BY keyness DESC, stem LIMIT 24""")
def keyness(spark, sf):
    return corpus.keyness(_docs(spark, sf), "doc_id", STOP)


@query(f"""WITH {_DOCS}, w AS (SELECT doc_id AS id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM docs),
p AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z''’-]', '', 'g')) AS plain, unnest(['that', 'with', 'from', 'this']) AS term FROM w),
a AS (SELECT *, list_position(plain, term) AS i FROM p), k AS (SELECT * FROM a WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY term ORDER BY id) <= 6)
SELECT term, id, coalesce(array_to_string(w[greatest(i - 7, 1):i - 1], ' '), '') AS before, w[i] AS hit, coalesce(array_to_string(w[i + 1:i + 7], ' '), '') AS after,
row_number() OVER (PARTITION BY term ORDER BY id) AS line FROM k""")
def kwic(spark, sf):
    return corpus.kwic(_docs(spark, sf), "doc_id", TERMS)


@query(f"""WITH {_DOCS}, m AS (SELECT doc_id, array_to_string(list_transform({_TOKENS}, lambda t: CASE WHEN t IN ({", ".join(f"'{w}'" for w in sorted({*STOP, *tx.KEPT}))}) OR length(t) <= 2 THEN '|' ELSE t END), ' ') AS s FROM docs),
r AS (SELECT doc_id, unnest(list_transform(string_split(s, '|'), lambda x: list_filter(string_split(x, ' '), lambda w: w <> ''))) AS run FROM m),
g AS (SELECT doc_id, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, greatest(len(run) - n + 2, 1)), lambda i: array_to_string(run[i:i + n - 1], ' '))))) AS phrase FROM r WHERE len(run) > 0)
SELECT phrase, count(DISTINCT doc_id) AS df FROM g GROUP BY 1""")
def phrase_document_frequency(spark, sf):
    return corpus.phrase_frequency(_docs(spark, sf), "doc_id", stop=STOP)


_HITS = ", ".join(f"('{name}', {' + '.join(cue_sql(c) for c in cues)}, {i})" for i, (name, cues) in enumerate(LEXICON.items()))


@query(f"""WITH {_DOCS}, h AS (SELECT source, category, hits FROM docs, LATERAL (SELECT * FROM (VALUES {_HITS}) t(category, hits, o)) WHERE hits > 0)
SELECT source, category, count(*) AS units, sum(hits)::BIGINT AS hits FROM h GROUP BY 1, 2""")
def cue_category_matrix(spark, sf):
    return corpus.cue_matrix(_docs(spark, sf), ["source"], LEXICON)


@query(f"""WITH {_DOCS}, h AS (SELECT doc_id, category, hits, o FROM docs, LATERAL (SELECT * FROM (VALUES {_HITS}) t(category, hits, o)))
SELECT doc_id, CASE WHEN max(hits) > 0 THEN arg_max(category, (hits, -o)) ELSE 'describing' END AS intent FROM h GROUP BY 1""")
def intent_argmax(spark, sf):
    scores = {name: tx.cue_hits(F.col("text"), cues) for name, cues in LEXICON.items()}
    return _docs(spark, sf).select("doc_id", tx.argmax(scores, "describing").alias("intent"))


_EMO = {"warm": ["tion", "than", "of-the"], "cold": ["erth", "shan", "in-the"]}


def _emo_sql(cue: str) -> str:
    if "-" in cue:
        return f"CASE WHEN contains(joined, '{cue.replace('-', ' ')}') THEN 1.2 ELSE 0 END"
    return f"CASE WHEN len(list_filter(toks, lambda s: starts_with(s, '{cue}') OR starts_with('{cue}', s) AND length(s) > 3)) > 0 THEN 1.0 ELSE 0 END"


@query(f"""WITH {_DOCS}, t AS (SELECT doc_id, {_TOKENS} AS toks, array_to_string({_TOKENS}, ' ') AS joined FROM docs),
s AS (SELECT doc_id, CAST({" + ".join(map(_emo_sql, _EMO["warm"]))} AS DOUBLE) AS a, CAST({" + ".join(map(_emo_sql, _EMO["cold"]))} AS DOUBLE) AS b FROM t)
SELECT doc_id, CASE WHEN greatest(a, b) = 0 THEN 'neutral' WHEN a >= b THEN 'warm' ELSE 'cold' END AS emotion, round(greatest(a, b), 1) AS score FROM s""")
def emotion_argmax(spark, sf):
    base = _docs(spark, sf).withColumn("toks", tx.tokens(F.col("text"))).withColumn("joined", F.array_join("toks", " "))
    scores = {n: coding.emotion_score(F.col("toks"), F.col("joined"), cues) for n, cues in _EMO.items()}
    return base.select("doc_id", tx.argmax(scores, "neutral").alias("emotion"), F.round(F.greatest(*scores.values()), 1).alias("score"))


_TURNS = """turns AS (SELECT conv_id AS document_id, turn AS turn_idx, role AS speaker, role = 'user' AS is_participant, text FROM conversations)"""


def _turns(spark, sf):
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("turn_idx"), F.col("role").alias("speaker"), (F.col("role") == "user").alias("is_participant"), "text"
    )


@query(f"""WITH {_TURNS}, c AS (SELECT *, last_value(CASE WHEN NOT is_participant THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM turns)
SELECT document_id, turn_idx, q AS question_context FROM c WHERE is_participant""")
def question_context(spark, sf):
    return corpus.question_context(_turns(spark, sf)).select("document_id", "turn_idx", "question_context")


@query("""WITH d AS (SELECT conv_id AS document_id, turn, CASE WHEN role = 'user' THEN 'P' || conv_id ELSE 'Interviewer' END || ': ' || trim(regexp_replace(regexp_replace(text, '[:–-]', ' ', 'g'), '\\s+', ' ', 'g')) AS line FROM conversations),
l AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY turn) - 1 AS turn_idx, line FROM d)
SELECT document_id, CAST(turn_idx AS INTEGER) AS turn_idx, split_part(line, ':', 1) AS speaker, line NOT LIKE 'Interviewer%' AS is_participant, trim(substr(line, position(':' IN line) + 1)) AS text FROM l""")
def turn_segmentation(spark, sf):
    name = F.when(F.col("role") == "user", F.concat(F.lit("P"), F.col("conv_id").cast("string"))).otherwise("Interviewer")
    line = F.concat(name, F.lit(": "), F.trim(F.regexp_replace(F.regexp_replace("text", "[:–-]", " "), r"\s+", " ")))
    script = read(spark, sf, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("x"))
    script = script.groupBy(F.col("conv_id").alias("document_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
    return corpus.split_turns(script)


_SENT = """p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])["''”’)]*\\s+', '\\1␞', 'g'), '␞'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM docs),
f AS (SELECT doc_id, list_reduce(list_transform(ps, lambda x: [x]), lambda acc, x: CASE WHEN length(acc[-1]) < 12
 OR lower(regexp_extract(regexp_replace(acc[-1], '\\.+$', ''), '(\\S+)\\s*$', 1)) IN ('mr', 'mrs', 'ms', 'dr', 'prof', 'st', 'e.g', 'i.e', 'etc', 'vs', 'no')
 THEN list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) ELSE list_concat(acc, x) END) AS ss FROM p WHERE len(ps) > 0)"""


@query(f"WITH {_DOCS}, {_SENT} SELECT doc_id, len(ss) AS sentences, list_sum(list_transform(ss, lambda s: length(s)))::BIGINT AS chars FROM f")
def sentence_count(spark, sf):
    base = _docs(spark, sf).select("doc_id", tx.sentences(F.col("text")).alias("ss")).where(F.size("ss") > 0)
    return base.select("doc_id", F.size("ss").alias("sentences"), F.aggregate("ss", F.lit(0).cast("bigint"), lambda a, s: a + F.length(s)).alias("chars"))


@query("""WITH h AS (SELECT page_id, regexp_replace(html, '<br\\s*/?>', chr(10), 'gi') AS t FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_replace(t, '<[^<>]{1,40}>', ' ', 'g'), '[ \\t]+', ' ', 'g') AS t FROM h) SELECT page_id, length(t) AS n, md5(t) AS digest FROM s""")
def html_strip(spark, sf):
    from ..sources.reviews import strip_html

    return read(spark, sf, "pages").select("page_id", strip_html(F.col("html")).alias("t")).select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def url_identifiers(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"))


@query(f"""WITH {_DOCS}, x AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM docs WHERE regexp_matches(text, '\\bthat\\b', 'i')),
h AS (SELECT doc_id, text, i - 1 AS s FROM x WHERE lower(substr(text, i, 4)) = 'that' AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[A-Za-z0-9_]')) AND NOT regexp_matches(substr(text, i + 4, 1), '[A-Za-z0-9_]'))
SELECT DISTINCT doc_id AS document_id, s - length(regexp_extract(substr(text, 1, s), '([^.\\n?!]*)$', 1)) AS "start", s + length(regexp_extract(substr(text, s + 1), '^([^.\\n?!]*[.\\n?!]?)', 1)) AS "end" FROM h""")
def search_autocode(spark, sf):
    return corpus.search_spans(_docs(spark, sf), "doc_id", "that")


@query("""SELECT conv_id, turn, CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(substr(t, 1, 60), ' [^ ]*$', '') || '…' END AS short
FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations)""")
def truncated_quotes(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", tx.truncate(F.col("text"), 60).alias("short"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _felt_sql(cues: list[str]) -> str:
    """The score of one emotion, as ``coding.emotion_score`` has it."""
    one = lambda c: f"CASE WHEN contains(joined, {_quoted(c.replace('-', ' '))}) THEN 1.2 ELSE 0 END" if "-" in c else (
        f"CASE WHEN len(list_filter(stems, lambda s: starts_with(s, {_quoted(c)}) OR starts_with({_quoted(c)}, s) AND length(s) > 3)) > 0 THEN 1.0 ELSE 0 END")
    return "(" + " + ".join(map(one, cues)) + ")::DOUBLE"


def _cues_sql(cues: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches(lower(text), {_quoted('(^|[^a-z])' + c + '([^a-z]|$)')}) AS INTEGER)" for c in cues) + ")"


_listed = lambda ws: "[" + ", ".join(map(_quoted, ws)) + "]"
_stem_of = tx.stem_sql("w", "trim(lower({w}), " + _quoted("'-") + ")")
_FELT = ", ".join(f"{{'s': {_felt_sql(cues)}, 'o': {-i}, 'n': '{n}', 'w': {lx.EMOTION_VALENCE[n]}::DOUBLE}}" for i, (n, cues) in enumerate(lx.EMOTIONS.items()))
_MEANT = ", ".join(f"{{'s': {_cues_sql(cues)}, 'o': {-i}, 'n': '{n}'}}" for i, (n, cues) in enumerate(lx.INTENTS.items()))
_POLAR = f"""list_reduce(tokens, lambda a, t: {{'score': a.score + CASE WHEN list_contains({_listed(lx.NEGATORS)}, t) THEN 0 ELSE (CASE WHEN list_contains({_listed(lx.POSITIVE)}, t) THEN 1.0 WHEN list_contains({_listed(lx.NEGATIVE)}, t) THEN -1.0 ELSE 0.0 END::DOUBLE)
 * (CASE WHEN a.negated THEN -0.85 ELSE 1.0 END::DOUBLE) * (CASE WHEN a.strong THEN 1.5 ELSE 1.0 END::DOUBLE) END,
 'negated': CASE WHEN list_contains({_listed(lx.NEGATORS)}, t) THEN true WHEN list_contains({_listed(lx.POSITIVE + lx.NEGATIVE)}, t) THEN false ELSE a.negated END, 'strong': list_contains({_listed(lx.INTENSIFIERS)}, t)}},
 {{'score': 0.0::DOUBLE, 'negated': false, 'strong': false}}).score"""


@query(f"""WITH docs AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role = 'user'), {_SENT},
u AS (SELECT doc_id, unnest(ss) AS text, unnest(range(0, len(ss))) AS idx FROM f), k AS (SELECT *, {_TOKENS} AS tokens FROM u WHERE len(regexp_extract_all(text, '\\S+')) >= 4),
s AS (SELECT *, list_transform(tokens, lambda w: {_stem_of}) AS stems, array_to_string(tokens, ' ') AS joined FROM k WHERE len(tokens) >= 4),
e AS (SELECT *, list_sort(list_filter([{_FELT}], lambda x: x.s > 0)) AS felt, list_sort([{_MEANT}])[-1] AS meant, {_POLAR} AS polar FROM s),
v AS (SELECT *, coalesce(felt[-1].s, 0) AS es, polar + coalesce(list_sum(list_transform(felt, lambda x: x.w * least(x.s, 2.0) * 0.6::DOUBLE)), 0) AS raw, len(tokens) AS n,
 list_has_any(tokens, {_listed(lx.HEDGES)}) AS hedged, list_has_any(tokens, {_listed(lx.NEGATORS)}) AS negated FROM e)
SELECT doc_id // 1000 AS document_id, doc_id % 1000 AS turn_idx, idx, coalesce(felt[-1].n, 'neutral') AS emotion, CASE WHEN meant.s > 0 THEN meant.n ELSE 'describing' END AS intent,
round(greatest(-1.0, least(1.0, raw / greatest(n / 12.0::DOUBLE, 1.0))), 3) AS valence,
round(greatest(0.2, least(0.97, 0.55::DOUBLE + CASE WHEN n BETWEEN 8 AND 45 THEN 0.12 WHEN n < 6 THEN -0.12 ELSE 0 END::DOUBLE + least(es, 3.0) * 0.04::DOUBLE + least(meant.s, 3) * 0.025::DOUBLE + 0.05::DOUBLE
 - CASE WHEN hedged THEN 0.11 ELSE 0 END::DOUBLE - CASE WHEN negated THEN 0.05 ELSE 0 END::DOUBLE)), 3) AS confidence FROM v""")
def coded_units(spark, sf):
    """Units of conversations, coded with the bundled lexicons."""
    turns = corpus.question_context(_turns(spark, sf))
    units = corpus.units(turns.drop("question_context"), "sentence")
    coded = coding.code_units(units)
    return coded.select("document_id", "turn_idx", "idx", "emotion", "intent", "valence", coding.confidence(F.lit(2)).alias("confidence"))


typed(ORACLE, {
    "coded_units": {"turn_idx": "BIGINT", "idx": "INTEGER"},
    "token_counts": {"tokens": "INTEGER", "content": "INTEGER"}, "kwic": {"line": "INTEGER"}, "sentence_count": {"sentences": "INTEGER"},
    "html_strip": {"n": "INTEGER"}, "search_autocode": {"start": "INTEGER", "end": "INTEGER"},
})
