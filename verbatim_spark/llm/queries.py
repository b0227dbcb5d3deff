"""Queries of this subpackage: each takes (spark, sf_dir), applies one operator
to its whole table and returns the whole result. ``oracle_sql`` holds DuckDB SQL
for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, pieces, pipeline, pseudo, quality, secrets, simhash, tokens, winnow
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"), pieces.public_model())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.concat_ws(",", "near_items").alias("near_items"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.public_model()
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # Grades: 0 toxic, 1 neither toxic nor good, 2 good.
    graded = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality")).alias("grade"))
    scored = quality.score(docs, quality.learn(docs, graded, grades=3))
    return scored.select(
        "doc_id", "expected_grade", F.col("tails")[0].alias("p_not_toxic"), F.col("tails")[1].alias("p_good"),
        (F.col("tails")[0] < 0.5).alias("toxic"), (F.col("tails")[0] >= 0.5).alias("keep"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base, own = F.col("places.label"), F.col("stretches.label")
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        licenses.score("places", "stretches").alias("score"),
        F.concat_ws(",", F.transform("stretches", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"]))).alias("stretches"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda x: x["rank"] < len(secrets.BASE))
    number = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("secrets", lambda x: ~x["live"])).cast("long").alias("n_shared"), secrets.frequency(F.col("secrets")).alias("frequency"),
    )


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo.score(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.with_next(table(spark, sf_dir, "documents")).repartition("part")
    own = rows.withColumn("fp", winnow.packed(winnow.word_array(F.col("text"))))
    order = Window.partitionBy("part").orderBy("ghost", F.col("key").desc(), "h")
    half = F.floor(F.char_length("text") / 2).cast("int")
    next_text, next_fp = F.lead("text").over(order), F.lead("fp").over(order)
    met = own.select(
        "doc_id", "ghost", "fp", F.char_length("text").cast("long").alias("n_chars"), next_fp.alias("next_fp"),
        F.concat(F.expr("left(text, char_length(text) - floor(char_length(text) / 2))"), F.substring(next_text, F.lit(1), half)).alias("edited"),
    ).where("NOT ghost")
    met = met.withColumn("edited_fp", winnow.packed(winnow.word_array(F.col("edited"))))
    likeness = lambda other: winnow.likeness(winnow.hashes(F.col("fp")), winnow.hashes(F.col(other)))
    return met.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), winnow.shown(F.col("fp")).alias("fingerprint"),
        winnow.shown(F.col("edited_fp")).alias("edited_fingerprint"), likeness("edited_fp").alias("near_edited"),
        likeness("next_fp").alias("near_next"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang",
        # A row without a doc_id is never learned from.
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True)).alias("held_out"),
    )
    model = langid.learn(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep_cols=["held_out"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_decontamination": op2_decontamination,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_quality": op4_quality,
        "op5_licenses": op5_licenses,
        "op6_simhash": op6_simhash,
        "op7_secrets": op7_secrets,
        "op8_pseudo_likelihood": op8_pseudo_likelihood,
        "op9_winnowing": op9_winnowing,
        "op10_language": op10_language,
        "pipeline": pipeline.run,
    }


OP2_SQL = r"""
WITH
docs AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT item, least(13, len(w)) AS n,
    unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1),
      lambda s: array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' '))) AS gram
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2),
    lambda s: array_to_string(list_slice(w, s, s + n - 1), ' '))) AS gram
  FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT g.doc_id, g.s, g.n, x.item FROM grams g JOIN wins x ON g.n = x.n AND g.gram = x.gram),
marked AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM docs),
counts AS (SELECT word, count(*) AS n FROM words GROUP BY word),
numbered AS (SELECT row_number() OVER () AS r, item, w FROM items WHERE len(w) > 0),
places AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM numbered),
starts AS (SELECT r, item, least(13, len(w)) AS n, unnest(range(0, greatest(1, len(w) - 12))) AS s FROM numbered),
ranked AS (
  SELECT x.r, item, s, x.n, k, word, row_number() OVER (PARTITION BY x.r, s ORDER BY c.n, k) AS nth, count(*) OVER (PARTITION BY x.r, s) AS there
  FROM starts x JOIN places y ON x.r = y.r AND k >= s AND k < s + x.n JOIN counts c USING (word)),
anchors AS (SELECT r, item, s, k, word, least(nth, 2) AS nth, n FROM ranked WHERE nth <= 2 AND there >= least(2, n)),
diagonals AS (SELECT doc_id, r, item, s, nth, n, unnest([floor((p - k) / 4.0), floor((p - k) / 4.0) + 1]) AS stretch FROM anchors JOIN words USING (word)),
nearby AS (
  SELECT doc_id, string_agg(item, ',' ORDER BY item) AS near_items FROM (
    SELECT DISTINCT x.doc_id, x.item FROM diagonals x JOIN diagonals y
      ON x.doc_id = y.doc_id AND x.r = y.r AND x.s = y.s AND x.stretch = y.stretch AND x.nth = 1 AND (y.nth = 2 OR x.n = 1))
  GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(near_items, '') AS near_items
FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN nearby USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL}
