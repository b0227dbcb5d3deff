"""Segmentation and counting over documents: turns, units, words, phrases, cues."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import let, running
from ..functions.kept import keep


def split_turns(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(document_id, turn_idx, speaker, is_participant, text). A line with a
    speaker's label of up to three words begins a turn, other lines join the one
    before; without any label, paragraphs are the participant's turns. A
    document is handled where it is read, without a shuffle."""
    body = F.col("_body")
    base = docs.select(F.col(id_col).alias("document_id"), F.translate(tx.normalise(F.col(text_col)), tx.CUT, " ").alias("_body"))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    speaker = lambda x: F.regexp_extract(x, tx.SPEAKER, 1)
    marked = lambda x: x.rlike(tx.SPEAKER) & (tx.word_count(speaker(x)) <= 3) & ~speaker(x).endswith(",")
    # Lines that begin a turn get a mark in front, at which the whole text is cut.
    cut = F.split(F.array_join(F.transform("_lines", lambda x: F.when(marked(x), F.concat(F.lit(tx.CUT), x)).otherwise(x)), "\n"), tx.CUT)

    def turn(part, i):
        head = F.substring_index(part, "\n", 1)
        named = F.struct(F.trim(speaker(head)).alias("speaker"), F.concat(F.regexp_extract(head, tx.SPEAKER, 2), F.substring(part, F.length(head) + 1, F.length(part))).alias("text"))
        return F.when(i > 0, named).otherwise(F.struct(F.lit(None).cast("string").alias("speaker"), part.alias("text")))

    said = F.filter(F.transform(cut, turn), lambda t: t["speaker"].isNotNull() | (t["text"] != ""))
    paragraphs = F.transform(F.split(body, "\n\n"), lambda p: F.struct(F.lit(None).cast("string").alias("speaker"), p.alias("text")))
    turns = F.when(F.exists("_lines", marked), said).otherwise(paragraphs)
    each = base.withColumn("_lines", lines).select("document_id", F.posexplode(turns).alias("turn_idx", "turn"))
    text = F.trim(F.regexp_replace("turn.text", r"\s+", " "))
    key = F.regexp_replace(F.lower("turn.speaker"), "^[. ]+|[. ]+$", "")
    return each.select(
        "document_id", "turn_idx", F.col("turn.speaker").alias("speaker"), F.coalesce(~key.isin(tx.INTERVIEWERS), F.lit(True)).alias("is_participant"), text.alias("text")
    ).where("text <> ''")


def question_context(turns: DataFrame, order: str = "turn_idx") -> DataFrame:
    """Participants' turns with the last other speaker's turn before them."""
    before = Window.partitionBy("document_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(~F.col("is_participant"), F.col("text")), ignorenulls=True).over(before)
    return turns.withColumn("question_context", asked).where("is_participant")


def units(turns: DataFrame, granularity: str = "sentence", least: int = 4) -> DataFrame:
    """Meaning units of ``least`` or more words: clauses, sentences or whole turns."""
    pieces = {
        "utterance": F.array("text"), "sentence": tx.sentences(F.col("text")),
        "clause": F.flatten(F.transform(tx.sentences(F.col("text")), tx.clauses)),
    }[granularity]
    each = turns.select(*[c for c in turns.columns if c != "text"], F.posexplode(pieces).alias("idx", "text"))
    return each.where(tx.word_count(F.col("text")) >= least)


def locate(units: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds char_start and char_end, the unit's place in its document (document_id,
    body); blanks in the unit stand for any white space. Units of one document must
    follow each other, so this is one pass over each document's units; a body is
    moved once, not with each unit."""

    def place(group: pd.DataFrame, documents: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn_idx", "idx"])
        text, cursor, spans = documents["body"].iloc[0] if len(documents) else "", 0, []
        for unit in group["text"]:
            pattern = re.compile(r"\s+".join(map(re.escape, unit.split())))
            hit = (pattern.search(text, cursor) or pattern.search(text)) if unit.split() else None
            spans.append(hit.span() if hit else (0, 0))
            cursor = hit.end() if hit else cursor
        group["char_start"], group["char_end"] = [s for s, _ in spans], [e for _, e in spans]
        return group

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema.fields) + ", char_start long, char_end long"
    return units.groupBy("document_id").cogroup(bodies.select("document_id", "body").groupBy("document_id")).applyInPandas(place, schema)


def stem_words(words: DataFrame, word: str = "word") -> DataFrame:
    """Adds the stems of distinct words, in compiled expressions: the first rule that
    applies, then what it leaves."""
    w, n = F.col("_w"), F.length("_w")
    rule = F.when(n <= 3, -1)
    for i, (suffix, _) in enumerate(tx.SUFFIXES):
        rule = rule.when(w.endswith(suffix) & (n >= len(suffix) + 3), i)
    cut = F.array(*[F.lit(len(s)) for s, _ in tx.SUFFIXES])
    left = F.when(F.col("_rule") < 0, w).otherwise(F.concat(F.substring(w, F.lit(1), n - F.get(cut, F.col("_rule"))), F.get(tx.strings([r for _, r in tx.SUFFIXES]), F.col("_rule"))))
    doubled = (F.col("_rule") >= 0) & (F.length("_left") > 3) & F.col("_left").rlike(r"([^sl])\1$")
    trimmed = words.withColumn("_w", F.regexp_replace(F.lower(F.col(word)), "^['-]+|['-]+$", "")).withColumn("_rule", rule.otherwise(-1))
    told = trimmed.withColumn("_left", left)
    return told.withColumn("stem", F.when(doubled, F.substring("_left", F.lit(1), F.length("_left") - 1)).otherwise(F.col("_left"))).drop("_w", "_rule", "_left")


def stem_table(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem) of distinct words; join it back rather than stem each occurrence."""
    return stem_words(words.select(word).distinct(), word)


def word_frequency(docs: DataFrame, id_col: str, stop: list[str] = tx.STOPWORDS, top: int = 120) -> DataFrame:
    """Most frequent content words with their stems' document frequency and
    count times idf. Words are counted before anything is joined."""
    each = docs.select(F.col(id_col).alias("d"), F.explode(tx.content_tokens(F.col("text"), stop)).alias("word"))
    # Read by four branches: texts are taken apart once, and distinct words stemmed once.
    counts = keep(each.groupBy("d", "word").agg(F.count("*").alias("n")), "counts")
    by_word = keep(stem_words(counts.groupBy("word").agg(F.sum("n").alias("n"))), "words")
    df = counts.join(by_word.select("word", "stem"), "word").groupBy("stem").agg(F.countDistinct("d").alias("df"))
    total = docs.agg(F.count("*").alias("docs"))
    weight = F.col("n") * (F.log((F.col("docs") + 1) / (F.col("df") + 0.5)) + 1)
    out = by_word.join(df, "stem").join(F.broadcast(total)).select("word", "stem", "n", "df", F.round(weight, 4).alias("weight"))
    return out.orderBy(F.desc("n"), "word").limit(top)


def manifest(docs: DataFrame, stop: list[str] = tx.STOPWORDS) -> DataFrame:
    """Total, content and distinct words and the type-token ratio."""
    words = docs.select(F.explode(tx.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    content = (F.length("w") > 2) & ~F.col("w").isin(stop)
    return words.agg(
        F.sum("n").alias("total_words"), F.sum(F.when(content, F.col("n")).otherwise(0)).alias("content_words"), F.count_if(content).alias("unique_words")
    ).withColumn("ttr", F.round(F.col("unique_words") / F.col("content_words"), 4))


def keyness(units: DataFrame, id_col: str, stop: list[str] = tx.STOPWORDS, top: int = 24) -> DataFrame:
    """Stems in more than one unit by number of units times idf."""
    words = units.select(F.col(id_col).alias("u"), F.explode(F.array_distinct(tx.content_tokens(F.col("text"), stop))).alias("word"))
    df = words.join(stem_table(words), "word").select("u", "stem").distinct().groupBy("stem").agg(F.count("*").alias("df"))
    total = units.agg(F.count("*").alias("n"))
    value = F.round(F.col("df") * (F.log((F.col("n") + 1) / (F.col("df") + 0.5)) + 1), 4)
    return df.where("df > 1").join(F.broadcast(total)).select("stem", "df", value.alias("keyness")).orderBy(F.desc("keyness"), "stem").limit(top)


def kwic(docs: DataFrame, id_col: str, terms: list[str], width: int = 7, lines: int = 6) -> DataFrame:
    """First use of each term in a document with ``width`` words around it, at
    most ``lines`` documents a term, in order of id."""
    words = docs.select(F.col(id_col).alias("id"), F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w"))
    plain = F.transform("w", lambda x: F.regexp_replace(F.lower(x), r"[^a-z'’-]", ""))
    each = words.withColumn("plain", plain).select("id", "w", "plain", F.explode(tx.strings(terms)).alias("term")).withColumn("at", F.array_position("plain", F.col("term")).cast("int")).where("at > 0")
    first = F.greatest(F.col("at") - width, F.lit(1))
    shown = each.select(
        "term", "id", F.array_join(F.slice("w", first, F.col("at") - first), " ").alias("before"), F.get("w", F.col("at") - 1).alias("hit"),
        F.array_join(F.slice("w", F.col("at") + 1, width), " ").alias("after"),
    )
    order = Window.partitionBy("term").orderBy("id")
    return shown.withColumn("line", F.row_number().over(order)).where(F.col("line") <= lines)


def phrase_frequency(units: DataFrame, id_col: str, most: int = 3, stop: list[str] = tx.STOPWORDS) -> DataFrame:
    """In how many units each phrase stands."""
    each = units.select(F.explode(F.array_distinct(tx.phrases(F.col("text"), most, stop))).alias("phrase"))
    return each.groupBy("phrase").agg(F.count("*").alias("df"))


def cue_matrix(units: DataFrame, by: list[str], lexicon: dict[str, list[str]]) -> DataFrame:
    """Units with a cue of each category and the number of distinct cues in
    them, by group; one pass over the text, no join."""
    hits = F.array(*[F.struct(F.lit(name).alias("category"), tx.cue_hits(F.col("text"), cues).alias("hits")) for name, cues in lexicon.items()])
    each = units.select(*by, F.explode(hits).alias("x")).where("x.hits > 0")
    return each.groupBy(*by, F.col("x.category").alias("category")).agg(F.count("*").alias("units"), F.sum("x.hits").alias("hits"))


def search_spans(docs: DataFrame, id_col: str, term: str, whole_word: bool = True) -> DataFrame:
    """Every sentence in which a term occurs, as a span of its document (code
    points, end exclusive), each once: quotations for the term's code."""
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)
    pattern = f"(?i)\\b{quoted}\\b" if whole_word else f"(?i){quoted}"
    if any(c in ".\n?!" for c in term):
        return _spans_around(docs, id_col, pattern)
    # A term without end marks stands inside one sentence: each sentence is looked at once.
    pieces = F.regexp_extract_all("text", F.lit(r"[^.\n?!]*[.\n?!]|[^.\n?!]+"), F.lit(0))

    def placed(x):
        ends = running(F.transform(x, lambda p: F.length(p).cast("bigint")))
        return F.zip_with(x, ends, lambda p, e: F.struct(p.rlike(pattern).alias("hit"), (e - F.length(p)).cast("int").alias("s"), e.cast("int").alias("e")))

    found = docs.where(F.col("text").rlike(pattern)).select(F.col(id_col).alias("document_id"), F.explode(F.filter(let(pieces, placed), lambda x: x["hit"])).alias("x"))
    return found.select("document_id", F.col("x.s").alias("start"), F.col("x.e").alias("end"))


def _spans_around(docs: DataFrame, id_col: str, pattern: str) -> DataFrame:
    """For terms that hold an end mark themselves: the sentence's start before each
    hit and its end after the hit's start."""
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)

    sizes = F.transform(hits, lambda m: F.length(m).cast("bigint"))
    ends = running(F.zip_with(F.slice(F.transform(gaps, lambda g: F.length(g)), F.lit(1), F.size(hits)), sizes, lambda g, m: g + m))
    starts = F.zip_with(ends, sizes, lambda e, n: (e - n).cast("int"))
    found = docs.where(F.col("text").rlike(pattern)).select(F.col(id_col).alias("document_id"), "text", F.explode(starts).alias("s"))
    head = F.length(F.regexp_extract(F.reverse(F.col("text").substr(F.lit(1), F.col("s"))), r"^([^.\n?!]*)", 1))
    tail = F.length(F.regexp_extract(F.col("text").substr(F.col("s") + 1, F.length("text")), r"^([^.\n?!]*[.\n?!]?)", 1))
    return found.select("document_id", (F.col("s") - head).alias("start"), (F.col("s") + tail).alias("end")).distinct()


