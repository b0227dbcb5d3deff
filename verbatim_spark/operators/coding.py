"""Open coding of meaning units: emotion, intent, valence, confidence, label.

A unit is a row with ``text``; each function adds columns computed in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx

# Templates of labels by emotion and by intent.
EMOTION_FRAMES = {
    "frustration": "Frustration with {p}", "anxiety": "Anxiety about {p}", "sadness": "Loss and sadness around {p}", "anger": "Anger at {p}",
    "relief": "Relief at {p}", "hope": "Hope for {p}", "gratitude": "Gratitude for {p}", "pride": "Pride in {p}",
    "confusion": "Confusion about {p}", "trust": "Trust in {p}", "distrust": "Distrust of {p}", "resignation": "Resignation about {p}",
}
INTENT_FRAMES = {
    "recounting": "Account of {p}", "evaluating": "Judgement of {p}", "comparing": "Comparison of {p}", "justifying": "Explanation of {p}",
    "recommending": "Call for {p}", "contrasting": "Tension around {p}", "hypothesising": "Imagining {p}", "describing": "Description of {p}",
}


def emotion_score(stems: Column, joined: Column, cues: list[str]) -> Column:
    """1.2 for each longer cue in the text, 1 for each cue that begins a stem, or
    that begins with a stem of over three letters."""

    def one(cue):
        if "-" in cue:
            return F.when(joined.contains(cue.replace("-", " ")), 1.2).otherwise(0.0)
        return F.when(F.exists(stems, lambda s: s.startswith(cue) | (F.lit(cue).startswith(s) & (F.length(s) > 3))), 1.0).otherwise(0.0)

    return sum(map(one, cues), F.lit(0.0))


def polarity(tokens: Column, positive=lx.POSITIVE, negative=lx.NEGATIVE, negators=lx.NEGATORS, strong=lx.INTENSIFIERS) -> Column:
    """Sum of polarity words: 1.5 times after an intensifier, -0.85 times if a
    negator came since the last polarity word, however far back. Negators have
    no polarity of their own."""
    listed = {k: tx.strings(sorted(v)) for k, v in (("p", positive), ("n", negative), ("not", negators), ("strong", strong))}
    has = lambda k, t: F.array_contains(listed[k], t)

    def fold(acc, t):
        value = F.when(has("p", t), 1.0).when(has("n", t), -1.0).otherwise(0.0)
        turned = F.when(acc["negated"], value * -0.85).otherwise(value)
        weight = F.when(acc["strong"], 1.5).otherwise(1.0)
        negator = has("not", t)
        return F.struct(
            F.when(negator, acc["score"]).otherwise(acc["score"] + turned * weight).alias("score"),
            F.when(negator, True).when(value != 0, False).otherwise(acc["negated"]).alias("negated"), has("strong", t).alias("strong"),
        )

    start = F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("negated"), F.lit(False).alias("strong"))
    return F.aggregate(tokens, start, fold, lambda acc: acc["score"])


def code_units(units: DataFrame, emotions=None, weights=None, intents=None) -> DataFrame:
    """Adds tokens, stems, emotion, intent, valence, confidence parts and
    alternatives to units of four or more words; shorter ones go."""
    emotions, weights, intents = emotions or lx.EMOTIONS, weights or lx.EMOTION_VALENCE, intents or lx.INTENTS
    # Arrays that lambdas read again and again are columns first.
    base = units.withColumn("tokens", tx.tokens(F.col("text"))).where(F.size("tokens") >= 4)
    base = base.withColumns({"stems": tx.stems(F.col("tokens")), "joined": F.array_join("tokens", " ")})
    scores = F.array(*[F.struct(emotion_score(F.col("stems"), F.col("joined"), cues).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("n"), F.lit(weights.get(name, 0.0)).alias("w")) for i, (name, cues) in enumerate(emotions.items())])
    hits = F.array(*[F.struct(tx.cue_hits(F.col("text"), cues).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("n")) for i, (name, cues) in enumerate(intents.items())])
    scored = base.withColumns({"emotions": F.array_sort(F.filter(scores, lambda x: x["s"] > 0)), "intents": hits})
    first, intent = F.element_at("emotions", -1), F.array_max("intents")
    felt = F.aggregate("emotions", F.lit(0.0), lambda acc, x: acc + x["w"] * F.least(x["s"], F.lit(2.0)) * 0.6)
    any_of = lambda words: F.arrays_overlap("tokens", tx.strings(sorted(words)))
    scored = scored.withColumns({
        "emotion": F.when(F.size("emotions") > 0, first["n"]).otherwise("neutral"),
        "emotion_score": F.when(F.size("emotions") > 0, first["s"]).otherwise(0.0),
        "second_emotion": F.when((F.size("emotions") > 1) & (F.get("emotions", F.size("emotions") - 2)["s"] >= 0.6 * first["s"]), F.get("emotions", F.size("emotions") - 2)["n"]),
        "intent": F.when(intent["s"] > 0, intent["n"]).otherwise("describing"), "intent_hits": intent["s"],
        "negated": any_of(lx.NEGATORS), "hedged": any_of(lx.HEDGES), "raw": polarity(F.col("tokens")) + felt,
    })
    n = F.size("tokens")
    return scored.withColumns({
        "valence": F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("raw") / F.greatest(n / 12.0, F.lit(1.0)))), 3),
        "literal_meaning": tx.literal_meaning(F.col("text")),
    }).drop("raw", "joined", "emotions", "intents")


def confidence(phrase_words: Column) -> Column:
    """From length, emotion, intent, phrase, hedging and negation; 0.2 to 0.97."""
    n = F.size("tokens")
    value = (
        F.lit(0.55) + F.when((n >= 8) & (n <= 45), 0.12).when(n < 6, -0.12).otherwise(0.0)
        + F.least(F.col("emotion_score"), F.lit(3.0)) * 0.04 + F.least(F.col("intent_hits"), F.lit(3)) * 0.025
        + F.when(phrase_words >= 2, 0.05).otherwise(0.0) - F.when(F.col("hedged"), 0.11).otherwise(0.0) - F.when(F.col("negated"), 0.05).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.2), F.least(F.lit(0.97), value)), 3)


def label(phrase: Column) -> Column:
    """The emotion's template, or the intent's if there is no emotion."""
    frames = F.create_map(*[F.lit(x) for kv in EMOTION_FRAMES.items() for x in kv])
    others = F.create_map(*[F.lit(x) for kv in INTENT_FRAMES.items() for x in kv])
    return F.replace(F.coalesce(frames[F.col("emotion")], others[F.col("intent")]), F.lit("{p}"), phrase)


def alternatives() -> Column:
    """Other readings of a unit, at most three."""
    told = [
        F.when(F.col("second_emotion").isNotNull(), F.concat(F.lit("may express "), F.col("second_emotion"))),
        F.when(F.col("negated"), "a denial may hide concern"), F.when(F.col("hedged"), "said with doubt"),
    ]
    found = F.filter(F.array(*told), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.lit("taken at its word")))


def phrase_candidates(units: DataFrame, idf: DataFrame, document_frequency: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Scored label candidates (unit, phrase, score): mean idf of the words,
    weighed by length, content and how many units share the phrase."""
    raw = units.select(unit, F.explode(F.array_distinct(tx.phrases(F.col("text")))).alias("raw"))
    words = F.split("raw", " ")
    verbs, low = tx.strings(sorted(lx.VERBS)), tx.strings(sorted(lx.LOW_CONTENT))
    # Verbs at the beginning go.
    trimmed = F.aggregate(words, tx.strings([]), lambda acc, w: F.when((F.size(acc) == 0) & F.array_contains(verbs, w), acc).otherwise(F.concat(acc, F.array(w))))
    each = raw.withColumn("words", trimmed).where((F.size("words") > 0) & F.exists("words", lambda w: ~F.array_contains(low, w)))
    each = each.select(unit, F.array_join("words", " ").alias("phrase"), "words").distinct()
    weighed = (
        each.select(unit, "phrase", "words", F.explode("words").alias("word")).withColumn("stem", tx.stem(F.col("word")))
        .join(idf, "stem", "left").groupBy(unit, "phrase", "words").agg(F.avg(F.coalesce("idf", F.lit(1.0))).alias("weight"))
        .join(document_frequency, "phrase", "left")
    )
    n = F.size("words")
    score = (
        F.col("weight") * F.when(n == 1, 0.88).when(n == 2, 1.16).otherwise(1.02)
        * F.when(F.exists("words", lambda w: F.array_contains(low, w)), 0.6).otherwise(1.0)
        * F.when(F.forall("words", lambda w: w.endswith("ly")), 0.3).otherwise(1.0)
        * (1 + 0.75 * F.log1p(F.coalesce("df", F.lit(0))))
    )
    return weighed.select(unit, "phrase", score.alias("score"))


def salient_phrases(candidates: DataFrame, unit: str = "unit_id") -> DataFrame:
    """The best candidate of each unit, the first in order of letters of equals.
    Units are independent: a phrase isn't held back for having been used, which
    would put all units in one sequence."""
    best = Window.partitionBy(unit).orderBy(F.desc("score"), "phrase")
    return candidates.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def consolidate(codes: DataFrame, idf: DataFrame, concepts: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """Codes (phrase, label, emotion, intent, ...) with labels that recur. A code's
    concept is that of its phrase's last stem, (term, concept) if given, else the
    stem, or what ``key`` says. All codes of a concept are named after its representative word, by count
    to the 1.5 and idf to the 0.35 (idf: stem, idf), or the most frequent phrase of
    two words with it that occurs more than once; their own label is kept as
    open_label. Words too general and verbs don't represent."""
    headed = codes.withColumn("concept", tx.stem(F.element_at(F.split("phrase", " "), -1)) if key is None else key)
    if concepts is not None:
        known = concepts.select(F.col("term").alias("concept"), F.col("concept").alias("_known"))
        headed = headed.join(known, "concept", "left").withColumn("concept", F.coalesce("_known", "concept")).drop("_known")
    phrases = headed.groupBy("concept", "phrase").agg(F.count("*").alias("n"))
    general = tx.strings(sorted({*lx.LOW_CONTENT, *lx.VERBS}))
    words = phrases.select("concept", "n", F.explode(F.split("phrase", " ")).alias("word")).where(~F.array_contains(general, F.col("word")))
    words = words.groupBy("concept", "word").agg(F.sum("n").alias("n")).withColumn("stem", tx.stem(F.col("word"))).join(idf, "stem", "left")
    value = F.round(F.pow("n", F.lit(1.5)) * F.pow(F.coalesce("idf", F.lit(1.0)), F.lit(0.35)), 9)
    best = words.groupBy("concept").agg(F.max_by("word", F.struct(value, "word")).alias("word"))
    pairs = phrases.where((F.size(F.split("phrase", " ")) == 2) & (F.col("n") > 1)).join(best, "concept").where(F.array_contains(F.split("phrase", " "), F.col("word")))
    pairs = pairs.groupBy("concept").agg(F.max_by("phrase", F.struct("n", "phrase")).alias("pair"))
    named = best.join(pairs, "concept", "left").select("concept", F.coalesce("pair", "word").alias("_name"))
    told = headed.join(named, "concept", "left").withColumn("open_label", F.col("label"))
    plain = label(F.coalesce("_name", "phrase"))
    return told.withColumn("label", F.concat(F.upper(F.substring(plain, 1, 1)), F.regexp_replace(plain, "^.", ""))).drop("_name")
