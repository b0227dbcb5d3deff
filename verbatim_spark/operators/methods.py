"""Parts of the methodology readings that go over coded text: indexing by a
framework, content categories, paradigm slots, open coding, cases, stories.

Codes are rows (id, participant, ord, theme_id, text, stems, label, phrase, mood,
valence, confidence); ``ord`` orders a participant's codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def index(codes: DataFrame, framework: dict[str, list[str]]) -> DataFrame:
    """Codes by category (category, score): how many of a category's cues occur in
    the code, one row for each category with any. One pass over the text, no join."""
    hits = F.array(*[F.struct(F.lit(name).alias("category"), tx.cue_hits(F.col("text"), cues).alias("score")) for name, cues in framework.items()])
    each = codes.withColumn("_hit", F.explode(F.filter(hits, lambda x: x["score"] > 0)))
    return each.withColumns({"category": F.col("_hit.category"), "score": F.col("_hit.score")}).drop("_hit")


def index_emergent(codes: DataFrame, terms: DataFrame) -> DataFrame:
    """The same for categories that come from themes: (category, terms array), at
    most a handful, met by the stems of each code."""
    few = terms.agg(F.collect_list(F.struct("category", "terms")).alias("_terms"))
    scored = F.transform("_terms", lambda t: F.struct(t["category"].alias("category"), F.size(F.array_intersect(F.col("stems"), t["terms"])).alias("score")))
    each = codes.join(F.broadcast(few)).withColumn("_hit", F.explode(F.filter(scored, lambda x: x["score"] > 0)))
    return each.withColumns({"category": F.col("_hit.category"), "score": F.col("_hit.score")}).drop("_hit", "_terms")


def emergent(themes: DataFrame, top_terms: DataFrame, first: int) -> DataFrame:
    """Categories (category, terms) from the first themes in order that are more than
    candidates: themes (theme_id, name, status, ord), top_terms (theme_id, rank, term)."""
    early = themes.orderBy("ord").limit(first).where("status <> 'candidate'")
    listed = top_terms.groupBy("theme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return early.join(listed, "theme_id", "left").select(F.col("name").alias("category"), F.coalesce("terms", tx.strings([])).alias("terms"))


def content_hits(text: Column, stems: Column, terms: list[str]) -> Column:
    """How many terms stand in a text between blanks, or have their stem among its stems."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return sum(((padded.contains(f" {t} ") | F.array_contains(stems, tx.stem(F.lit(t)))).cast("int") for t in terms), F.lit(0))


def content_index(codes: DataFrame, scheme: dict[str, list[str]]) -> DataFrame:
    """Codes by content category (category, score)."""
    hits = F.array(*[F.struct(F.lit(name).alias("category"), content_hits(F.col("text"), F.col("stems"), terms).alias("score")) for name, terms in scheme.items()])
    each = codes.withColumn("_hit", F.explode(F.filter(hits, lambda x: x["score"] > 0)))
    return each.withColumns({"category": F.col("_hit.category"), "score": F.col("_hit.score")}).drop("_hit")


def content_matrix(indexed: DataFrame, by: str = "participant", limit: int = 180) -> DataFrame:
    """Hits by participant and category with the first example of each, and totals
    (null participant, null category or both)."""
    return indexed.cube(by, "category").agg(
        F.sum("score").alias("hits"), F.count("*").alias("codes"), F.min_by(tx.truncate(F.col("text"), limit), F.struct("ord", "text")).alias("example")
    )


def latent_layer(indexed: DataFrame, by: str = "participant") -> DataFrame:
    """Share of all hits, reach over participants, mean valence and prevailing mood
    (but the neutral one) of each content category."""
    total = indexed.agg(F.sum("score").alias("_all"))
    facts = indexed.groupBy("category").agg(F.sum("score").alias("hits"), F.countDistinct(by).alias("spread"), F.round(F.avg("valence"), 6).alias("mean_valence"))
    felt = indexed.where("mood <> 'neutral'").groupBy("category", "mood").agg(F.count("*").alias("k"))
    top = felt.groupBy("category").agg(F.max_by("mood", F.struct("k", "mood")).alias("mood"))
    return facts.join(F.broadcast(total)).join(top, "category", "left").select(
        "category", "hits", F.round(F.col("hits") / F.col("_all"), 4).alias("share"), "spread", "mean_valence", F.coalesce("mood", F.lit("no marked affect")).alias("mood")
    )


def manifest_terms(words: DataFrame, frequent: int = 200, top: int = 30) -> DataFrame:
    """Of the most frequent words, those with the highest keyness: (word, stem, n,
    df, weight) in, the last being count times idf."""
    many = words.orderBy(F.desc("n"), "word").limit(frequent)
    return many.orderBy(F.desc("weight"), "word").limit(top)


def key_lines(docs: DataFrame, words: DataFrame, id_col: str, top: int = 8, width: int = 7, lines: int = 6) -> DataFrame:
    """Keywords in context for the ``top`` first of the words (word, weight)."""
    terms = words.orderBy(F.desc("weight"), "word").limit(top).agg(F.collect_list("word").alias("_terms"))
    split = docs.select(F.col(id_col).alias("id"), F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w")).join(F.broadcast(terms))
    plain = F.transform("w", lambda x: F.regexp_replace(F.lower(x), r"[^a-z'’-]", ""))
    each = split.withColumn("plain", plain).select("id", "w", "plain", F.explode("_terms").alias("term"))
    each = each.withColumn("at", F.array_position("plain", F.col("term")).cast("int")).where("at > 0")
    first = F.greatest(F.col("at") - width, F.lit(1))
    shown = each.select(
        "term", "id", F.array_join(F.slice("w", first, F.col("at") - first), " ").alias("before"), F.get("w", F.col("at") - 1).alias("hit"),
        F.array_join(F.slice("w", F.col("at") + 1, width), " ").alias("after"),
    )
    return shown.withColumn("line", F.row_number().over(Window.partitionBy("term").orderBy("id"))).where(F.col("line") <= lines)


def open_coding(codes: DataFrame, top: int = 12) -> DataFrame:
    """The most frequent labels and how many codes have them."""
    return codes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(top)


def in_vivo(codes: DataFrame, top: int = 10, limit: int = 90) -> DataFrame:
    """Participants' own words: the first codes of 4 to 12 words that are held with
    more than 0.6 confidence."""
    short = codes.where(tx.word_count(F.col("text")).between(4, 12) & (F.col("confidence") > 0.6))
    return short.orderBy("ord", "participant", "text").limit(top).select("participant", "ord", tx.truncate(F.col("text"), limit).alias("phrase"))


def paradigm(codes: DataFrame, slots: dict[str, list[str]], category: str = "category", shown: int = 3, limit: int = 200) -> DataFrame:
    """Evidence for each slot of the paradigm model in each category: how many codes
    have its cues, and the best by cues times confidence."""
    found = index(codes.withColumnRenamed(category, "_group"), slots).withColumnsRenamed({"category": "slot", "_group": category})
    best = Window.partitionBy(category, "slot").orderBy(F.desc(F.round(F.col("score") * F.col("confidence"), 6)), "ord", "text")
    ranked = found.withColumn("rank", F.row_number().over(best))
    quoted = F.when(F.col("rank") <= shown, F.struct("rank", tx.truncate(F.col("text"), limit).alias("quote")))
    return ranked.groupBy(category, "slot").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(quoted)), lambda x: x["quote"]).alias("evidence"))


def statements(codes: DataFrame, dimension: Column, note: Column, by: str = "participant", top: int = 8, limit: int = 300) -> DataFrame:
    """The most confident codes of each case with how they are said and the
    dimension of experience that they stand in."""
    best = Window.partitionBy(by).orderBy(F.desc("confidence"), "ord", "text")
    ranked = codes.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select(by, "rank", tx.truncate(F.col("text"), limit).alias("quote"), dimension.alias("dimension"), note.alias("note"), "confidence")


def dimension_profile(codes: DataFrame, dimensions: Column, by: str = "participant") -> DataFrame:
    """Codes by dimension of experience, by case and overall (null case)."""
    return codes.select(by, F.explode(dimensions).alias("dimension")).rollup("dimension", by).agg(F.count("*").alias("n")).where("dimension IS NOT NULL")


def case_summary(codes: DataFrame, dimensions: Column, by: str = "participant") -> DataFrame:
    """Each case's codes, mean valence, prevailing mood and dimension."""
    facts = codes.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("valence"), 2).alias("mean_valence"))
    top = lambda df, c: df.groupBy(by, c).agg(F.count("*").alias("k")).groupBy(by).agg(F.max_by(c, F.struct("k", c)).alias(c))
    moods = top(codes.where("mood <> 'neutral'"), "mood")
    dims = top(codes.select(by, F.explode(dimensions).alias("dimension")), "dimension")
    told = facts.join(moods, by, "left").join(dims, by, "left")
    return told.select(by, "n", "mean_valence", F.coalesce("mood", F.lit("an unmarked register")).alias("mood"), F.coalesce("dimension", F.lit("experiential")).alias("dimension"))


def narrative_cross(shapes: DataFrame, agency: DataFrame, turns: DataFrame) -> DataFrame:
    """What stories have in common: (kind, name, value) with plot shapes and turning
    points counted and the mean agency ratio."""
    line = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))
    plots = line(shapes.groupBy("shape").agg(F.count("*").alias("k")), "plot", F.col("shape"), F.col("k"))
    ratio = line(agency.agg(F.round(F.avg("ratio"), 6).alias("m")), "agency", F.lit("mean ratio"), F.coalesce("m", F.lit(0.0)))
    directions = line(turns.groupBy("direction").agg(F.count("*").alias("k")), "turns", F.col("direction"), F.col("k"))
    return plots.unionByName(ratio).unionByName(directions)


def agency_counts(codes: DataFrame, active: list[str], passive: list[str], by: str = "participant") -> DataFrame:
    return codes.groupBy(by).agg(F.sum(tx.cue_hits(F.col("text"), active)).alias("active"), F.sum(tx.cue_hits(F.col("text"), passive)).alias("passive"))


def temporal_markers(codes: DataFrame, markers: list[str], by: str = "participant", top: int = 8) -> DataFrame:
    """The marks of time that each case uses most, counted once a code."""
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    found = F.filter(tx.strings(markers), lambda m: padded.contains(F.concat(F.lit(" "), m, F.lit(" "))))
    counts = codes.select(by, F.explode(found).alias("marker")).groupBy(by, "marker").agg(F.count("*").alias("n"))
    often = Window.partitionBy(by).orderBy(F.desc("n"), "marker")
    return counts.withColumn("rank", F.row_number().over(often)).where(F.col("rank") <= top)


def boundaries(summary: DataFrame, subthemes: DataFrame, loose: float = 0.25) -> DataFrame:
    """Which remarks each theme's boundary calls for: it splits, has counter-cases,
    rests on few participants, is loose."""
    parts = subthemes.groupBy("theme_id").agg(F.count("*").alias("parts"))
    told = summary.join(parts, "theme_id", "left").fillna(0, ["parts"])
    remarks = F.array(
        F.when(F.col("parts") >= 2, F.concat(F.lit("splits into "), F.col("parts").cast("string"))),
        F.when(F.col("negative_cases") > 0, F.concat(F.col("negative_cases").cast("string"), F.lit(" counter-cases"))),
        F.when(F.col("participants") <= 2, "few participants"), F.when(F.col("cohesion") < loose, "loose"),
    )
    kept = F.filter(remarks, lambda x: x.isNotNull())
    return told.select("theme_id", F.when(F.size(kept) > 0, F.array_join(kept, "; ")).otherwise("stable").alias("boundary"))


def phases(facts: dict[str, DataFrame]) -> DataFrame:
    """How much each step of an analysis made: (step, n) from named tables."""
    out = None
    for step, df in facts.items():
        line = df.agg(F.lit(step).alias("step"), F.count("*").alias("n"))
        out = line if out is None else out.unionByName(line)
    return out
