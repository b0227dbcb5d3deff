"""Themes: naming, suggestions, axial grouping and what a report says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import vectors
from .vectors import leader_clusters


def name_themes(words: DataFrame, idf: DataFrame, pairs: DataFrame) -> DataFrame:
    """A name for each theme from (theme_id, word) rows, one a member: the word
    with the highest salience - the share of members against how common it is,
    raised by its count - or the most frequent phrase with that word (theme_id,
    phrase). Names that fall together are numbered in order of theme."""
    counts = words.groupBy("theme_id", "word").agg(F.count("*").alias("c"))
    sizes = words.groupBy("theme_id").agg(F.countDistinct("member").alias("size"))
    scored = counts.join(sizes, "theme_id").join(idf, "word", "left").withColumn(
        "salience", F.round(F.col("c") / F.col("size") / (1 / F.coalesce("idf", F.lit(1.0)) + 0.02) * (1 + 0.5 * (F.col("c") - 1)), 6)
    )
    best = scored.groupBy("theme_id").agg(F.max_by("word", F.struct("salience", "word")).alias("word"))
    phrases = pairs.groupBy("theme_id", "phrase").agg(F.count("*").alias("n"))
    holding = phrases.join(best, "theme_id").where(F.array_contains(F.split("phrase", " "), F.col("word")))
    top = holding.groupBy("theme_id").agg(F.max_by("phrase", F.struct("n", "phrase")).alias("phrase"))
    named = best.join(top, "theme_id", "left").select("theme_id", tx.titlecase(F.coalesce("phrase", "word")).alias("name"))
    nth = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("theme_id"))
    return named.withColumn("nth", nth).select(
        "theme_id", F.when(F.col("nth") > 1, F.concat("name", F.lit(" ("), F.col("nth").cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("name")
    )


def describe(codes: DataFrame, top: int = 4) -> DataFrame:
    """The facts of a description: prevailing mood if a quarter share it, the most
    frequent intent, the most frequent phrases, and whether few participants carry
    the theme."""
    intents = codes.groupBy("theme_id", "intent").agg(F.count("*").alias("k")).groupBy("theme_id").agg(F.max_by("intent", F.struct("k", "intent")).alias("intent"))
    moods = codes.groupBy("theme_id", "mood").agg(F.count("*").alias("k"))
    best = moods.groupBy("theme_id").agg(F.max_by("mood", F.struct("k", "mood")).alias("mood"), F.max("k").alias("most"), F.sum("k").alias("n"))
    counts = codes.groupBy("theme_id", "phrase").agg(F.count("*").alias("k"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("k"), "phrase"))).where(F.col("rank") <= top)
    listed = ranked.groupBy("theme_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]), ", ").alias("phrases"))
    reach = codes.groupBy("theme_id").agg(F.countDistinct("participant").alias("participants"))
    return best.join(listed, "theme_id").join(reach, "theme_id").join(intents, "theme_id").select(
        "theme_id", F.when(F.col("most") >= 0.25 * F.col("n"), F.col("mood")).alias("mood"), "intent", "phrases", "participants", (F.col("participants") <= 2).alias("narrow")
    )


def merge_suggestions(similar: DataFrame, terms: DataFrame, threshold: float, top: int = 12) -> DataFrame:
    """Themes (a, b, sim) that may be one: similar to 0.62 of the threshold, or
    with three or more of their top terms (theme_id, term) in common."""
    left, right = terms.select(F.col("theme_id").alias("a"), "term"), terms.select(F.col("theme_id").alias("b"), "term")
    shared = left.join(right, "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    met = similar.join(shared, ["a", "b"], "full").fillna(0, ["sim", "shared"])
    kept = met.where((F.col("sim") >= round(0.62 * threshold, 6)) | (F.col("shared") >= 3))
    return kept.select("a", "b", F.col("sim").cast("double").alias("sim"), "shared").orderBy(F.desc("sim"), F.desc("shared"), "a", "b").limit(top)


def map_edges(similar: DataFrame, threshold: float) -> DataFrame:
    """The thematic map: themes similar to half the threshold."""
    return similar.where(F.col("sim") >= 0.5 * threshold)


def constant_comparison(similar: DataFrame, order: DataFrame, first: int = 6, least: float = 0.08, top: int = 8) -> DataFrame:
    """Pairs among the first themes in order (theme_id, ord), most alike first."""
    early = order.orderBy("ord").limit(first).select("theme_id")
    both = similar.join(early.withColumnRenamed("theme_id", "a"), "a", "left_semi").join(early.withColumnRenamed("theme_id", "b"), "b", "left_semi")
    return both.where(F.col("sim") >= least).orderBy(F.desc("sim"), "a", "b").limit(top)


def axial_groups(similar: DataFrame, themes: DataFrame, threshold: float) -> DataFrame:
    """(theme_id, category): leader clusters of themes (theme_id, coverage) with alike
    centroids (a, b, sim), the widest theme first."""
    edges = similar.where(F.col("sim") >= max(0.14, 0.5 * threshold)).select(F.col("a").alias("i"), F.col("b").alias("j"), "sim")
    nodes = themes.select(F.col("theme_id").alias("id"), F.struct((-F.col("coverage")).alias("c"), "theme_id").alias("ord"))
    return leader_clusters(nodes, edges).withColumnsRenamed({"id": "theme_id", "leader": "category"})


def axial(similar: DataFrame, themes: DataFrame, threshold: float) -> DataFrame:
    """Categories of themes; centrality is the members' coverage."""
    grouped = axial_groups(similar, themes, threshold).join(themes, "theme_id")
    return grouped.groupBy("category").agg(F.count("*").alias("themes"), F.round(F.sum("coverage"), 6).alias("centrality"))


def subthemes(members: DataFrame, edges: DataFrame, least_group: int = 2, top: int = 5) -> DataFrame:
    """Leader clusters inside each theme: (id, theme_id, ord) and edges (i, j, sim)
    at the stricter threshold. Themes with one group have no subthemes."""
    side = lambda end: members.select(F.col("id").alias(end), F.col("theme_id").alias(f"t{end}"))
    inside = edges.join(side("i"), "i").join(side("j"), "j").where("ti = tj").select("i", "j")
    grouped = leader_clusters(members, inside).join(members.select("id", "theme_id"), "id")
    sizes = grouped.groupBy("theme_id", "leader").agg(F.count("*").alias("size")).where(F.col("size") >= least_group)
    per = Window.partitionBy("theme_id")
    ranked = sizes.withColumns({"groups": F.count("*").over(per), "rank": F.row_number().over(per.orderBy(F.desc("size"), "leader"))})
    return ranked.where((F.col("groups") >= 2) & (F.col("rank") <= top)).select("theme_id", F.col("leader").alias("subtheme"), "size", "rank")


def experiential_dimensions(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """Dimensions of a text by how many cues it contains (anywhere, also inside
    words), most first, later names first among equals."""
    low = F.lower(text)
    scores = [F.struct(sum((low.contains(c).cast("int") for c in cues), F.lit(0)).alias("hits"), F.lit(name).alias("name")) for name, cues in lexicon.items()]
    found = F.filter(F.array(*scores), lambda x: x["hits"] > 0)
    return F.transform(F.reverse(F.array_sort(found)), lambda x: x["name"])


def linguistic_note(text: Column, hedges: list[str], negators: list[str], strong: list[str]) -> Column:
    """Marks of how a thing is said."""
    words = F.split(F.lower(text), r"\s+")
    has = lambda ws: F.arrays_overlap(words, tx.strings(sorted(ws)))
    notes = F.array(
        F.when(has(hedges), "hedged"), F.when(has(negators), "negated"), F.when(has(strong), "emphatic"), F.when(F.regexp_count(text, F.lit(",")) >= 3, "accumulating"),
        F.when(has(["i"]) & has(["they"]), "self against others"),
    )
    kept = F.filter(notes, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise("plain")


def key_findings(bottlenecks: DataFrame, categories: DataFrame, gaps: DataFrame, kpis: DataFrame, most: int = 6) -> DataFrame:
    """A report's first lines (ord, kind, subject, value), at most ``most``: the worst
    bottleneck, the most negative and most positive category with two or more
    mentions, star ratings that the text contradicts, and few owner responses."""
    heard = categories.where("mentions >= 2")
    line = lambda df, n, kind, subject, value: df.select(F.lit(n).alias("ord"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))
    found = line(bottlenecks.orderBy(F.desc("severity"), "category").limit(1), 1, "bottleneck", F.col("category"), F.col("severity"))
    low = heard.where("mean_valence <= -0.15").orderBy("mean_valence", "category").limit(1)
    high = heard.where("mean_valence >= 0.15").orderBy(F.desc("mean_valence"), "category").limit(1)
    found = found.unionByName(line(low, 2, "weakness", F.col("category"), F.col("mean_valence"))).unionByName(line(high, 3, "strength", F.col("category"), F.col("mean_valence")))
    many = gaps.agg(F.count("*").alias("n")).where("n > 0")
    found = found.unionByName(line(many, 4, "rating gap", F.lit("reviews"), F.col("n")))
    quiet = kpis.where("response_rate < 0.3").select("business", "response_rate")
    found = found.unionByName(line(quiet, 5, "few responses", F.col("business"), F.col("response_rate")))
    return found.orderBy("ord", "subject").limit(most)


def candidate_themes(codes: DataFrame, idf: DataFrame, concepts: DataFrame | None, reviews: DataFrame, threshold: float = 0.3, top: int = 12) -> tuple[DataFrame, DataFrame]:
    """Proposed themes of coded statements (id, reviewer, stems, phrase, valence,
    confidence, text): clusters of two or more, the ``top`` largest, with evidence,
    reach, means and a name; and the codes that are in them, with theme_id."""
    terms = codes.select(F.col("id").alias("doc"), F.explode(F.concat("stems", F.transform(F.split("phrase", " "), tx.stem))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    weights = vectors.keep(vectors.code_vectors(terms, idf, concepts), "vectors")
    members = vectors.keep(vectors.cluster_copies(weights, codes.select("id", F.lit("all").alias("within")), threshold), "members")
    placed = codes.join(members.select(F.col("doc").alias("id"), F.col("cluster").alias("theme_id")), "id")
    total = reviews.agg(F.greatest(F.count("*"), F.lit(1)).alias("_reviews"))
    facts = placed.groupBy("theme_id").agg(
        F.count("*").alias("evidence"), F.countDistinct("reviewer").alias("reviewers"), F.round(F.avg("valence"), 3).alias("mean_valence"), F.round(F.avg("confidence"), 3).alias("confidence"),
        F.mode("phrase", deterministic=True).alias("phrase"),
    ).where("evidence >= 2").orderBy(F.desc("evidence"), "theme_id").limit(top)
    facts = vectors.keep(facts, "candidates")
    told = facts.join(F.broadcast(total)).select(
        "theme_id", tx.titlecase(F.col("phrase")).alias("name"), "evidence", F.round(F.col("reviewers") / F.col("_reviews"), 3).alias("coverage"), "mean_valence", "confidence", F.lit("candidate").alias("status"),
    )
    return told, placed.join(facts.select("theme_id"), "theme_id", "left_semi")


def codes_summary(codes: DataFrame, top: int = 8) -> DataFrame:
    """(kind, name, value): codes, reviewers, mean confidence and the most frequent moods."""
    line = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))
    whole = codes.agg(F.count("*").alias("n"), F.countDistinct("reviewer").alias("r"), F.round(F.avg("confidence"), 3).alias("c"))
    moods = codes.groupBy("mood").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "mood").limit(top)
    counted = line(whole, "count", F.lit("codes"), F.col("n")).unionByName(line(whole, "count", F.lit("reviewers"), F.col("r"))).unionByName(line(whole, "mean", F.lit("confidence"), F.col("c")))
    return counted.unionByName(line(moods, "mood", F.col("mood"), F.col("k")))
