"""Six readings of one analysis, each a function from its context to named tables.

A context holds tables: codes (id, participant, ord, document_id, theme_id, text,
stems, label, phrase, mood, intent, valence, confidence, alternatives, cohesion),
units, idf (term, idf), vectors (doc, term, weight), themes (theme_id, name, ord and
the columns of a theme's summary) and terms (theme_id, rank, term), the first terms
of each theme's centroid. Nothing is computed until a table is read, but for
clusterings, which keep their rounds in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import lexicons as lx
from .functions import text as tx
from .operators import corpus, methods, readings, themes, vectors


@dataclass
class Context:
    codes: DataFrame
    units: DataFrame
    idf: DataFrame
    vectors: DataFrame
    themes: DataFrame
    terms: DataFrame
    similar: DataFrame
    controls: Any


Tables = dict[str, DataFrame]


def thematic(c: Context) -> Tables:
    """Reflexive thematic analysis: themes with their parts, boundaries, defining
    quotes and counter-cases; the map; key stems; what each phase made."""
    cut = min(0.85, c.controls.similarity + 0.22)
    placed = c.codes.where("theme_id IS NOT NULL").select(F.col("id"), F.col("theme_id").alias("within"))
    large = placed.groupBy("within").agg(F.count("*").alias("n")).where("n >= 4").select("within")
    nodes = placed.join(large, "within", "left_semi")
    parts = vectors.cluster_copies(c.vectors, nodes, cut, 1).join(nodes.select(F.col("id").alias("doc"), F.col("within").alias("theme_id")), "doc")
    sizes = parts.groupBy("theme_id", "cluster").agg(F.count("*").alias("quotes")).withColumn("groups", F.count("*").over(Window.partitionBy("theme_id")))
    rank = F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("quotes"), "cluster"))
    subthemes = sizes.where("groups >= 2 AND quotes >= 2").withColumn("rank", rank).where("rank <= 5").select("theme_id", F.col("cluster").alias("subtheme"), "quotes", "rank")
    best = Window.partitionBy("theme_id").orderBy(F.desc("confidence"), "ord", "id")
    quotes = c.codes.where("theme_id IS NOT NULL").withColumn("r", F.row_number().over(best)).where("r = 1")
    means = c.themes.select("theme_id", F.col("mean_valence").alias("mean"))
    opposed = ((F.col("mean") < -0.1) & (F.col("valence") > 0.25)) | ((F.col("mean") > 0.1) & (F.col("valence") < -0.25))
    counter = c.codes.join(means, "theme_id").where(opposed).withColumn("rank", F.row_number().over(best)).where("rank <= 3")
    stems = c.codes.select(F.explode(F.array_distinct("stems")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n > 1")
    keyness = stems.join(c.idf, "term", "left").withColumn("keyness", F.round(F.col("n") * F.coalesce("idf", F.lit(1.0)), 2))
    return {
        "themes": c.themes, "subthemes": subthemes, "boundaries": methods.boundaries(c.themes, subthemes),
        "defining_quotes": quotes.select("theme_id", "participant", tx.truncate(F.col("text"), 320).alias("quote"), "confidence"),
        "counter_cases": counter.select("theme_id", "participant", "rank", tx.truncate(F.col("text"), 220).alias("quote")),
        "map": themes.map_edges(c.similar, c.controls.similarity), "keyness": keyness.orderBy(F.desc("keyness"), "term").limit(24).select("term", "n", "keyness"),
        "phases": methods.phases({"units": c.units, "codes": c.codes, "themes": c.themes, "confirmed themes": c.themes.where("status = 'confirmed'")}),
    }


def content(c: Context) -> Tables:
    """Content analysis: the scheme, counts by participant and category, the latent
    layer, manifest words, keywords in context, reliability."""
    own = methods.content_index(c.codes, lx.CONTENT_CATEGORIES).withColumn("type", F.lit("a priori"))
    more = methods.emergent(c.themes, c.terms, 5)
    found = own.unionByName(methods.index_emergent(c.codes, more).withColumn("type", F.lit("emergent")))
    fixed = c.codes.sparkSession.createDataFrame([(n, list(t)) for n, t in lx.CONTENT_CATEGORIES.items()], "category string, terms array<string>")
    words = corpus.word_frequency(c.units, "unit_id", top=200)
    return {
        "scheme": fixed.withColumn("type", F.lit("a priori")).unionByName(more.withColumn("type", F.lit("emergent"))),
        "matrix": methods.content_matrix(found), "latent": methods.latent_layer(found), "manifest": corpus.manifest(c.units),
        "manifest_terms": methods.manifest_terms(words), "concordance": methods.key_lines(c.units, words, "unit_id"),
        "reliability": readings.reliability(c.codes.withColumn("alternatives", F.size("alternatives")), F.col("theme_id").isNotNull()),
    }


def framework(c: Context) -> Tables:
    """Framework analysis: codes indexed by dimensions and themes, the matrix, patterns
    down its columns, gaps, and what each stage made."""
    more = methods.emergent(c.themes, c.terms, 6)
    indexed = methods.index(c.codes, lx.FRAMEWORK_DIMENSIONS).withColumn("source", F.lit("a priori"))
    indexed = indexed.unionByName(methods.index_emergent(c.codes, more).withColumn("source", F.lit("emergent"))).withColumn("example", F.col("id"))
    rows = c.codes.select("participant").distinct()
    found = readings.cells(indexed, "participant", "category")
    return {
        "index": indexed.select("id", "participant", "category", "source", "score"), "chart": readings.chart(indexed, "participant", "category"),
        "mapping": readings.mapping(found, rows, "category"), "gaps": readings.gaps(found, rows, "category"),
        "stages": methods.phases({"documents": c.codes.select("document_id").distinct(), "units": c.units, "emergent categories": more, "assignments": indexed, "filled cells": found}),
    }


def grounded_theory(c: Context) -> Tables:
    """Grounded theory: open codes, in-vivo codes, axial categories with the paradigm's
    evidence, properties and dimensions, the core category, saturation, comparisons."""
    grouped = themes.axial_groups(c.similar, c.themes.select("theme_id", "coverage"), c.controls.similarity)
    coded = c.codes.join(grouped, "theme_id")
    evidence = methods.paradigm(coded, lx.GT_PARADIGM)
    density = evidence.groupBy("category").agg(F.count("*").alias("density"))
    reach = coded.groupBy("category").agg(F.count("*").alias("codes"), F.countDistinct("participant").alias("participants"))
    facts = grouped.join(c.themes.select("theme_id", "coverage"), "theme_id").groupBy("category").agg(F.count("*").alias("themes"), F.round(F.sum("coverage"), 4).alias("centrality"))
    axial = facts.join(reach, "category").join(density, "category", "left").fillna(0, ["density"])
    return {
        "open_codes": methods.open_coding(c.codes), "in_vivo": methods.in_vivo(c.codes), "axial": axial, "paradigm": evidence,
        "properties": readings.properties(coded.drop("theme_id").withColumnRenamed("category", "theme_id"), "phrase"),
        "core": readings.core_category(axial.withColumnRenamed("category", "theme_id")),
        "saturation": readings.saturation(c.codes.withColumn("item", F.col("phrase"))),
        "comparison": themes.constant_comparison(c.similar, c.themes),
    }


def experiential(c: Context) -> Tables:
    """Interpretative phenomenological analysis: each case's own themes first, its
    statements and profile, then the themes of the group."""
    cut = max(0.3, c.controls.similarity)
    nodes = c.codes.select("id", F.col("participant").alias("within"))
    grouped = vectors.cluster_copies(c.vectors, nodes, cut, 1).join(c.codes.select(F.col("id").alias("doc"), "participant", "phrase"), "doc")
    sizes = grouped.groupBy("participant", "cluster").agg(F.count("*").alias("statements"), F.mode("phrase", deterministic=True).alias("phrase")).where("statements >= 2")
    rank = F.row_number().over(Window.partitionBy("participant").orderBy(F.desc("statements"), "cluster"))
    dims = themes.experiential_dimensions(F.col("text"), lx.IPA_DIMENSIONS)
    first = F.coalesce(F.get(dims, F.lit(0)), F.lit("experiential"))
    note = themes.linguistic_note(F.col("text"), lx.HEDGES, lx.NEGATORS, lx.INTENSIFIERS)
    return {
        "personal_themes": sizes.withColumn("rank", rank).where("rank <= 6").select("participant", "rank", tx.titlecase(F.col("phrase")).alias("name"), "statements"),
        "statements": methods.statements(c.codes, first, note), "cases": methods.case_summary(c.codes, dims), "profile": methods.dimension_profile(c.codes, dims),
        "group_themes": readings.convergence(c.codes.where("theme_id IS NOT NULL")),
    }


def narrative(c: Context) -> Tables:
    """Narrative analysis: parts of each story, its turns, agency, plot and marks of
    time, and what the stories have in common."""
    hits = {name: tx.cue_hits(F.col("text"), lx.NARRATIVE_CUES[name]) for name in readings.LABOV}
    told = readings.labov_elements(readings.relative_position(c.codes), hits)
    shapes, turns = readings.plot_shape(c.codes), readings.turning_points(c.codes)
    agency = readings.agency(methods.agency_counts(c.codes, lx.AGENCY_ACTIVE, lx.AGENCY_PASSIVE))
    return {
        "arc": told.groupBy("participant", "element").agg(F.count("*").alias("n")), "turning_points": turns, "agency": agency, "plots": shapes,
        "temporal_markers": methods.temporal_markers(c.codes, lx.TEMPORAL_MARKERS), "cross": methods.narrative_cross(shapes, agency, turns),
    }


#: Readings by name; add your own.
METHODOLOGIES: dict[str, Callable[[Context], Tables]] = {
    "thematic": thematic, "content": content, "framework": framework, "grounded_theory": grounded_theory, "experiential": experiential, "narrative": narrative,
}
