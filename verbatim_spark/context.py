"""The library's front door: controls, and engines that return named tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicons as lx
from .functions import text as tx
from .functions.kept import keep
from .functions.shipping import ship
from .methodologies import METHODOLOGIES, Context
from .operators import coding, corpus, methods, readings, themes, vectors
from .operators import reviews as rv
from .sources import reviews as ingest


@dataclass(frozen=True)
class Controls:
    """Analytic controls, put within their bounds."""

    similarity: float = 0.28
    confidence: float = 0.55
    min_quotes: int = 3
    participant_threshold: int = 2
    granularity: str = "sentence"
    sensitivity: float = 0.5

    def __post_init__(self):
        bounds = {"similarity": (0.05, 0.95), "confidence": (0.0, 1.0), "min_quotes": (1, 50), "participant_threshold": (1, 50), "sensitivity": (0.0, 1.0)}
        for name, (low, high) in bounds.items():
            object.__setattr__(self, name, min(high, max(low, getattr(self, name))))
        if self.granularity not in ("clause", "sentence", "utterance"):
            raise ValueError("granularity is clause, sentence or utterance")


Reading = Callable[[DataFrame], DataFrame]
#: Readings of codes (participant, ord, theme_id, valence, confidence, ...); add your own.
READINGS: dict[str, Reading] = {
    "narrative_plot": readings.plot_shape, "turning_points": readings.turning_points,
    "group_convergence": readings.convergence, "negative_cases": readings.contrary_valence,
}


def coded_units(units: DataFrame, unit: str = "unit_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(codes, idf, concepts) of units: coded, named by salient phrases, then by what
    recurs over the corpus. Codes have stems of content words, label, open_label,
    phrase, concept, emotion, mood, intent, valence, confidence, alternatives."""
    coded = keep(coding.code_units(units).withColumn("stems", tx.stems(tx.content_tokens(F.col("text")))), "coded")
    stems = coded.select(F.col(unit).alias("doc"), F.explode("stems").alias("term"))
    idf = keep(vectors.idf_table(stems, coded.agg(F.count("*").alias("n"))), "idf")
    by_stem = idf.select(F.col("term").alias("stem"), "idf")
    named = coding.salient_phrases(coding.phrase_candidates(coded, by_stem, corpus.phrase_frequency(coded, unit), unit), unit)
    codes = coded.join(named.select(unit, "phrase"), unit, "left").fillna("this account", ["phrase"])
    codes = codes.withColumns({
        "confidence": coding.confidence(F.size(F.split("phrase", " "))), "label": coding.label(F.col("phrase")), "alternatives": coding.alternatives(), "mood": F.col("emotion"),
    })
    related = keep(vectors.co_occurrence(stems.distinct()), "related")
    strength = related.groupBy(F.col("a").alias("term")).agg(F.round(F.sum("strength"), 6).alias("strength"))
    concepts = vectors.concept_space(related, strength).withColumn("concept", F.concat(F.lit("c:"), F.col("concept")))
    codes = coding.consolidate(codes, by_stem, concepts)
    return keep(codes, "codes"), idf, concepts


class Engine:
    """Analysis of documents (document_id, text, optionally participant)."""

    def __init__(self, spark: SparkSession, controls: Controls = Controls()):
        ship(spark)
        self.spark, self.controls = spark, controls

    def context(self, documents: DataFrame) -> tuple[Context, dict[str, DataFrame]]:
        """Turns, units, codes, vectors and themes. Codes, vectors and clusters are
        kept in the shared folder, from where all readings take them."""
        controls = self.controls
        turns = corpus.question_context(corpus.split_turns(documents))
        units = corpus.units(turns, controls.granularity).withColumn("unit_id", F.sha2(F.concat_ws(":", "document_id", "turn_idx", "idx"), 256))
        codes, idf, concepts = coded_units(units)
        codes = codes.withColumns({"id": F.col("unit_id"), "participant": F.coalesce("speaker", F.col("document_id").cast("string")), "ord": F.col("turn_idx") * 100000 + F.col("idx")})
        return self.themes(codes, units, idf, concepts, {"turns": turns, "units": units})

    def themes(self, codes: DataFrame, units: DataFrame, idf: DataFrame, concepts: DataFrame | None, tables: dict[str, DataFrame]) -> tuple[Context, dict[str, DataFrame]]:
        """Themes of codes, also of stored ones: vectors over terms and concepts,
        clusters refined and cut where they hold too much, names, statuses, terms."""
        controls = self.controls
        weights = keep(vectors.code_vectors(vectors.code_terms(codes), idf, concepts), "vectors")
        nodes = codes.select("id", F.lit("all").alias("within"))
        members = keep(vectors.cluster_copies(weights, nodes, controls.similarity), "members")
        facts = vectors.sparse_cohesion(weights, members).select(F.col("cluster").alias("theme_id"), "cohesion")
        placed = codes.drop("theme_id", "cohesion").join(members.select(F.col("doc").alias("id"), F.col("cluster").alias("theme_id")), "id").join(facts, "theme_id")
        summary = readings.theme_summary(placed, "participant", controls.min_quotes, controls.participant_threshold, controls.confidence).join(facts, "theme_id")
        some = placed.join(summary.select("theme_id"), "theme_id", "left_semi")
        names = themes.name_themes(
            some.select("theme_id", F.col("id").alias("member"), F.explode(F.array_distinct(F.split("phrase", " "))).alias("word")),
            some.select(F.explode(F.split("phrase", " ")).alias("word")).distinct().withColumn("term", tx.stem(F.col("word"))).join(idf, "term").select("word", "idf"),
            some.where(F.size(F.split("phrase", " ")) > 1).select("theme_id", "phrase"),
        )
        described = summary.join(names, "theme_id").join(themes.describe(some), "theme_id").drop("participants").join(summary.select("theme_id", "participants"), "theme_id")
        told = keep(described.withColumn("ord", F.struct((-F.col("members")).alias("n"), F.col("theme_id"))), "themes")
        out = keep(placed.join(told.select("theme_id", F.lit(True).alias("_is")), "theme_id", "left").withColumn("theme_id", F.when(F.col("_is"), F.col("theme_id"))).drop("_is"), "placed")
        inside = members.join(told.select(F.col("theme_id").alias("cluster")), "cluster", "left_semi")
        centers = keep(vectors.normalise(weights.join(inside, "doc").select(F.col("cluster").alias("doc"), "term", "weight")), "centroids")
        a, b = centers.select(F.col("doc").alias("a"), "term", F.col("weight").alias("x")), centers.select(F.col("doc").alias("b"), "term", F.col("weight").alias("y"))
        similar = a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("sim"))
        terms = vectors.top_terms(centers, 8).select(F.col("doc").alias("theme_id"), "rank", "term")
        context = Context(out, units, idf, weights, told, terms, keep(similar, "similar"), controls)
        themed = out.where("theme_id IS NOT NULL")
        pairs = themed.select("id", "theme_id", "participant", "valence")
        apart = vectors.sparse_edges(weights.join(themed.select(F.col("id").alias("doc"), F.col("theme_id").alias("within")), "doc"), 0.34 - 0.14 * controls.sensitivity)
        return context, {
            **tables, "codes": out, "idf": idf, "themes": told.drop("ord"), "members": themed.select(F.col("id").alias("unit_id"), "theme_id"),
            "contradictions": vectors.contradictions(pairs, apart, controls.sensitivity),
            "opposed_themes": vectors.opposed_themes(context.similar, told.select("theme_id", F.col("mean_valence").alias("mean"))),
            "merge_suggestions": themes.merge_suggestions(context.similar, terms, controls.similarity),
            **{name: f(themed) for name, f in READINGS.items()},
        }

    def analyse(self, documents: DataFrame, methodologies: Sequence[str] = ()) -> dict[str, DataFrame]:
        """Tables of an analysis, and of the methodologies named, as ``name.table``."""
        context, tables = self.context(documents)
        for name in methodologies:
            tables |= {f"{name}.{table}": df for table, df in METHODOLOGIES[name](context).items()}
        return tables

    def suggest_merges(self, codes: DataFrame) -> DataFrame:
        """Themes that may be one, from stored codes (id, theme_id, stems, phrase, mood,
        intent): idf, concepts and vectors are made anew, the themes are as stored."""
        stems = codes.select(F.col("id").alias("doc"), F.explode("stems").alias("term"))
        idf = vectors.idf_table(stems, codes.agg(F.count("*").alias("n")))
        weights = vectors.code_vectors(vectors.code_terms(codes), idf)
        placed = weights.join(codes.where("theme_id IS NOT NULL").select(F.col("id").alias("doc"), "theme_id"), "doc")
        centers = keep(vectors.normalise(placed.select(F.col("theme_id").alias("doc"), "term", "weight")), "centroids")
        a, b = centers.select(F.col("doc").alias("a"), "term", F.col("weight").alias("x")), centers.select(F.col("doc").alias("b"), "term", F.col("weight").alias("y"))
        similar = a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("sim"))
        terms = vectors.top_terms(centers, 8).select(F.col("doc").alias("theme_id"), "term")
        return themes.merge_suggestions(similar, terms, self.controls.similarity)


class ReviewEngine:
    """Analysis of reviews."""

    def analyse(self, reviews: DataFrame) -> dict[str, DataFrame]:
        """Indicators of reviews whose valence is known (review_id, business, rating,
        valence, months, responded)."""
        blended = rv.blended_sentiment(F.col("valence"), F.col("rating"))
        rows = reviews.withColumns({"sentiment": rv.sentiment_label(blended), "bucket": rv.bucket_for(F.col("months"))})
        return {
            "kpis": rv.kpis(rows), "temporal": rv.temporal_buckets(rows), "trend": rv.trend(rows), "bands": rv.bands(rows), "direction": rv.band_direction(rv.bands(rows)),
            "rating_vs_text": rv.rating_vs_text(rows), "ranking": rv.ranking(rv.kpis(rows), "business"),
        }

    def read(self, raw: DataFrame, now: str) -> DataFrame:
        """Reviews from pasted text of any known format (business, raw)."""
        return ingest.read_any(raw, now)

    def report(self, reviews: DataFrame, mine: str | None = None, theirs: str | None = None) -> dict[str, DataFrame]:
        """All tables of a report on reviews (review_id, business, reviewer, rating,
        text, months, owner_response): statements are coded, and valence, categories,
        stages, complaints and scores come from the codes. With ``mine``, also how that
        business stands among the others, and against ``theirs``."""
        ship(reviews.sparkSession)
        rows = reviews.select("review_id", "business", F.coalesce("reviewer", F.col("review_id").cast("string")).alias("reviewer"), F.col("rating").cast("double").alias("rating"), "text", "months", F.col("owner_response").isNotNull().alias("responded"))
        turns = rows.select(F.concat_ws(":", "business", "review_id").alias("document_id"), "review_id", "business", "reviewer", "rating", "months", F.lit(0).alias("turn_idx"), tx.normalise(F.col("text")).alias("text"))
        units = corpus.units(turns).withColumn("unit_id", F.sha2(F.concat_ws(":", "document_id", "idx"), 256))
        codes, idf, concepts = coded_units(units)
        codes = codes.withColumns({
            "id": F.col("unit_id"), "bucket": rv.bucket_for(F.col("months")), "friction": tx.cue_hits(F.col("text"), lx.FRICTION), "sentiment": rv.sentiment_label(F.col("valence")),
            "category": tx.argmax({n: tx.cue_hits(F.col("text"), cues) for n, cues in lx.REVIEW_CATEGORIES.items()}, "General service"), "example": F.col("text"),
        })
        told = codes.groupBy("business", "review_id").agg(F.avg("valence").alias("valence"))
        whole = rows.join(told, ["business", "review_id"], "left").withColumn("valence", F.coalesce("valence", F.lit(0.0)))
        whole = whole.withColumn("sentiment_score", rv.blended_sentiment(F.col("valence"), F.col("rating")))
        whole = keep(whole.withColumns({"sentiment": rv.sentiment_label(F.col("sentiment_score")), "bucket": rv.bucket_for(F.col("months"))}), "reviews")
        content = methods.index(codes.drop("category"), lx.REVIEW_CATEGORIES)
        stages = methods.index(codes.drop("category"), lx.JOURNEY_STAGES).withColumnRenamed("category", "stage")
        dimensions = methods.index(codes.drop("category"), lx.REVIEW_DIMENSIONS).withColumnRenamed("category", "dimension")
        scores = rv.dimension_scores(dimensions, whole, "business", "dimension", names=list(lx.REVIEW_DIMENSIONS))
        counts = content.groupBy("business", "category").agg(F.count("*").alias("mentions"), F.countDistinct("review_id").alias("reviews"), F.round(F.avg("valence"), 6).alias("mean_valence"))
        kpis = rv.kpis(whole)
        proposed, placed = themes.candidate_themes(codes, idf, concepts, whole)
        worst = rv.bottlenecks(codes, "category", whole)
        contradicted = rv.rating_vs_text(whole)
        tables = {
            "reviews": whole, "codes": codes, "kpis": kpis, "temporal": rv.temporal_buckets(whole), "trend": rv.trend(whole), "bands": rv.bands(whole), "direction": rv.band_direction(rv.bands(whole)),
            "content": counts, "journey": rv.journey(stages, "reviewer", "stage"), "synthesis": rv.synthesis(stages, "reviewer", "stage"), "bottlenecks": worst, "issues": rv.issue_phrases(codes, "category"),
            "dimensions": scores, "rating_vs_text": contradicted, "themes": proposed, "theme_poles": rv.theme_poles(placed), "ranking": rv.ranking(kpis, "business"),
            "findings": themes.key_findings(worst, counts.groupBy("category").agg(F.sum("mentions").alias("mentions"), F.round(F.sum(F.col("mean_valence") * F.col("mentions")) / F.sum("mentions"), 6).alias("mean_valence")), contradicted, kpis),
            "summary": themes.codes_summary(codes),
        }
        if mine:
            tables |= {"matrix": rv.matrix(scores, mine, "business", "dimension"), "adoption": rv.adoption(scores, counts, mine, "business", "dimension", "category")}
        if mine and theirs:
            tables |= {"comparison": rv.compare(scores, mine, theirs, "business", "dimension"), "kpi_delta": rv.kpi_delta(kpis, mine, theirs, "business")}
        return tables
