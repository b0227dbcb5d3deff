"""Workbooks as named tables, one a sheet, from what the engines return. They stay
tables until ``sinks.workbook`` writes those that fit a sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import prose

Tables = dict[str, DataFrame]


def project_sheets(tables: Tables, controls) -> Tables:
    """An analysis with its readings: at most twelve sheets, those whose tables there are."""
    spark = tables["codes"].sparkSession
    facts = [(k, str(v)) for k, v in vars(controls).items()]
    names = tables["themes"].select("theme_id", "name")
    codes = tables["codes"].join(names, "theme_id", "left")
    out = {
        "Project": spark.createDataFrame(facts, "control string, value string"),
        "Themes": tables["themes"].select("name", "status", "confidence", "coverage", "participants", "members", "mood", "phrases", "mean_valence"),
        "Codes": codes.select("label", F.coalesce("name", F.lit("")).alias("theme"), "participant", "emotion", "intent", "valence", "confidence", "text", "literal_meaning", F.array_join("alternatives", " | ").alias("alternatives")),
        "Contradictions": tables["contradictions"].join(names, "theme_id").select("name", "severity", "gap", "i", "j"),
        "Codebook": codes.groupBy("label").agg(F.count("*").alias("groundedness"), F.countDistinct("participant").alias("cases"), F.countDistinct("theme_id").alias("themes")),
        "Merge suggestions": tables["merge_suggestions"], "Turning points": tables["turning_points"], "Negative cases": tables["negative_cases"].select("theme_id", "participant", "text", "valence", "mean"),
    }
    more = {"Framework matrix": "framework.chart", "Content counts": "content.matrix", "Quotations": "thematic.defining_quotes", "Saturation": "grounded_theory.saturation"}
    return out | {sheet: tables[name] for sheet, name in more.items() if name in tables}


def review_sheets(report: Tables) -> Tables:
    """A review report: twelve sheets, and those of the comparison if there is one."""
    codes = report["codes"]
    out = {
        "Codebook": codes.select("label", "business", "reviewer", "rating", "emotion", "intent", "valence", "sentiment", "confidence", "text", "literal_meaning", "bucket"),
        "Themes": report["themes"], "Contradictions": report["rating_vs_text"], "Theme poles": report["theme_poles"], "Content counts": report["content"], "Framework matrix": report["journey"],
        "Framework synthesis": report["synthesis"], "Bottlenecks": report["bottlenecks"].join(report["issues"], "category", "left"), "Temporal": report["temporal"], "Trend": report["trend"],
        "Reviews": report["reviews"], "Dashboard": report["kpis"], "Dimensions": report["dimensions"],
    }
    return out | {name.capitalize().replace("_", " "): report[name] for name in ("comparison", "matrix", "adoption", "kpi_delta") if name in report}


def codebook_sheets(codes: DataFrame, themes: DataFrame, contradictions: DataFrame, audit: DataFrame) -> Tables:
    """Themes, codes, quotations, confidence with contradictions per theme, audit log:
    codes (theme_id, label, participant, text, ...), themes (theme_id, name, ...)."""
    counts = contradictions.groupBy("theme_id").agg(F.count("*").alias("contradictions"))
    named = codes.join(themes.select("theme_id", F.col("name").alias("theme")), "theme_id", "left")
    return {
        "Themes": themes, "Codes": named.drop("theme_id"), "Quotations": named.where("theme IS NOT NULL").select("theme", "participant", "text", "label"),
        "Confidence scores": themes.join(counts, "theme_id", "left").fillna(0, ["contradictions"]).select("name", "confidence", "coverage", "contradictions"), "Audit log": audit,
    }


def report_blocks(tables: Tables, top: int = 12) -> DataFrame:
    """A report's text (ord, heading, body): a paragraph for each of the first themes,
    from its numbers, and one for what contradicts."""
    themes = tables["themes"].orderBy(F.desc("members"), "theme_id").limit(top)
    body = F.format_string(
        "%d quotations from %d participants (%s); the account is %s. Status: %s. Phrases: %s.",
        "members", "participants", F.concat(F.bround(F.col("coverage") * 100).cast("int").cast("string"), F.lit("% of codes")), prose.tone(F.col("mean_valence")), "status", F.coalesce("phrases", F.lit("none")),
    )
    place = F.row_number().over(Window.orderBy(F.desc("members"), "theme_id"))  # at most ``top`` rows
    blocks = themes.select(place.alias("ord"), tx.titlecase(F.col("name")).alias("heading"), body.alias("body"))
    said = tables["contradictions"].agg(F.count("*").alias("n"), F.round(F.max("severity"), 2).alias("s"))
    last = said.select(F.lit(top + 1).alias("ord"), F.lit("Contradictions").alias("heading"), F.format_string("%d pairs of quotations contradict each other; the sharpest has severity %s.", "n", F.coalesce(F.col("s").cast("string"), F.lit("none"))).alias("body"))
    return blocks.unionByName(last)


def demo_reviews(spark) -> DataFrame:
    """Written for demonstrations: pasted lines of two invented businesses (business, raw)."""
    mill = [
        "5 | Warm welcome, the soup was excellent and the staff were kind (3 days ago)", "4 | Good value and clean rooms, but parking is difficult (2 weeks ago)",
        "2 | We waited forty minutes and nobody explained the delay (3 weeks ago)", "1 | Double booked, rude reply on the phone and no apology (1 month ago)",
        "5 | They sorted our problem the same day, would recommend (2 months ago)", "3 | Food was fine, the queue was slow and the till was broken (4 months ago)",
        "5 | Five stars for the cakes although the table was dirty and the service was awful (5 months ago)", "2 | Overcharged and ignored when we asked for the bill (7 months ago)",
        "4 | Friendly team, easy to find, a little expensive (9 months ago)", "1 | Cold food again, never again (14 months ago)",
    ]
    barn = [
        "5 | Booking was quick and the staff were helpful from the start (1 week ago)", "5 | Spotless room, comfortable bed, great price (1 month ago)",
        "4 | Lovely breakfast and a clear explanation of the trails (2 months ago)", "3 | The heating was noisy but they fixed it (6 months ago)",
        "5 | Best value in the valley, we will return (8 months ago)", "2 | Late check-in and a long wait for the keys (13 months ago)",
    ]
    return spark.createDataFrame([("The Mill", "\n".join(mill)), ("The Barn", "\n".join(barn))], "business string, raw string")
