"""Ingest of reviews: parsing of pasted text, files and provider payloads, as
Column functions over rows of raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names under which a field may stand, best first.
ALIASES = {
    "rating": ["rating", "stars", "star", "score", "review_rating"],
    "text": ["text", "review", "review_text", "body", "comment", "content"],
    "reviewer": ["reviewer", "author", "author_title", "name", "user"],
    "when": ["when", "date", "relative_time", "review_datetime_utc", "published_at", "time"],
    "response": ["owner_response", "owner_answer", "response", "reply"],
    "photos": ["photo_count", "review_img_urls", "photos"],
}
_ATTRIBUTION = r"(?m)^[ \t]*\*?[ \t]*([^\s|*()][^\n|*()]{0,60}?)[ \t]*\(([^()\n]*(?:ago|yesterday|today))\)[ \t]*\*?[ \t]*$"
_DAYS = {"hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.44, "year": 365.25}
_DATES = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy"]


def strip_html(html: Column) -> Column:
    """Line breaks become lines, other tags of up to 40 characters blanks."""
    text = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    return F.regexp_replace(F.regexp_replace(text, "<[^<>]{1,40}>", " "), r"[ \t]+", " ")


def months_ago(when: Column, now: str) -> Column:
    """Age in months of 30.44 days: "2 weeks ago", "yesterday", a Unix time or a
    date (day first where both orders fit). Null if it can't be told."""
    low = F.lower(F.trim(when))
    amount = F.regexp_extract(low, r"^(?:about |over )?(an?|\d+)\s+(hour|day|week|month|year)s?\s+ago", 1)
    unit = F.regexp_extract(low, r"^(?:about |over )?(an?|\d+)\s+(hour|day|week|month|year)s?\s+ago", 2)
    days = F.create_map(*[F.lit(x) for kv in _DAYS.items() for x in kv])
    relative = F.when(unit != "", F.when(amount.isin("a", "an"), 1.0).otherwise(amount.try_cast("double")) * days[unit])
    simple = F.when(low.isin("today", "just now"), 0.0).when(low == "yesterday", 1.0)
    anchor = F.lit(now).cast("timestamp")
    stamp = F.when(low.rlike(r"^\d{9,11}$"), F.timestamp_seconds(low.try_cast("bigint")))
    dated = F.coalesce(stamp, *[F.try_to_timestamp(F.trim(when), F.lit(f)) for f in _DATES])
    since = (F.unix_timestamp(anchor) - F.unix_timestamp(dated)) / 86400.0
    return F.coalesce(simple, relative, F.when(since < 0, 0.0).otherwise(since)) / 30.44


def rating_of(raw: Column) -> Column:
    """4, 4.5 or 4/5."""
    return F.split_part(raw, F.lit("/"), F.lit(1)).try_cast("double")


def sniff(raw: Column) -> Column:
    """The format of pasted text: json, csv, block or lines."""
    head = F.regexp_extract(raw, r"^\s*([^\n]*)", 1)
    return (
        F.when(raw.rlike(r"^\s*[\[{]"), "json").when(head.contains(",") & F.lower(head).rlike(r"\b(rating|stars|review|text)\b"), "csv")
        .when(raw.rlike(r"(?m)^\s*\(Review \d+\)"), "block").when(F.regexp_count(raw, F.lit(_ATTRIBUTION)) >= 2, "attributed").otherwise("lines")
    )


def parse_lines(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """(rating, text, when) of lines such as ``5 | Lovely place (2 weeks ago)``."""
    line = F.explode(F.transform(F.split(text_col, "\r?\n"), lambda x: F.trim(x)))
    lines = raw.select(*[c for c in raw.columns if c != text_col], line.alias("_line")).where("_line <> ''")
    stars = F.regexp_extract("_line", r"^([0-5](?:\.\d)?)(?:/5)?\s*(?:\||stars?\b|★)\s*", 1)
    when = F.regexp_extract("_line", r"\(([^()]*(?:ago|yesterday|today))\)\s*$", 1)
    body = F.regexp_replace(F.regexp_replace("_line", r"^[0-5](?:\.\d)?(?:/5)?\s*(?:\||stars?\b|★)\s*", ""), r"\s*\([^()]*(?:ago|yesterday|today)\)\s*$", "")
    keep = [c for c in raw.columns if c != text_col]
    return lines.select(*keep, rating_of(F.nullif(stars, F.lit(""))).alias("rating"), F.trim(body).alias("text"), F.nullif(when, F.lit("")).alias("when")).where("text <> ''")


def parse_blocks(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """(reviewer, when, text) of ``(Review N)`` blocks with ``*Name (time)*``;
    bodies under three words go."""
    keep = [c for c in raw.columns if c != text_col]
    blocks = F.filter(F.split(text_col, r"(?m)^\s*\(Review \d+\)\s*$"), lambda b: b.rlike(r"\S"))
    each = raw.select(*keep, F.explode(blocks).alias("_b"))
    sign = r"(?m)^\s*\*\s*(.+?)\s*\(([^()]*)\)\s*\*\s*$"
    body = F.trim(F.regexp_replace(F.regexp_replace("_b", sign, ""), r"\s+", " "))
    named = each.select(*keep, F.nullif(F.regexp_extract("_b", sign, 1), F.lit("")).alias("reviewer"), F.nullif(F.regexp_extract("_b", sign, 2), F.lit("")).alias("when"), body.alias("text"))
    return named.where(F.size(F.split("text", r"\s+")) >= 3)


def parse_attributions(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """(reviewer, when, text) of text without block marks in which two or more lines
    say who wrote and when, ``*Name (time)*`` or ``Name (2 weeks ago)``: what follows
    such a line, up to the next, is its review; bodies under three words go."""
    keep = [c for c in raw.columns if c != text_col]
    some = raw.where(F.regexp_count(F.col(text_col), F.lit(_ATTRIBUTION)) >= 2)
    marked = F.regexp_replace(text_col, _ATTRIBUTION, "\u001e$1\u001f$2\u001f")
    parts = F.slice(F.split(marked, "\u001e"), 2, 1 << 30)
    fields = some.select(*keep, F.explode(parts).alias("_p")).select(*keep, F.split("_p", "\u001f").alias("_f"))
    named = fields.select(*keep, F.trim(F.get("_f", F.lit(0))).alias("reviewer"), F.trim(F.get("_f", F.lit(1))).alias("when"), F.trim(F.regexp_replace(F.get("_f", F.lit(2)), r"\s+", " ")).alias("text"))
    return named.where(F.size(F.split("text", r"\s+")) >= 3)


def parse_csv(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Reviews of CSV text with a header, whose columns may go by any alias. A field
    may be quoted, and quoted ones may hold commas, doubled quotes and line ends. Each
    text is parsed where it is read."""
    keep = [c for c in raw.columns if c != text_col]
    records = F.regexp_extract_all(F.concat(F.regexp_replace(text_col, "\r\n?", "\n"), F.lit("\n")), F.lit(r'((?:[^"\n]|"(?:[^"]|"")*")*)\n'), F.lit(1))
    lines = raw.select(*keep, F.filter(records, lambda x: F.trim(x) != "").alias("_lines"))
    fields = lambda line: F.transform(
        F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1)),
        lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')).otherwise(x),
    )
    header = F.transform(fields(F.get("_lines", F.lit(0))), lambda x: F.lower(F.trim(x)))
    each = lines.select(*keep, header.alias("_header"), F.explode(F.slice("_lines", 2, 1 << 30)).alias("_line")).withColumn("_fields", fields(F.col("_line")))
    at = lambda a: F.nullif(F.trim(F.get("_fields", F.array_position("_header", F.lit(a)).cast("int") - 1)), F.lit(""))
    pick = lambda name: F.coalesce(*[F.when(F.array_contains("_header", a), at(a)) for a in ALIASES[name]])
    return each.select(
        *keep, pick("reviewer").alias("reviewer"), rating_of(pick("rating")).alias("rating"), F.trim(strip_html(pick("text"))).alias("text"), pick("when").alias("when"), pick("response").alias("owner_response")
    ).where("text <> ''")


def read_any(raw: DataFrame, now: str, text_col: str = "raw") -> DataFrame:
    """Reviews of pasted text, each in whatever format it is: (business, raw) gives
    (review_id, business, reviewer, rating, text, when, months, owner_response). A
    JSON, CSV, block, attributed or line text goes to its parser; a review's id is a
    hash of what it holds and its number among equal ones."""
    kinds = raw.withColumn("_kind", sniff(F.col(text_col)))
    parsers = {"json": parse_json, "csv": parse_csv, "block": parse_blocks, "attributed": parse_attributions, "lines": parse_lines}
    out = None
    for kind, parse in parsers.items():
        found = parse(kinds.where(F.col("_kind") == kind).drop("_kind"), text_col)
        for name, type_ in (("reviewer", "string"), ("rating", "double"), ("when", "string"), ("owner_response", "string")):
            if name not in found.columns:
                found = found.withColumn(name, F.lit(None).cast(type_))
        found = found.select("business", "reviewer", "rating", "text", "when", "owner_response")
        out = found if out is None else out.unionByName(found)
    return normalise_reviews(out, now)


def normalise_reviews(records: DataFrame, now: str) -> DataFrame:
    """Records (business, reviewer, rating, text, when, owner_response, and published
    if they have it) as reviews: the age from the relative time first, then from the
    date; empty texts go."""
    when = months_ago(F.col("when"), now)
    if "published" in records.columns:
        when = F.coalesce(when, months_ago(F.col("published"), now))
    mark = F.xxhash64("business", "reviewer", "rating", "text", "when")
    told = records.where(F.trim("text") != "").withColumns({"months": when, "_mark": mark})
    nth = F.row_number().over(Window.partitionBy("_mark").orderBy("text"))
    made = told.withColumn("review_id", F.sha2(F.concat_ws(":", F.col("_mark").cast("string"), nth.cast("string")), 256))
    return made.select("review_id", "business", "reviewer", "rating", "text", "when", "months", "owner_response")


def parse_json(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Reviews in a JSON array, or an object with ``reviews`` or ``data``; bare
    strings are texts. Fields are found by their aliases."""
    keep = [c for c in raw.columns if c != text_col]
    body = F.coalesce(F.get_json_object(text_col, "$.reviews"), F.get_json_object(text_col, "$.data"), F.col(text_col))
    each = raw.select(*keep, F.explode(F.from_json(body, "array<string>")).alias("_x"))
    pick = lambda name: F.coalesce(*[F.get_json_object("_x", f"$.{a}") for a in ALIASES[name]])
    bare = F.when(~F.col("_x").startswith("{"), F.regexp_replace("_x", '^"|"$', ""))
    return each.select(*keep, rating_of(pick("rating")).alias("rating"), F.coalesce(pick("text"), bare).alias("text"), pick("reviewer").alias("reviewer"), pick("when").alias("when"), pick("response").alias("owner_response")).where(F.trim("text") != "")


def from_records(records: DataFrame) -> DataFrame:
    """Rows of a spreadsheet or CSV file, whose columns may go by any alias."""
    by_name = {c.strip().lower(): c for c in records.columns}

    def pick(name: str) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{by_name[a]}`").cast("string")), F.lit("")) for a in ALIASES[name] if a in by_name]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    photos = pick("photos")
    count = F.coalesce(photos.try_cast("int"), F.size(F.filter(F.split(photos, ","), lambda x: F.trim(x) != "")), F.lit(0))
    return records.select(
        pick("reviewer").alias("reviewer"), rating_of(pick("rating")).alias("rating"), F.trim(strip_html(pick("text"))).alias("text"),
        pick("when").alias("when"), pick("response").alias("owner_response"), F.greatest(count, F.lit(0)).alias("photo_count"),
    ).where("text <> ''")


def place_ids(url: Column) -> dict[str, Column]:
    """What a place's URL tells: ids, name, position; the decimal id is the
    second half of the hexadecimal feature id, unsigned."""
    clean = F.try_url_decode(url)
    part = lambda pattern: F.nullif(F.regexp_extract(clean, pattern, 1), F.lit(""))
    feature = part(r"(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)")
    return {
        "place_id": part(r"[?&]place_id=([^&#]+)"), "cid": F.coalesce(part(r"[?&]cid=(\d+)"), F.conv(F.regexp_extract(feature, ":0x([0-9a-fA-F]+)", 1), 16, 10)),
        "query": part(r"[?&]q=([^&#]+)"), "feature_id": feature, "name": F.translate(part(r"/place/([^/@?]+)"), "+", " "),
        "lat": part(r"@(-?\d+\.\d+),").try_cast("double"), "lng": part(r"@-?\d+\.\d+,(-?\d+\.\d+)").try_cast("double"),
    }


def unwrap_payload(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Reviews of a provider's payload, ``{"data": [place]}`` or ``{"data":
    [[place]]}``, each place with ``reviews_data``; reviews without text go."""
    keep = [c for c in raw.columns if c != text_col]
    first = F.coalesce(F.get_json_object(text_col, "$.data[0][0]"), F.get_json_object(text_col, "$.data[0]"))
    places = raw.select(*keep, F.get_json_object(first, "$.name").alias("business"), F.get_json_object(first, "$.reviews_data").alias("_r"))
    each = places.select(*keep, "business", F.explode(F.from_json("_r", "array<string>")).alias("_x"))
    pick = lambda name: F.coalesce(*[F.get_json_object("_x", f"$.{a}") for a in ALIASES[name]])
    photos = F.size(F.from_json(F.get_json_object("_x", "$.review_photos"), "array<string>"))
    return each.select(
        *keep, "business", pick("reviewer").alias("reviewer"), rating_of(pick("rating")).alias("rating"), F.trim(strip_html(pick("text"))).alias("text"),
        pick("when").alias("when"), pick("response").alias("owner_response"), F.greatest(F.coalesce(photos, F.lit(0)), F.lit(0)).alias("photo_count"),
    ).where("text <> ''")
