"""The analyst's workbench: codebook, co-occurrence, retrieval, edits, agreement.

Applications are rows (quotation_id, code_id, document_id, created_by, ...), one
for each code applied to a quotation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def co_occurrence(apps: DataFrame, least: int = 1, top: int = 200) -> DataFrame:
    """Code pairs by quotations and documents shared, with the c-coefficient
    pairs / (n_a + n_b - pairs) over numbers of applications. Pairs within a
    quotation come from one row a quotation, so no pair is shuffled twice."""
    sizes = apps.groupBy("code_id").agg(F.count("*").alias("n"))

    def pairs(key: str, name: str) -> DataFrame:
        grouped = apps.groupBy(key).agg(F.array_sort(F.collect_set("code_id")).alias("codes"))
        each = grouped.select("codes", F.posexplode("codes").alias("at", "a"))
        return (
            each.select("a", F.explode(F.expr("slice(codes, at + 2, size(codes))")).alias("b"))
            .groupBy("a", "b").agg(F.count("*").alias(name))
        )

    met = pairs("quotation_id", "quotations").join(pairs("document_id", "documents"), ["a", "b"], "full")
    met = met.fillna(0, ["quotations", "documents"]).where((F.col("quotations") >= least) | (F.col("documents") >= 2))
    left, right = sizes.select(F.col("code_id").alias("a"), F.col("n").alias("na")), sizes.select(F.col("code_id").alias("b"), F.col("n").alias("nb"))
    scored = met.join(left, "a").join(right, "b").withColumn(
        "c", F.round(F.col("quotations") / (F.col("na") + F.col("nb") - F.col("quotations")), 6)
    )
    return scored.orderBy(F.desc("quotations"), F.desc("documents"), "a", "b").limit(top).select("a", "b", "quotations", "documents", "c")


def codebook_stats(apps: DataFrame, links: DataFrame, groups: DataFrame, memos: DataFrame) -> DataFrame:
    """Groundedness, density (links at either end), documents, memos and groups of each code."""
    ends = links.select(F.col("src").alias("code_id")).unionByName(links.where("src <> dst").select(F.col("dst").alias("code_id")))
    density = ends.groupBy("code_id").agg(F.count("*").alias("density"))
    noted = memos.groupBy("code_id").agg(F.count("*").alias("memos"))
    named = groups.groupBy("code_id").agg(F.array_join(F.array_sort(F.collect_set("group")), ",").alias("groups"))
    out = apps.groupBy("code_id").agg(F.count("*").alias("groundedness"), F.countDistinct("document_id").alias("documents"))
    for side in (density, noted, named):
        out = out.join(side, "code_id", "left")
    return out.fillna(0, ["density", "memos"]).fillna("", ["groups"])


def code_document_table(apps: DataFrame, documents: list[str], column: str = "document") -> DataFrame:
    """Applications of each code by document, with row totals; the documents are
    a fixed list, so the pivot needs no extra pass."""
    table = apps.groupBy("code_id").pivot(column, documents).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(f"`{d}`") for d in documents), F.lit(0))
    hit = sum((F.when(F.col(f"`{d}`") > 0, 1).otherwise(0) for d in documents), F.lit(0))
    return table.withColumns({"total": total, "n_documents": hit})


def retrieve(apps: DataFrame, codes: list[str], operator: str, scope: str = "quotation") -> DataFrame:
    """Quotations by codes: ``all`` of them, ``any``, ``none`` (among coded
    quotations) or ``only`` them. With scope ``document`` a document's codes are
    taken together and all its quotations returned."""
    key = {"quotation": "quotation_id", "document": "document_id"}[scope]
    matched = F.count_distinct(F.when(F.col("code_id").isin(codes), F.col("code_id")))
    k = len(set(codes))
    tests: dict[str, Column] = {
        "all": F.col("matched") == k, "any": F.col("matched") > 0, "none": F.col("matched") == 0,
        "only": (F.col("matched") == k) & (F.col("total") == k),
    }
    if operator not in tests:
        raise ValueError(f"operator is one of {sorted(tests)}")
    chosen = apps.groupBy(key).agg(matched.alias("matched"), F.count_distinct("code_id").alias("total")).where(tests[operator])
    return apps.join(chosen, key, "left_semi").select("document_id", "quotation_id").distinct()


def agreement_pairs(apps: DataFrame) -> DataFrame:
    """Quotations coded both by hand (``user``) and by machine, with both code
    sets and the first code of each in order."""
    human = F.col("created_by") == "user"
    sets = apps.groupBy("quotation_id").agg(
        F.array_sort(F.collect_set(F.when(human, F.col("code_id")))).alias("human"),
        F.array_sort(F.collect_set(F.when(~human, F.col("code_id")))).alias("machine"),
    )
    both = sets.where((F.size("human") > 0) & (F.size("machine") > 0))
    return both.withColumns({"h": F.col("human")[0], "m": F.col("machine")[0]})


def percent_agreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("n"), F.count_if(F.col("human") == F.col("machine")).alias("exact"),
        F.count_if(F.arrays_overlap("human", "machine")).alias("partial"),
    ).withColumns({"percent": F.round(F.col("exact") / F.col("n"), 6), "partial_percent": F.round(F.col("partial") / F.col("n"), 6)})


def cohens_kappa(pairs: DataFrame, a: str = "h", b: str = "m") -> DataFrame:
    """Kappa of two label columns; null with under two labels or full expected agreement."""
    left = pairs.groupBy(F.col(a).alias("label")).agg(F.count("*").alias("na"))
    right = pairs.groupBy(F.col(b).alias("label")).agg(F.count("*").alias("nb"))
    labels = left.join(right, "label", "full").fillna(0).agg(F.count("*").alias("labels"), F.sum(F.col("na") * F.col("nb")).alias("cross"))
    seen = pairs.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agree"))
    expected, observed = F.col("cross") / (F.col("n") * F.col("n")), F.col("agree") / F.col("n")
    return seen.join(labels).select(
        "n", "labels",
        F.when((F.col("labels") >= 2) & (expected < 1), F.round((observed - expected) / (1 - expected), 6)).alias("kappa"),
    )


def krippendorff_alpha(pairs: DataFrame, a: str = "h", b: str = "m") -> DataFrame:
    """Nominal alpha, both directions of each pair counted; null under two pairs,
    1 if no disagreement is expected. The sum of products of different labels'
    counts is N squared less the sum of squares, so no label meets another."""
    both = pairs.select(F.explode(F.array(a, b)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    sums = both.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    seen = pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col(a) != F.col(b)).alias("differ"))
    observed = F.col("differ") / F.col("pairs")
    expected = (F.col("total") * F.col("total") - F.col("squares")) / F.col("total") / (F.col("total") - 1)
    return seen.join(sums).select(
        "pairs", F.when(F.col("pairs") < 2, None).when(expected == 0, 1.0).otherwise(F.round(1 - observed / expected, 6)).alias("alpha")
    )


def agreement_band(value: Column, n: Column) -> Column:
    """How far agreement statistics can be relied on."""
    band = F.when(value.isNull(), "undefined").when(value >= 0.8, "reliable").when(value >= 0.667, "tentative").otherwise("unreliable")
    return F.concat(band, F.when(n < 20, " (few units)").otherwise(""))


def merge_codes(apps: DataFrame, links: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applications and links with merged codes (mapping: code_id, keep_id)
    renamed; doubled applications and self-links go."""
    apps = apps.join(mapping, "code_id", "left").withColumn("code_id", F.coalesce("keep_id", "code_id")).drop("keep_id")
    for end in ("src", "dst"):
        side = mapping.withColumnsRenamed({"code_id": end, "keep_id": "to"})
        links = links.join(side, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return apps.dropDuplicates(["quotation_id", "code_id"]), links.where("src <> dst").select("src", "dst").distinct()


def delete_codes(apps: DataFrame, codes: DataFrame) -> DataFrame:
    return apps.join(codes, "code_id", "left_anti")


def retained(apps: DataFrame) -> DataFrame:
    """What a new run keeps of the old one: applications made by hand."""
    return apps.where(F.col("created_by") == "user")


def unreferenced(quotations: DataFrame, kept: DataFrame) -> DataFrame:
    """Automatic quotations that no kept application refers to."""
    return quotations.where(F.col("created_by") != "user").join(kept, "quotation_id", "left_anti")


def apply_codes(apps: DataFrame, new: DataFrame) -> DataFrame:
    """apps with those new applications whose (quotation, code) isn't there yet."""
    fresh = new.dropDuplicates(["quotation_id", "code_id"]).join(apps, ["quotation_id", "code_id"], "left_anti")
    return apps.unionByName(fresh.select(*apps.columns))


def create_quotations(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Spans clamped to their document, at least two characters long, one of each."""
    clamped = spans.join(lengths, "document_id").select(
        "document_id", F.least(F.greatest("start", F.lit(0)), "length").alias("start"), F.least(F.greatest("end", F.lit(0)), "length").alias("end")
    )
    return clamped.where("end - start >= 2").dropDuplicates(["document_id", "start", "end"])


def reuse_spans(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New spans with the id of an equal existing quotation, or one derived from the span."""
    made = F.sha2(F.concat_ws(":", "document_id", "start", "end"), 256)
    known = existing.select("document_id", "start", "end", F.col("quotation_id").alias("known"))
    return new.join(known, ["document_id", "start", "end"], "left").withColumn("quotation_id", F.coalesce("known", made)).drop("known")


def recompute_themes(apps: DataFrame, mapping: DataFrame) -> DataFrame:
    """Themes after relabelling (theme_id, to), with recomputed statistics:
    members, mean confidence, coverage and documents."""
    moved = apps.join(mapping, "theme_id", "left").withColumn("theme_id", F.coalesce("to", "theme_id"))
    stats = moved.groupBy("theme_id").agg(
        F.count("*").alias("members"), F.round(F.avg("confidence"), 6).alias("confidence"), F.countDistinct("document_id").alias("documents"),
        F.max(F.col("to").isNotNull()).alias("touched"),
    )
    total = Window.partitionBy()
    return stats.withColumns({
        "coverage": F.round(F.col("members") / F.sum("members").over(total), 6),
        "status": F.when(F.col("touched"), "review").otherwise("confirmed"),
    }).drop("touched")


def resolve_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links with the names of their ends; an end that is gone is ``(removed)``."""
    for end in ("src", "dst"):
        side = names.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
        links = links.join(side, end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", F.lit("(removed)")))
    return links.select("src", "dst", "src_name", "dst_name")


def hydrate(quotations: DataFrame, apps: DataFrame) -> DataFrame:
    """Quotations with their codes in order."""
    codes = apps.groupBy("quotation_id").agg(F.array_join(F.array_sort(F.collect_set("code_id")), ",").alias("codes"))
    return quotations.join(codes, "quotation_id", "left").fillna("", ["codes"])


def usage_ledger(events: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Sums by kind over the latest ``limit`` rows (all rows if None)."""
    latest = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit) if limit else events
    return latest.groupBy("event_type").agg(
        F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.sum("k").alias("tokens"), F.count_if(F.col("value") < 10).alias("failures")
    )


def usage_view(events: DataFrame, users: DataFrame, projects: DataFrame, viewer: int, owner: bool, limit: int | None = 1000) -> DataFrame:
    """What a viewer sees of the ledger: an owner every row, others their own; the
    latest ``limit`` rows with the names of user (user_id, user) and project
    (project_id, project), empty where they are gone, summed up by both."""
    seen = events if owner else events.where(F.col("user_id") == viewer)
    latest = seen.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit) if limit else seen
    named = latest.join(users, "user_id", "left").join(projects, "project_id", "left").fillna("", ["user", "project"])
    return named.groupBy("user", "project").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.count_if(F.col("value") < 10).alias("failures"))


def rename_codes(codes: DataFrame, renames: DataFrame) -> DataFrame:
    """Codes (code_id, name) under new names (code_id, new_name); applications refer to
    ids, so labels are told at reading and nothing else is rewritten."""
    return codes.join(renames, "code_id", "left").withColumn("name", F.coalesce(F.nullif(F.trim("new_name"), F.lit("")), "name")).drop("new_name")


STATUSES = ["confirmed", "candidate", "review", "rejected"]


def overlay_themes(themes: DataFrame, edits: DataFrame) -> DataFrame:
    """Themes (theme_id, name, status) with the analyst's edits (theme_id, new_name,
    new_status) over them; a blank name or an unknown status changes nothing."""
    known = F.when(F.col("new_status").isin(STATUSES), F.col("new_status"))
    told = themes.join(edits, "theme_id", "left")
    return told.withColumns({"name": F.coalesce(F.nullif(F.trim("new_name"), F.lit("")), "name"), "status": F.coalesce(known, "status")}).drop("new_name", "new_status")


def next_order(themes: DataFrame, by: str) -> DataFrame:
    """The place that a new theme of each project takes: one after the last, 1 if none has one."""
    return themes.groupBy(by).agg((F.coalesce(F.max("order_idx"), F.lit(0)) + 1).alias("next_order"))


def project(rows: DataFrame, names: dict[str, str], flags: list[str] = (), decoded: dict[str, str] | None = None) -> DataFrame:
    """Rows as they are shown: columns picked and renamed, flags as booleans, JSON
    columns as what they hold (column -> type); what can't be decoded is null."""
    told = {**{c: F.col(c).cast("boolean") for c in flags}, **{c: F.from_json(c, kind) for c, kind in (decoded or {}).items()}}
    return rows.select(*[told.get(c, F.col(c)).alias(name) for c, name in names.items()])


def clamp(value: Column, default: float, low: float, high: float) -> Column:
    """A number within bounds; what isn't a number is the default."""
    return F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(default)), F.lit(low)), F.lit(high))


def colour_for(name: Column, used: Column, palette: int = 12) -> Column:
    """The palette place of a new code."""
    total = F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc + F.ascii(c))
    return (used + total) % palette
