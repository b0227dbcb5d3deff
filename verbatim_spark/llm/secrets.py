"""Secret scans with corpus-wide ownership frequency.

Candidates are found with regular expressions, hashed, and counted over the
corpus by distinct repositories and owners. A value that several owners have is
a widely copied example; one that few have, and that isn't a placeholder, looks
live. All of it is DataFrame operations.

Spans come without sentinels: ``regexp_extract_all`` gives the matches and
``split`` by the same pattern what stands between them, both leftmost and
without overlaps, so running sums of the two's lengths are places in code points.
No value is kept in a table: hashes are what is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running
from .common import keep, shipped

#: Kind, pattern, group that holds the value, its least length.
#: The first three are the contract's. A maximal run of 24 or more hex digits is
#: what its pattern gives once shorter matches are dropped, and likewise for access.
BASE = [
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
MORE = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("url", r"://[^\s:/@]+:([^\s:/@]+)@", 1, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
]
#: Marks of placeholders.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef|\*\*\*"
#: A value that is in at most so many owners' hands, and in at most so many
#: repositories, can be live.
MOST_OWNERS = 2
MOST_REPOS = 50
#: Rows of one value are dealt out to so many keys when counts are joined back.
SALT = 16

#: Characters of the parts that a text is cut into when spans are replaced.
_PART = 1024


def spans_of(text: Column, kinds: list[tuple[str, str, int, int]]) -> Column:
    """array<struct<kind, rank, start, end, hash, placeholder>> of a text, ordered
    by start, then rank (the kind's place in ``kinds``); end is exclusive, places
    count code points, hash is the value's SHA-256. A null text has none."""
    arrays = []
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("bigint"))
        facts = F.struct(gaps.alias("gaps"), whole.alias("whole"), value.alias("value"))
        arrays.append(F.when(text.rlike(pattern), let(facts, _placed(kind, rank, least))))
    key = lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"], x["hash"], x["placeholder"])
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,hash:string,placeholder:boolean>>")
    ordered = F.array_sort(F.concat(*[F.coalesce(F.transform(a, key), none) for a in arrays]))
    return F.transform(ordered, lambda x: F.struct(x["kind"], x["rank"], x["start"], x["end"], x["hash"], x["placeholder"]))


def _placed(kind: str, rank: int, least: int):
    """Spans of one kind from the lengths of the gaps (one more than matches) and the matches."""

    def of(x):
        sizes = F.transform(x["whole"], lambda m: F.char_length(m).cast("bigint"))
        reach = running(F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["whole"])), sizes, lambda g, m: g + m))
        zipped = F.zip_with(F.arrays_zip(reach.alias("end"), sizes.alias("n")), x["value"], lambda s, v: F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), (s["end"] - s["n"]).alias("start"), s["end"].alias("end"), v.alias("value")
        ))
        kept = F.filter(zipped, lambda s: F.char_length(s["value"]) >= least)
        return F.transform(kept, lambda s: F.struct(
            s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), s["value"].rlike(PLACEHOLDER).alias("placeholder")
        ))

    return of


@shipped
def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str = "doc_id", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """One row per row of docs: (doc_id, h, secrets array<struct<kind, rank, start,
    end, hash, owners, repos, live>>), ordered by start; h is a hash of the text.

    owners and repos are the numbers of distinct owners and repositories whose
    texts hold the value, a null owner or repository counting as one of its own.
    live: the owners are at most ``most_owners``, the repositories at most
    ``most_repos``, and the value isn't a placeholder; others are widely copied
    examples. Null and empty texts have no secrets; repeated rows each get theirs;
    an empty table gives an empty result. A text may have any number of spans: their
    places are running sums, so cost stays in proportion to its length. Spans of
    different kinds may overlap, and then all are returned.
    """
    rows = keep(
        docs.select(
            F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"),
            F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
            spans_of(F.col(text_col), [*BASE, *MORE]).alias("spans"),
        ),
        "secrets",
    )
    each = rows.where(F.size("spans") > 0).select("doc_id", "h", "owner", "repo", F.explode("spans").alias("span"))
    each = each.withColumn("hash", F.col("span.hash"))
    counts = ownership(each)
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    judged = (
        each.select("doc_id", "h", "span", "hash", F.pmod(F.xxhash64("doc_id", "h", "span"), F.lit(SALT)).cast("int").alias("salt"))
        .distinct().join(salted, ["hash", "salt"])
        .select(
            "doc_id", "h",
            F.struct(
                F.col("span.start").alias("start"), F.col("span.rank").alias("rank"), F.col("span.end").alias("end"),
                F.col("span.kind").alias("kind"), "hash", "owners", "repos",
                ((F.col("owners") <= most_owners) & (F.col("repos") <= most_repos) & ~F.col("span.placeholder")).alias("live"),
            ).alias("secret"),
        )
        .groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("secret")).alias("found"))
        .withColumnsRenamed({"doc_id": "found_id", "h": "found_h"})
    )
    some = rows.where(F.size("spans") > 0).select("doc_id", "h")
    some = some.join(judged, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("h") == F.col("found_h")))
    order = ("kind", "rank", "start", "end", "hash", "owners", "repos", "live")
    some = some.select("doc_id", "h", F.transform("found", lambda x: F.struct(*[x[c].alias(c) for c in order])).alias("secrets"))
    kind = some.schema["secrets"].dataType.simpleString()
    return some.unionByName(rows.where(F.size("spans") == 0).select("doc_id", "h", F.array().cast(kind).alias("secrets")))


def ownership(each: DataFrame) -> DataFrame:
    """(hash, owners, repos): distinct owners and repositories of each value, in
    three steps, so that a value of a third of the corpus is spread by repository
    and then by owner before its few rows meet."""
    pairs = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def frequency(spans: Column) -> Column:
    """owners:repos of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["owners"], x["repos"])))


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each of the spans (ordered by start) replaced; of overlapping
    ones the first is replaced by the mask and the others go with it. The text is
    cut into parts once, so a long text with many spans costs in proportion."""
    facts = F.struct(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0)).alias("parts"),
        spans.alias("spans"), running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b)).alias("reach"),
        F.char_length(text).cast("bigint").alias("n"),
    )

    def masked(x):
        before = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(x["reach"], i - 1))
        pieces = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= before(i), F.concat(_cut(x["parts"], before(i), s["start"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), _cut(x["parts"], F.element_at(x["reach"], -1), x["n"]))

    return F.when(F.size(spans) > 0, let(facts, masked)).otherwise(text)


def _cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters start (from 0) to end (exclusive) of a text in parts of _PART."""
    first, last = F.floor(start / _PART).cast("int"), F.floor((end - 1) / _PART).cast("int")
    middle = F.transform(
        F.slice(parts, first + 1, last - first + 1),
        lambda p, i: F.substring(p, F.when(i == 0, (start % _PART).cast("int") + 1).otherwise(1), F.lit(_PART)),
    )
    keep_last = ((end - 1) % _PART).cast("int") + 1 - F.when(first == last, (start % _PART).cast("int")).otherwise(0)
    cut = F.transform(middle, lambda p, i: F.when(i == last - first, F.substring(p, F.lit(1), keep_last)).otherwise(p))
    return F.when(end > start, F.array_join(cut, "")).otherwise("")
