"""Benchmark decontamination with a distributed positional inverted index.

Two passes over the corpus, each with a small result:

1. collection frequencies of the words that occur in the benchmark;
2. postings (document, word, positions) of those words, stored in the shared
   folder, for documents that hold both of the rarest words of some window -
   no other document can hold a window.

The search runs on the postings alone. The lists of each window's two rarest
words are shifted by the words' offsets in the item; where they meet, the lists
of the window's other words are intersected as well, on the candidates' keys. Runs
of agreeing words that are as long as a window are the exact matches.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, shipped, slices, text_bytes, words

WINDOW = 13
SLOP = 4
#: Words of benchmark text handled at once. A larger benchmark goes in blocks of
#: items, each searched in the whole corpus, so what is broadcast stays bounded.
BLOCK_WORDS = 1_000_000
#: Windows of an item that are looked at together, so that no step meets all windows
#: of a long item at once.
STRIDE = 64


class Item(NamedTuple):
    item: str
    terms: list[int]


@shipped
def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", window: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: (doc_id, h, n_words, n_hit, items array<string>,
    near_items array<string>); h is a hash of the text.

    A window is ``window`` consecutive words of an item; a shorter item that has
    words is one window. n_hit counts the document's words inside any occurrence
    of a window, items the ids (as strings, sorted) of items with an occurring
    window. near_items are items with a window whose two rarest words occur near
    their places in it: on diagonals (position in the text less position in the
    item) that fall in one stretch of 2 * slop, stretches starting at multiples
    of slop; exact matches count too.

    A null text has no words and no hits. Items whose id or text is null, or
    that have no words, are never found. Repeated documents each get their row;
    items with equal ids count once. Long texts, and words that fill them, cost in
    proportion: positions meet in joins and in hashed intersections. Columns of docs
    other than the two are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h")
    )
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna()
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    parts = []
    for block in range(blocks):
        mine = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else bench
        parts.append(_block(source, mine.collect(), window, slop, first=block == 0))
    heads, found, near = parts[0]
    for _, more, other in parts[1:]:
        found, near = found.unionByName(more), near.unionByName(other)
    on = ["doc_id", "h"]
    found = found.distinct()
    hits = covered(found.select(*on, "start", "end").distinct(), on)
    items = found.select(*on, "item").distinct().groupBy(*on).agg(F.array_sort(F.collect_list("item")).alias("items"))
    nears = near.distinct().groupBy(*on).agg(F.array_sort(F.collect_list("item")).alias("near_items"))
    out = heads
    for side in (hits, items, nears):
        out = _null_safe_left(out, side, on)
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
    )


def covered(spans: DataFrame, on: list[str]) -> DataFrame:
    """(on, n_hit): how many places the spans (start, end; end included) of each
    document cover together, from one pass over them in order."""
    order = Window.partitionBy(*on).orderBy("start", "end")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start") - 1, before), F.lit(0))
    return spans.withColumn("fresh", fresh).groupBy(*on).agg(F.sum("fresh").alias("n_hit"))


def _null_safe_left(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in on], *[c for c in right.columns if c not in on])
    met = [left[c].eqNullSafe(right[f"r_{c}"]) for c in on]
    return left.join(right, met, "left").drop(*[f"r_{c}" for c in on])


def _block(source: DataFrame, rows: list, window: int, slop: int, first: bool):
    spark = source.sparkSession
    vocabulary: dict[bytes, int] = {}
    items = [
        Item(r["item"], [vocabulary.setdefault(w, len(vocabulary)) for w in words(r["text"].encode())]) for r in rows
    ]
    items = [x for x in items if x.terms]
    known = spark.sparkContext.broadcast(vocabulary)
    counts = np.zeros(len(vocabulary), np.int64)
    for r in term_counts(source, known).collect():
        counts[r["term"]] = r["n"]
    windows = rarest(items, counts, window)
    pairs = sorted({(items[i].terms[a], items[i].terms[b]) for i, _, _, a, b, _ in windows})
    index = keep(build_index(source, known, pairs), "postings")
    postings = index.where("term >= 0").select("doc_id", "h", "term", "positions")
    heads = index.where("term = -1").select("doc_id", "h", "n_words") if first else None
    return heads, *search(postings, items, windows, window, slop)


def term_counts(source: DataFrame, known) -> DataFrame:
    """(term, n): how often each known word occurs in the corpus."""

    def run(batches):
        vocabulary, total = known.value, Counter()
        for batch in slices(batches, 0):
            for text in text_bytes(batch.column(0)):
                if text:
                    total.update(w for w in words(text) if w in vocabulary)
        terms = {vocabulary[w]: n for w, n in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.int32()), pa.array(list(terms.values()), pa.int64())], ["term", "n"])

    found = source.select("text").mapInArrow(run, "term int, n bigint")
    return found.groupBy("term").agg(F.sum("n").alias("n"))


def rarest(items: list[Item], counts: np.ndarray, window: int) -> list[tuple[int, int, int, int, int, bool]]:
    """(item's place, start, end, place of the rarest word, of the second rarest,
    whether all words occur) of each window; places are in the item. The two are
    the rarest that the corpus has: a copy of the window may lack the others, but
    then is near only. Windows of several words need two that occur."""
    out = []
    for i, (_, terms) in enumerate(items):
        seen = counts[terms]
        for start in range(max(1, len(terms) - window + 1)):
            part = seen[start : start + window]
            there = np.flatnonzero(part)
            if len(there) >= min(2, len(part)):
                order = there[np.argsort(part[there], kind="stable")]
                second = order[min(1, len(order) - 1)]
                out.append((i, start, start + len(part) - 1, start + int(order[0]), start + int(second), len(there) == len(part)))
    return out


def build_index(source: DataFrame, known, pairs: list[tuple[int, int]]) -> DataFrame:
    """Rows (doc_id, h, n_words, term, positions): for each document one with
    term -1 and its number of words, and its postings if it can hold a window, that
    is, both words of one of the pairs (each window's two rarest)."""
    spark = source.sparkSession
    wanted = spark.sparkContext.broadcast(pairs)
    return source.mapInArrow(
        lambda batches: _postings(batches, known.value, wanted.value),
        f"doc_id {source.schema['doc_id'].dataType.simpleString()}, h bigint, n_words bigint, term int, positions array<int>",
    )


def _postings(batches, vocabulary, pairs):
    partners = defaultdict(set)
    names = {n: w for w, n in vocabulary.items()}
    for first, second in pairs:
        partners[names[first]].add(names[second])
    keys = frozenset(partners)
    for batch in slices(batches):
        row, n_words, term, positions, offsets = [], [], [], [], [0]
        for at, text in enumerate(text_bytes(batch.column(1))):
            found = words(text) if text else []
            row.append(at)
            n_words.append(len(found))
            term.append(-1)
            offsets.append(offsets[-1])
            seen = set(found)
            if not any(not partners[w].isdisjoint(seen) for w in keys & seen):
                continue
            ids = np.fromiter((vocabulary.get(w, -1) for w in found), np.int32, len(found))
            where = np.flatnonzero(ids >= 0)
            order = where[np.argsort(ids[where], kind="stable")]
            each, starts = np.unique(ids[order], return_index=True)
            positions.append(order.astype(np.int32))
            row += [at] * len(each)
            n_words += [len(found)] * len(each)
            term += each.tolist()
            offsets += [offsets[-1] + x for x in [*starts[1:].tolist(), len(order)]]
        flat = np.concatenate(positions) if positions else np.empty(0, np.int32)
        take = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(take), batch.column(2).take(take), pa.array(n_words, pa.int64()),
                pa.array(term, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
            ],
            ["doc_id", "h", "n_words", "term", "positions"],
        )


def search(postings: DataFrame, items: list[Item], windows: list, window: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """Exact matches (doc_id, h, item, start, end of a run of words, end included)
    and proximity matches (doc_id, h, item)."""
    spark = postings.sparkSession
    frame = lambda rows, kind: F.broadcast(spark.createDataFrame(rows, kind))  # noqa: E731  bounded by BLOCK_WORDS
    met = {i for i, *_ in windows}
    # A window belongs to the part of its item where it starts, and so do its anchors.
    anchors = sorted({(items[i].terms[k], i, k, start // STRIDE, 1 if len(items[i].terms) == 1 else 2) for i, start, _, *ks, _ in windows for k in ks})
    places = frame(anchors, "term int, i int, k int, part int, need int")
    plans = frame([(i, s // STRIDE, s, e, a, b, whole) for i, s, e, a, b, whole in windows], "i int, part int, s int, e int, a int, b int, whole boolean")
    names = frame([(i, x.item, min(window, len(x.terms))) for i, x in enumerate(items)], "i int, item string, least int")
    terms = frame([(i, k, t) for i, x in enumerate(items) if i in met for k, t in enumerate(x.terms)], "i int, k int, term int")
    shifted = (
        postings.join(places, "term").select("doc_id", "h", "i", "part", "k", "need", F.explode("positions").alias("pos"))
        .withColumn("diag", F.col("pos") - F.col("k"))
    )

    def met_by(key: str, rows: DataFrame) -> DataFrame:
        """Windows whose two anchors have one value of the key. Most values have one
        anchor alone and go before windows are looked at."""
        groups = rows.groupBy("doc_id", "h", "i", "part", key).agg(F.collect_set("k").alias("ks"), F.min("need").alias("need"))
        some = groups.where(F.size("ks") >= F.col("need")).join(plans, ["i", "part"])
        return some.where(F.array_contains("ks", F.col("a")) & F.array_contains("ks", F.col("b")))

    candidates = met_by("diag", shifted).where("whole").select("doc_id", "h", "i", "diag", "s", "e")
    candidates = keep(candidates, "candidates")
    asked = candidates.select("doc_id", "h", "i", "diag", F.explode(F.sequence("s", "e")).alias("k")).distinct().join(terms, ["i", "k"])
    asked = asked.withColumn("pos", F.col("diag") + F.col("k"))
    # One hashed intersection for each document and term, however long the lists are.
    lists = asked.groupBy("doc_id", "h", "term").agg(F.collect_set("pos").alias("wanted")).alias("x").join(
        postings.alias("p"),
        F.col("x.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("x.h") == F.col("p.h")) & (F.col("x.term") == F.col("p.term")),
    )
    there = lists.select(
        F.col("x.doc_id").alias("p_doc"), F.col("x.h").alias("p_h"), F.col("x.term").alias("p_term"),
        F.explode(F.array_intersect("p.positions", "x.wanted")).alias("p_pos"),
    )
    agreed = asked.join(
        there,
        asked["doc_id"].eqNullSafe(there["p_doc"]) & (asked["h"] == there["p_h"]) & (asked["term"] == there["p_term"]) & (asked["pos"] == there["p_pos"]),
    ).select("doc_id", "h", "i", "diag", "k").distinct()
    line = Window.partitionBy("doc_id", "h", "i", "diag").orderBy("k")
    runs = agreed.withColumn("run", F.col("k") - F.row_number().over(line)).groupBy("doc_id", "h", "i", "diag", "run").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    exact = runs.join(names, "i").where(F.col("hi") - F.col("lo") + 1 >= F.col("least")).select(
        "doc_id", "h", "item", (F.col("lo") + F.col("diag")).alias("start"), (F.col("hi") + F.col("diag")).alias("end")
    )
    stretch = F.floor(F.col("diag") / F.lit(slop))
    stretched = shifted.select("doc_id", "h", "i", "part", "k", "need", F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
    near = met_by("stretch", stretched).select("doc_id", "h", "i").distinct().join(names, "i").select("doc_id", "h", "item")
    return exact, near
