"""Vector-space operators over long tables (vec_id, term, weight) and dense
vectors: idf, tf-idf, co-occurrence, similarity, cohesion, leader clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.kept import drop, keep
from ..functions.shipping import ship


def idf_table(counts: DataFrame, total: DataFrame) -> DataFrame:
    """ln((n + 1) / (df + 0.5)) + 1 from (doc, term) rows and a one-row total n."""
    df = counts.groupBy("term").agg(F.countDistinct("doc").alias("df"))
    return df.join(F.broadcast(total)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 0.5)) + 1).alias("idf"))


def tfidf(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """L2-normalised weights from (doc, term, tf); a term without idf counts 1."""
    whole = Window.partitionBy("doc")
    raw = counts.join(idf, "term", "left").withColumn("w", F.col("tf") / F.sum("tf").over(whole) * F.coalesce("idf", F.lit(1.0)))
    return raw.select("doc", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole))).alias("weight"))


def top_terms(vectors: DataFrame, n: int) -> DataFrame:
    best = Window.partitionBy("doc").orderBy(F.desc(F.round("weight", 6)), "term")
    return vectors.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def co_occurrence(pairs: DataFrame, least: int = 2, top: int = 4) -> DataFrame:
    """Related terms from distinct (doc, term) rows: c / sqrt(df_a df_b), the best
    ``top`` of each. Pairs come from one array a document."""
    df = pairs.groupBy("term").agg(F.count("*").alias("df"))
    docs = pairs.groupBy("doc").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    each = docs.select("terms", F.posexplode("terms").alias("at", "a")).select("a", F.explode(F.expr("slice(terms, at + 2, size(terms))")).alias("b"))
    met = each.groupBy("a", "b").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    left, right = df.select(F.col("term").alias("a"), F.col("df").alias("da")), df.select(F.col("term").alias("b"), F.col("df").alias("db"))
    scored = both.join(left, "a").join(right, "b").withColumn("strength", F.round(F.col("c") / F.sqrt(F.col("da") * F.col("db")), 6))
    best = Window.partitionBy("a").orderBy(F.desc("strength"), "b")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("a", "b", "c", "strength", "rank")


def expand(vectors: DataFrame, related: DataFrame, alpha: float = 0.45) -> DataFrame:
    """One step of smoothing along related terms, renormalised."""
    spread = vectors.join(related.select(F.col("a").alias("term"), "b", "strength"), "term")
    spread = spread.select("doc", F.col("b").alias("term"), (F.col("weight") * F.col("strength") * alpha).alias("weight"))
    return normalise(vectors.select("doc", "term", "weight").unionByName(spread))


def normalise(vectors: DataFrame) -> DataFrame:
    summed = vectors.groupBy("doc", "term").agg(F.sum("weight").alias("weight"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc")))
    return summed.withColumn("weight", F.col("weight") / norm)


def code_terms(codes: DataFrame, id_col: str = "id") -> DataFrame:
    """(doc, term, tf) of codes (stems, phrase, mood, intent): stems once, the stems
    of the phrase that names the code twice more, a mood that isn't neutral twice,
    the intent once, so that affect and stance count in what makes codes alike."""
    phrase = F.transform(F.filter(F.split("phrase", " "), lambda w: w != ""), tx.stem)
    mood = F.when(F.col("mood") != "neutral", F.array(F.concat(F.lit("emo:"), F.col("mood"))))
    intent = F.when(F.col("intent").isNotNull(), F.array(F.concat(F.lit("int:"), F.col("intent"))))
    none = tx.strings([])
    terms = F.concat(F.col("stems"), phrase, phrase, F.coalesce(mood, none), F.coalesce(mood, none), F.coalesce(intent, none))
    return codes.select(F.col(id_col).alias("doc"), F.explode(terms).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def code_vectors(terms: DataFrame, idf: DataFrame, concepts: DataFrame | None = None, related: DataFrame | None = None) -> DataFrame:
    """Unit vectors (doc, term, weight) of (doc, term, tf): tf-idf, blended with the
    same over concepts (term, concept) and spread along related terms, if given."""
    own = tfidf(terms, idf.select("term", "idf"))
    if concepts is not None:
        named = terms.join(concepts, "term", "left").withColumn("term", F.coalesce("concept", "term"))
        mapped = named.groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
        own = blend(tfidf(mapped, idf.select("term", "idf")), own)
    return expand(own, related) if related is not None else own


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors that are wholly equal, as one: (doc, term, weight) of the least id of
    each, and (doc, copy_of, m) for all, m the number of equal ones. What is said
    again and again then makes no pairs."""
    marks = vectors.groupBy("doc").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("term", F.round("weight", 9).alias("w"))))).alias("mark"))
    first = marks.groupBy("mark").agg(F.min("doc").alias("copy_of"), F.count("*").alias("m"))
    copies = keep(marks.join(first, "mark").select("doc", "copy_of", "m"), "copies")
    return vectors.join(copies.where("doc = copy_of").select("doc"), "doc", "left_semi"), copies


def blend(concepts: DataFrame, terms: DataFrame, share: float = 0.55) -> DataFrame:
    """Concept and term vectors in one; concepts are prefixed, so they don't clash."""
    left = concepts.select("doc", F.concat(F.lit("k:"), F.col("term")).alias("term"), (F.col("weight") * share).alias("weight"))
    return normalise(left.unionByName(terms.select("doc", "term", (F.col("weight") * (1 - share)).alias("weight"))))


def sparse_edges(vectors: DataFrame, least: float, block: int = 16384, most: int = 2_000_000) -> DataFrame:
    """(i, j, sim) of long vectors (doc, term, weight) with a dot product of
    ``least`` or more, i < j: blocks of vectors (``block`` of them, ``most`` terms)
    meet once each, and only the edges come out, so pairs are never shuffled.
    With a column ``within``, only vectors of the same value meet. Each task holds
    two blocks."""
    near = ["within"] if "within" in vectors.columns else []
    ship(vectors.sparkSession)
    shared = keep(vectors.groupBy("term").agg(F.count("*").alias("df")).where("df > 1").select("term"), "terms").withColumn("t", F.monotonically_increasing_id())
    laid = vectors.select("doc", "term", "weight", *near).dropna(subset=["doc", *near]).join(shared, "term")
    docs = laid.groupBy("doc", *near).agg(F.collect_list(F.struct("t", "weight")).alias("x"))
    docs = keep(docs.select("doc", *near, F.col("x.t").alias("t"), F.col("x.weight").alias("x")), "vectors")
    sizes = docs.groupBy(*near).agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.size("t")) / most)).cast("int").alias("n"))
    dealt = docs.join(sizes, near) if near else docs.join(F.broadcast(sizes))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("doc"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("doc", "t", "x", *near, "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        *_, p, q = key
        left, right = group[group["b"] == p], group[group["b"] == q]
        if left.empty or right.empty:
            return pd.DataFrame({"i": left["doc"].iloc[:0], "j": left["doc"].iloc[:0], "sim": []})
        at, to, sims = block_edges(*([np.concatenate(side["t"].to_numpy()), np.concatenate(side["x"].to_numpy()), side["t"].map(len).to_numpy()] for side in (left, right)), least)
        x, y = left["doc"].to_numpy()[at], right["doc"].to_numpy()[to]
        first = x < y
        out = pd.DataFrame({"i": np.where(first, x, y), "j": np.where(first, y, x), "sim": sims})
        return out[first] if p == q else out

    kind = dict(vectors.dtypes)["doc"]
    return dealt.groupBy(*near, "p", "q").applyInPandas(meet, f"i {kind}, j {kind}, sim double")


def block_edges(left: list[np.ndarray], right: list[np.ndarray], least: float, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of left, rows of right and dot products of those at ``least`` or more.
    A side is (terms, weights, number of terms by row), a row's terms together.

    Rare terms are summed over postings. The commonest, which would make the most
    products, are left to the pairs that can still reach ``least``: they add at most
    the product of the two rows' lengths over them, which is small where they weigh
    little. How many count as common is chosen by the work; the result is exact."""
    terms, at = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
    a, b = at[: len(left[0])], at[len(left[0]) :]
    (_, wa, na), (_, wb, nb) = left, right
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    work = np.bincount(a, minlength=len(terms)).astype(float) * np.bincount(b, minlength=len(terms))
    order = np.argsort(-work, kind="stable")
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    a, b, work = place[a], place[b], work[order]

    def lengths(rows, term, weight, n, k):
        return np.sqrt(np.bincount(rows[term < k], weight[term < k] ** 2, minlength=n))

    def cost(k):
        """Nanoseconds, about: products of rare terms, and pairs that the common ones alone can bring to ``least``."""
        x, y = lengths(ra, a, wa, len(na), k), np.sort(lengths(rb, b, wb, len(nb), k))
        return 15 * work[k:].sum() + (5 + k / 4) * (len(y) - np.searchsorted(y, least / np.maximum(x, 1e-300))).sum()

    k = min((k for k in (0, 16, 32, 64, 128, 256, 512)), key=cost)
    x, y = lengths(ra, a, wa, len(na), k), lengths(rb, b, wb, len(nb), k)
    by_x, by_y = np.argsort(-x, kind="stable"), np.argsort(-y, kind="stable")  # rows in order of their lengths over common terms
    x, y = x[by_x], y[by_y]
    ra, rb = np.argsort(by_x)[ra], np.argsort(by_y)[rb]
    common_a, common_b = np.zeros((len(na), k)), np.zeros((len(nb), k))
    common_a[ra[a < k], a[a < k]], common_b[rb[b < k], b[b < k]] = wa[a < k], wb[b < k]

    rare = np.flatnonzero(b >= k)
    rare = rare[np.argsort(b[rare], kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(b[rare], minlength=len(terms)))])
    rb, wb = rb[rare], wb[rare]
    rare = np.flatnonzero((a >= k) & (starts[a + 1] > starts[a]))
    rare = rare[np.argsort(ra[rare], kind="stable")]
    a, ra, wa = a[rare], ra[rare], wa[rare]
    rows = np.concatenate([[0], np.cumsum(np.bincount(ra, minlength=len(na)))])

    n, out = len(nb), []
    step = max(1, cells // n)
    for low in range(0, len(na), step):
        high = min(low + step, len(na))
        own = slice(rows[low], rows[high])
        first = starts[a[own]]
        many = starts[a[own] + 1] - first
        met = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        part = np.bincount(np.repeat((ra[own] - low) * n, many) + rb[met], np.repeat(wa[own], many) * wb[met], minlength=(high - low) * n).astype(float, copy=False)
        reach = np.multiply.outer(x[low:high], y).ravel()
        reach += part
        hit = np.flatnonzero(reach >= least - 1e-9)
        i, j = np.divmod(hit, n)
        sims = part[hit]
        wide = int(np.searchsorted(-y, -least / max(x[low], 1e-300), side="right"))
        dense, rest = np.flatnonzero(j < wide), np.flatnonzero(j >= wide)
        if len(dense):
            sims[dense] += (common_a[low:high] @ common_b[:wide].T)[i[dense], j[dense]]
        for c in range(0, len(rest), 4096):
            some = rest[c : c + 4096]
            sims[some] += np.einsum("ij,ij->i", common_a[low + i[some]], common_b[j[some]])
        kept = sims >= least
        out.append((by_x[low + i[kept]], by_y[j[kept]], sims[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def unit(column: str):
    """A dense vector divided by its length."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(column, lambda x: x.cast("double") / norm)


def dense_edges(vectors: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """(i, j, sim) of dense unit vectors (vec_id, u) with a cosine of ``least`` or
    more, i < j: blocks of rows meet once each and are multiplied in numpy; only
    the edges come out. With a column ``within``, only vectors of the same value
    meet, and only their blocks are made. Each task holds two blocks."""
    near = F.col("within").cast("string") if "within" in vectors.columns else F.lit("")
    laid = vectors.select("vec_id", "u", F.coalesce(near, F.lit("")).alias("w"))
    sizes = laid.groupBy("w").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = laid.join(sizes, "w").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("vec_id", "u", "w", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, p, q = key
        left, right = group[group["b"] == p], group[group["b"] == q]
        if left.empty or right.empty:
            return pd.DataFrame({"i": [], "j": [], "sim": []})
        sims = np.stack(left["u"].to_numpy()) @ np.stack(right["u"].to_numpy()).T
        a, b = np.nonzero(sims >= least)
        x, y = left["vec_id"].to_numpy()[a], right["vec_id"].to_numpy()[b]
        out = pd.DataFrame({"i": np.minimum(x, y), "j": np.maximum(x, y), "sim": sims[a, b]})
        return out[(x < y) if p == q else slice(None)]

    return dealt.groupBy("w", "p", "q").applyInPandas(meet, "i long, j long, sim double")


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Normalised means of dense unit vectors, in long form (by, k, x)."""
    each = vectors.select(by, F.posexplode("u").alias("k", "x")).groupBy(by, "k").agg(F.avg("x").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(by)))
    return each.withColumn("x", F.col("x") / norm)


def centroid_similarity(centers: DataFrame, by: str) -> DataFrame:
    """Cosines of all pairs of centroids, of which there are as many as themes."""
    a, b = centers.select(F.col(by).alias("a"), "k", F.col("x")), centers.select(F.col(by).alias("b"), "k", F.col("x").alias("y"))
    return a.join(b, "k").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("sim"))


def cohesion(vectors: DataFrame, by: str) -> DataFrame:
    """Mean pairwise cosine in each group of unit vectors, from the length of
    their sum, without pairs; a single vector has 0.5."""
    sums = vectors.select(by, F.posexplode("u").alias("k", "x")).groupBy(by, "k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    whole = sums.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("n").alias("n"))
    value = (F.col("s2") - F.col("q")) / (F.col("n") * (F.col("n") - 1))
    return whole.select(by, F.col("n").alias("members"), F.round(F.when(F.col("n") < 2, 0.5).otherwise(value), 6).alias("cohesion"))


def second_pass(first: DataFrame, second: DataFrame, agree: float = 0.6) -> DataFrame:
    """For each theme the second clustering's theme with the best Jaccard overlap
    of members, from (member, theme_id) tables; sizes, not sets, are joined."""
    na, nb = first.groupBy("theme_id").agg(F.count("*").alias("na")), second.groupBy(F.col("theme_id").alias("other")).agg(F.count("*").alias("nb"))
    met = first.join(second.select("member", F.col("theme_id").alias("other")), "member").groupBy("theme_id", "other").agg(F.count("*").alias("both"))
    scored = met.join(na, "theme_id").join(nb, "other").withColumn("jaccard", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6))
    best = Window.partitionBy("theme_id").orderBy(F.desc("jaccard"), "other")
    top = scored.withColumn("r", F.row_number().over(best)).where("r = 1")
    return top.select("theme_id", "other", "jaccard", (F.col("na") - F.col("both")).alias("missing"), (F.col("nb") - F.col("both")).alias("gained"), (F.col("jaccard") >= agree).alias("agrees"))


def name_jaccard(names: DataFrame, least: float = 0.5, top: int = 15) -> DataFrame:
    """Pairs of names by the overlap of their words, met over shared words."""
    words = names.select("id", F.array_distinct(F.split(F.lower("name"), r"\s+")).alias("w"))
    each = words.select("id", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = each.select(F.col("id").alias("a"), F.col("n").alias("na"), "word"), each.select(F.col("id").alias("b"), F.col("n").alias("nb"), "word")
    met = a.join(b, "word").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    value = F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6)
    return met.select("a", "b", value.alias("jaccard")).where(F.col("jaccard") >= least).orderBy(F.desc("jaccard"), "a", "b").limit(top)


def leader_clusters(nodes: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Leader clustering: in order of ``ord`` a node joins the earliest leader
    among its neighbours or, without one, becomes a leader. (id, ord) and
    (i, j) -> (id, leader).

    The leaders are the lexicographically first maximal independent set, found
    in rounds: a node leads once no undecided or leading neighbour is before it,
    and a neighbour of a leader never leads. Rounds are few (about log n); each
    is kept in the shared folder."""
    names = nodes.select("id", "ord")
    both = edges.select(F.col("i").alias("id"), F.col("j").alias("other")).unionByName(edges.select(F.col("j").alias("id"), F.col("i").alias("other")))
    other = names.select(F.col("id").alias("other"), F.col("ord").alias("other_ord"))
    earlier = keep(both.join(names, "id").join(other, "other").where("other_ord < ord").select("id", "other", "other_ord"), "earlier")
    state = keep(names.select("id", "ord", F.lit(None).cast("boolean").alias("leads")), "state")
    for _ in range(most_rounds):
        before = state
        seen = earlier.join(state.select(F.col("id").alias("other"), "leads"), "other").groupBy("id").agg(
            F.coalesce(F.max("leads"), F.lit(False)).alias("led"), F.count_if(F.col("leads").isNull()).alias("open")
        )
        judged = state.join(seen, "id", "left").fillna(0, ["open"]).withColumn("led", F.coalesce("led", F.lit(False)))
        leads = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("led"), False).when(F.col("open") == 0, True)
        state = keep(judged.select("id", "ord", leads.alias("leads")), "state")
        drop(before)
        if state.where("leads IS NULL").limit(1).count() == 0:
            break
    leaders = state.where("leads").select(F.col("id").alias("other"))
    chosen = earlier.join(leaders, "other").groupBy("id").agg(F.min_by("other", "other_ord").alias("leader"))
    return state.join(chosen, "id", "left").select("id", F.when(F.col("leads"), F.col("id")).otherwise(F.col("leader")).alias("leader"))


def contradictions(codes: DataFrame, edges: DataFrame, sensitivity: float = 0.5, top: int = 60) -> DataFrame:
    """Pairs of one theme that say similar things with opposite valence: (id,
    theme_id, participant, valence) and similarity edges (i, j, sim)."""
    side = lambda end: codes.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("theme_id", "participant", "valence")])
    gap = F.round(F.abs(F.col("valence_i") - F.col("valence_j")), 6)
    met = edges.join(side("i"), "i").join(side("j"), "j").where("theme_id_i = theme_id_j").withColumn("gap", gap)
    hit = met.where((F.col("gap") >= round(1.25 - 0.8 * sensitivity, 6)) & (F.col("sim") >= 0.34 - 0.14 * sensitivity))
    across = F.when(F.col("participant_i") != F.col("participant_j"), 1.25).otherwise(0.85)
    severity = F.round(F.least(F.lit(1.0), 1.6 * F.col("sim") * F.col("gap") / 2 * across * 2.2), 6)
    return hit.select("i", "j", F.col("theme_id_i").alias("theme_id"), "gap", severity.alias("severity")).orderBy(F.desc("severity"), "i", "j").limit(top)


def opposed_themes(similar: DataFrame, means: DataFrame, least_sim: float = 0.2, least_gap: float = 0.55) -> DataFrame:
    """Similar themes (a, b, sim) with opposite mean valences (theme_id, mean)."""
    left, right = means.select(F.col("theme_id").alias("a"), F.col("mean").alias("ma")), means.select(F.col("theme_id").alias("b"), F.col("mean").alias("mb"))
    gap = F.round(F.abs(F.col("ma") - F.col("mb")), 6)
    met = similar.join(left, "a").join(right, "b").withColumn("gap", gap).where((F.col("sim") >= least_sim) & (F.col("gap") >= least_gap))
    return met.select("a", "b", "gap", F.round(F.least(F.lit(1.0), 1.9 * F.col("sim") * F.col("gap")), 6).alias("severity"))


def concept_space(related: DataFrame, strength: DataFrame, least: float = 0.18) -> DataFrame:
    """Concepts: leader clusters of terms whose co-occurrence profiles are alike,
    strongest terms first. (a, b, strength) and (term, strength) -> (term, concept)."""
    profiles = normalise(related.select(F.col("a").alias("doc"), F.col("b").alias("term"), F.col("strength").alias("weight")))
    edges = sparse_edges(profiles, least)
    nodes = strength.select(F.col("term").alias("id"), F.struct((-F.col("strength")).alias("s"), "term").alias("ord"))
    return leader_clusters(nodes, edges).select(F.col("id").alias("term"), F.col("leader").alias("concept"))


def refine(vectors: DataFrame, members: DataFrame, threshold: float, passes: int = 2) -> DataFrame:
    """Reassigns long unit vectors (doc, term, weight) to the cluster with the
    most similar centroid if that is at 0.75 of the threshold or more, the
    smallest cluster id of equals; others stay. (doc, cluster) in and out; with a
    column ``within``, only among the clusters of the same value; with a column
    ``m``, a member counts so many times in its cluster's centroid."""
    other = [c for c in members.columns if c == "within"]
    kept = [c for c in members.columns if c in ("within", "m")]
    times = F.col("m") if "m" in members.columns else F.lit(1)
    for _ in range(passes):
        laid = vectors.join(members, "doc")
        centers = normalise(laid.select(F.col("cluster").alias("doc"), "term", (F.col("weight") * times).alias("weight"))).withColumnsRenamed({"doc": "cluster", "weight": "c"})
        centers = centers.join(members.select("cluster", *other).distinct(), "cluster") if other else centers
        sims = laid.drop("cluster", "m").join(centers, ["term", *other]).groupBy("doc", "cluster").agg(F.sum(F.col("weight") * F.col("c")).alias("sim"))
        best = sims.groupBy("doc").agg(F.min_by(F.struct("cluster", "sim"), F.struct((-F.round("sim", 9)).alias("s"), "cluster")).alias("b"))
        met = members.join(best, "doc", "left")
        moved = F.when(F.col("b.sim") >= 0.75 * threshold, F.col("b.cluster")).otherwise(F.col("cluster"))
        members = keep(met.select("doc", moved.alias("cluster"), *kept), "refined")
    return members


def cluster(vectors: DataFrame, nodes: DataFrame, edges: DataFrame, threshold: float, passes: int = 2) -> DataFrame:
    """Leader clusters of nodes (id, within, and m if a node stands for so many),
    most central first, refined, and those of more than a fifth of their ``within``
    (0.18, and 12) cut again at a tighter threshold where that leaves two parts of
    three or more. Edges join nodes of one ``within``. All clusters of a level are
    cut at once; the threshold grows to 0.8, so levels are few. (doc, within, m,
    cluster) with ids of type string."""
    nodes = nodes if "m" in nodes.columns else nodes.withColumn("m", F.lit(1).cast("bigint"))
    times = nodes.select("id", "m")
    ends = edges.select(F.col("i").alias("id"), F.col("j").alias("_o"), "sim").unionByName(edges.select(F.col("j").alias("id"), F.col("i").alias("_o"), "sim"))
    central = ends.join(times.withColumnRenamed("id", "_o"), "_o").groupBy("id").agg(F.sum(F.col("sim") * F.col("m")).alias("c"))
    value = F.round(F.coalesce("c", F.lit(0.0)) + F.col("m") - 1, 9)
    ordered = nodes.join(central, "id", "left").select("id", F.struct((-value).alias("c"), "id").alias("ord"))
    members = leader_clusters(ordered, edges).join(nodes, "id").select(F.col("id").alias("doc"), F.col("leader").alias("cluster"), "within", "m")
    members = refine(vectors, members, threshold, passes)
    if threshold >= 0.8:
        return members
    sizes = members.groupBy("within", "cluster").agg(F.sum("m").alias("size"))
    whole = sizes.groupBy("within").agg(F.sum("size").alias("n"))
    large = sizes.join(whole, "within").where(F.col("size") > F.greatest(F.lit(12), F.floor(0.18 * F.col("n")))).select("cluster")
    cut = keep(members.join(large, "cluster", "left_semi").select(F.col("doc").alias("id"), F.col("cluster").alias("within"), "m"), "oversize")
    if not cut.limit(1).count():
        return members
    tighter = min(0.8, 1.6 * threshold)
    i, j = (cut.select(F.col("id").alias(c), F.col("within").alias(f"w{c}")) for c in "ij")
    inside = edges.where(F.col("sim") >= tighter).join(i, "i").join(j, "j").where("wi = wj").select("i", "j", "sim")
    parts = cluster(vectors, cut, keep(inside, "edges"), tighter, 1)
    clean = parts.groupBy("within", "cluster").agg(F.sum("m").alias("size")).where("size >= 3").groupBy("within").agg(F.count("*").alias("k")).where("k >= 2")
    parts = parts.join(clean, "within", "left_semi").select("doc", F.col("cluster").alias("part"))
    return keep(members.join(parts, "doc", "left").select("doc", F.coalesce("part", "cluster").alias("cluster"), "within", "m"), "clusters")


def cluster_copies(vectors: DataFrame, nodes: DataFrame, threshold: float, passes: int = 2) -> DataFrame:
    """(doc, cluster) of nodes (id, within): equal vectors of one ``within`` are
    clustered as one. A node without a vector is a cluster of its own."""
    laid = vectors.join(nodes.select(F.col("id").alias("doc"), "within"), "doc")
    one, copies = distinct_vectors(laid.withColumn("term", F.concat_ws("\x1f", F.col("within"), F.col("term"))))
    one = one.select("doc", F.expr("substring(term, length(within) + 2)").alias("term"), "weight", "within")
    chosen = copies.where("doc = copy_of").select(F.col("doc").alias("id"), "m").join(nodes, "id")
    members = cluster(one.drop("within"), chosen, keep(sparse_edges(one, threshold), "edges"), threshold, passes)
    every = copies.join(members.select(F.col("doc").alias("copy_of"), "cluster"), "copy_of").select("doc", "cluster")
    alone = nodes.select(F.col("id").alias("doc")).join(copies.select("doc"), "doc", "left_anti")
    return every.unionByName(alone.withColumn("cluster", F.col("doc")))


def sparse_cohesion(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """``cohesion`` of long unit vectors (doc, term, weight) by (doc, cluster); a
    member without terms is like no other."""
    x = F.col("weight")
    sums = vectors.join(members, "doc").groupBy("cluster", "term").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    whole = sums.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"))
    n = members.groupBy("cluster").agg(F.count("*").alias("members"))
    value = F.coalesce(F.col("s2") - F.col("q"), F.lit(0.0)) / (F.col("members") * (F.col("members") - 1))
    return n.join(whole, "cluster", "left").select("cluster", "members", F.round(F.when(F.col("members") < 2, 0.5).otherwise(value), 6).alias("cohesion"))
