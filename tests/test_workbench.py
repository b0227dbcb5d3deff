import io
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatim_spark.context import Controls, Engine, ReviewEngine
from verbatim_spark.methodologies import METHODOLOGIES
from verbatim_spark.operators import prose, readings, vectors
from verbatim_spark.operators import workbench as wb
from verbatim_spark.sources import sinks, workbooks


def apps(spark, rows):
    return spark.createDataFrame(rows, "quotation_id long, document_id long, code_id string, created_by string")


def test_retrieval_invariants(spark):
    a = apps(spark, [(1, 1, "x", "user"), (1, 1, "y", "user"), (2, 1, "x", "user"), (3, 2, "z", "user"), (1, 1, "x", "user")])
    ids = {op: {r["quotation_id"] for r in wb.retrieve(a, ["x", "y"], op).collect()} for op in ("all", "any", "none", "only")}
    assert ids == {"all": {1}, "any": {1, 2}, "none": {3}, "only": {1}}
    assert {r["quotation_id"] for r in wb.retrieve(a, ["x", "y"], "all", "document").collect()} == {1, 2}


def test_agreement(spark):
    same = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "a")], "h string, m string")
    assert wb.krippendorff_alpha(same).first()["alpha"] == 1.0 and wb.cohens_kappa(same).first()["kappa"] == 1.0
    single = spark.createDataFrame([("a", "a"), ("a", "a")], "h string, m string")
    assert wb.cohens_kappa(single).first()["kappa"] is None
    assert wb.krippendorff_alpha(single.limit(1)).first()["alpha"] is None


def test_edits(spark):
    a = apps(spark, [(1, 1, "x", "user"), (1, 1, "y", "auto"), (2, 1, "y", "auto")])
    mapping = spark.createDataFrame([("x", "y")], "code_id string, keep_id string")
    links = spark.createDataFrame([("x", "y"), ("x", "z")], "src string, dst string")
    merged, kept = wb.merge_codes(a, links, mapping)
    assert merged.count() == 2 and [tuple(r) for r in kept.collect()] == [("y", "z")]
    assert wb.retained(a).count() == 1
    assert wb.apply_codes(a, a).count() == 3


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.1, 0.9])], "vec_id long, e array<double>").select("vec_id", vectors.unit("e").alias("u"))
    edges = vectors.dense_edges(v, 0.9, block=2)
    assert {(r["i"], r["j"]) for r in edges.collect()} == {(0, 1), (2, 3)}
    nodes = v.selectExpr("vec_id AS id", "vec_id AS ord")
    assert {r["id"]: r["leader"] for r in vectors.leader_clusters(nodes, edges).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    # 1 is next to both 0 and 2; 0 leads, so 1 doesn't and 2 does.
    chain = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "i long, j long, sim double")
    assert {r["id"]: r["leader"] for r in vectors.leader_clusters(nodes, chain).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_saturation_counts_each_item_once(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "c")], "document_id long, item string")
    got = readings.saturation(pairs).orderBy("document_id").collect()
    assert [r["new"] for r in got] == [2, 0, 1] and [r["seen"] for r in got] == [2, 2, 3]


def test_indicators_of_reviews_with_known_valence(spark):
    rows = spark.createDataFrame([(1, "b", 5, 0.5, 1.0, True), (2, "b", 1, 0.6, 14.0, False)], "review_id long, business string, rating int, valence double, months double, responded boolean")
    tables = ReviewEngine().analyse(rows)
    kpi = tables["kpis"].first()
    assert -100 <= kpi["nss"] <= 100 and kpi["reviews"] == 2
    assert tables["rating_vs_text"].count() == 1


def engine_rows(reviews):
    rows = {}
    for r in reviews.collect():
        rows.setdefault(r["business"], []).append(r)
    return rows


SAID = [
    "I waited for three long hours in the cold waiting room and nobody told me anything.", "The waiting room staff were helpful and kind to me in the end.",
    "Because of the delay I could not get home and I felt really anxious about my children.", "They should improve the booking system because it never works for anyone.",
    "The nurse listened to me and explained the treatment in a very clear way.", "I was told to go home but then suddenly the pain got much worse.",
    "In the end we managed to see the doctor and I felt relieved and grateful.", "The waiting room was cold and the staff were rude to my family.",
]


def interviews(spark):
    rows = []
    for d in range(4):
        lines = [f"Interviewer: What happened next?\nP{d + 1}: {SAID[(d + k) % 8]} {SAID[(3 * d + 2 * k) % 8]}" for k in range(5)]
        rows.append((f"d{d}", "\n".join(lines)))
    return spark.createDataFrame(rows, "document_id string, text string")


def test_all_methodologies_read_one_analysis(spark):
    out = Engine(spark, Controls(similarity=0.2, min_quotes=2)).analyse(interviews(spark), list(METHODOLOGIES))
    rows = {name: df.count() for name, df in out.items() if "." in name}
    assert {n.split(".")[0] for n in rows} == set(METHODOLOGIES)
    empty = {n for n, k in rows.items() if not k}
    # What depends on the text's luck may be empty; the bodies of the readings may not.
    assert not empty & {
        "thematic.themes", "thematic.boundaries", "thematic.defining_quotes", "thematic.keyness", "thematic.phases", "content.scheme", "content.matrix", "content.latent", "content.manifest_terms",
        "content.concordance", "framework.index", "framework.chart", "framework.mapping", "framework.stages", "grounded_theory.open_codes", "grounded_theory.axial", "grounded_theory.paradigm",
        "grounded_theory.core", "grounded_theory.saturation", "experiential.statements", "experiential.cases", "experiential.profile", "experiential.personal_themes", "narrative.arc", "narrative.agency", "narrative.plots", "narrative.cross",
    }
    codes = out["codes"]
    assert codes.where("label = '' OR label IS NULL OR concept IS NULL").count() == 0 and codes.select("open_label").distinct().count() >= codes.select("label").distinct().count()
    sheets = workbooks.project_sheets(out, Controls())
    assert len(sheets) == 12 and sinks.sheet_names(list(sheets)) == list(sheets)
    assert zipfile.ZipFile(io.BytesIO(sinks.workbook({n: sheets[n] for n in ("Project", "Themes", "Codebook")}))).testzip() is None
    blocks = workbooks.report_blocks(out).collect()
    assert len(blocks) == out["themes"].count() + 1 and all("quotations" in r["body"] for r in blocks)
    books = workbooks.codebook_sheets(out["codes"].select("theme_id", "label", "participant", "text"), out["themes"], out["contradictions"], out["idf"])
    assert books["Confidence scores"].count() == out["themes"].count()
    chart = out["framework.chart"]
    assert chart.count() == chart.select("participant").distinct().count() * chart.select("category").distinct().count()


def test_controls_of_confidence_and_participants_decide_the_status(spark):
    rows = [("a", f"p{i}", 0.8, 0.5, 0.5) for i in range(3)] + [("b", "p0", 0.3, -0.5, 0.5), ("b", "p1", 0.3, 0.5, 0.5)]
    codes = spark.createDataFrame(rows, "theme_id string, participant string, confidence double, valence double, cohesion double")
    status = lambda **c: {r["theme_id"]: r["status"] for r in readings.theme_summary(codes, **c).collect()}
    assert status(min_quotes=3, min_participants=2, least_confidence=0.55) == {"a": "confirmed", "b": "review"}
    assert status(min_quotes=2, min_participants=2, least_confidence=0.2) == {"a": "confirmed", "b": "confirmed"}
    assert status(min_quotes=9, min_participants=9, least_confidence=0.2) == {"a": "candidate", "b": "candidate"}


def test_merge_suggestions_from_stored_codes(spark):
    rows = [(f"{t}{i}", t, ["wait", "room", "cold", w], "waiting room", "neutral", "describing") for t, w in (("a", "staff"), ("b", "nurse")) for i in range(3)] + [("c0", "c", ["price", "bill"], "high price", "anger", "evaluating")]
    codes = spark.createDataFrame(rows, "id string, theme_id string, stems array<string>, phrase string, mood string, intent string")
    assert [(r["a"], r["b"]) for r in Engine(spark).suggest_merges(codes).collect()][:1] == [("a", "b")]


def test_equal_units_are_clustered_once(spark):
    rows = [(f"x{i:03d}", t, 0.5**0.5) for i in range(300) for t in ("same", "words")] + [("y0", "other", 1.0), ("y1", "other", 1.0)]
    v = spark.createDataFrame(rows, "doc string, term string, weight double")
    nodes = v.select(F.col("doc").alias("id"), F.lit("all").alias("within")).distinct().unionByName(spark.createDataFrame([("alone", "all")], "id string, within string"))
    one, copies = vectors.distinct_vectors(v)
    assert one.select("doc").distinct().count() == 2 and copies.count() == 302
    sizes = sorted(r["n"] for r in vectors.cluster_copies(v, nodes, 0.3).groupBy("cluster").agg(F.count("*").alias("n")).collect())
    assert sizes == [1, 2, 300]


def test_review_report_from_pasted_lines(spark):
    demo = engine_rows(ReviewEngine().read(workbooks.demo_reviews(spark), "2026-01-31 00:00:00"))
    assert {k: len(v) for k, v in demo.items()} == {"The Mill": 10, "The Barn": 6}
    mine = "5 | The staff were rude and dismissive and we waited for over an hour (2 weeks ago)\n4 | Lovely food and friendly staff, would recommend (1 month ago)\n1 | Dirty room, broken lift and nobody answered the phone (3 months ago)\n2 | Slow service and a long wait again (8 months ago)"
    theirs = "5 | Excellent service, friendly staff and quick booking (1 week ago)\n5 | Clean rooms and helpful staff, the best value (2 months ago)\n3 | Fair price but the queue was slow (14 months ago)"
    engine = ReviewEngine()
    reviews = engine.read(spark.createDataFrame([("ours", mine), ("rival", theirs)], "business string, raw string"), "2026-01-31 00:00:00")
    assert reviews.count() == 7 and reviews.where("months IS NULL OR rating IS NULL").count() == 0
    out = engine.report(reviews, "ours", "rival")
    rows = {name: df.collect() for name, df in out.items()}
    assert len(rows) >= 15 and all(rows[n] for n in ("kpis", "temporal", "trend", "content", "journey", "bottlenecks", "issues", "dimensions", "ranking", "findings", "summary", "matrix", "comparison", "kpi_delta"))
    assert len(workbooks.review_sheets(out)) == 17
    line = prose.headline(out["kpis"], out["dimensions"], "ours", "rival", "business", "dimension").first()
    assert line["gap"] < -5 and line["headline"].startswith("rival leads on net sentiment by ")
    # Five stars on a complaint: the text contradicts them.
    assert any(r["kind"] == "high stars" and r["rating"] == 5.0 for r in rows["rating_vs_text"])
    assert {r["business"]: r["reviews"] for r in rows["kpis"]} == {"ours": 4, "rival": 3} and len(rows["dimensions"]) == 10
    assert [r["business"] for r in rows["ranking"]][0] == "rival"


def test_running_total_over_ranges(spark):
    rows = [(i * 37 % 1000, i) for i in range(1000)]
    got = readings.running_total(spark.createDataFrame(rows, "k long, v long").repartition(7), "k", "v", "total").orderBy("k").collect()
    total = 0
    for place, (k, v) in enumerate(sorted(rows), 1):
        total += v
        assert (got[place - 1]["total"], got[place - 1]["place"]) == (total, place)


def test_sparse_edges_find_all_pairs(spark):
    rng = np.random.default_rng(6)
    dense = rng.random((40, 12)) * (rng.random((40, 12)) < 0.4)
    dense[:, 0] += 0.2  # a term that all have
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows = [(i, f"t{k}", float(dense[i, k])) for i in range(40) for k in range(12) if dense[i, k]]
    got = {(r["i"], r["j"]): r["sim"] for r in vectors.sparse_edges(spark.createDataFrame(rows, "doc long, term string, weight double"), 0.6).collect()}
    sims = dense @ dense.T
    assert got.keys() == {(i, j) for i in range(40) for j in range(i + 1, 40) if sims[i, j] >= 0.6}
    assert all(abs(v - sims[i, j]) < 1e-9 for (i, j), v in got.items())


def test_sparse_edges_join_no_pairs(spark):
    """All vectors share terms with most others, few are alike: pairs that only share a term are no rows of any join."""
    rng = np.random.default_rng(3)
    dense = np.array([rng.permutation([1.0] * 6 + [0.0] * 24) for _ in range(300)]) / np.sqrt(6)
    rows = [(i, f"t{k}", float(dense[i, k])) for i in range(300) for k in range(30) if dense[i, k]]
    edges = vectors.sparse_edges(spark.createDataFrame(rows, "doc long, term string, weight double"), 0.6)
    sims = dense @ dense.T
    assert {(r["i"], r["j"]) for r in edges.collect()} == {(i, j) for i in range(300) for j in range(i + 1, 300) if sims[i, j] >= 0.6}
    assert not re.search(r"\bi#\d+L? < j#\d+L?", edges._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("block", [7, 1000])
def test_sparse_edges_of_common_and_rare_terms(spark, block):
    """Copies, vectors of common terms alone, and ids of strings within groups."""
    rng = np.random.default_rng(9)
    dense = rng.random((90, 700)) * (rng.random((90, 700)) < np.r_[np.full(20, 0.8), np.full(680, 0.01)])
    dense[30:45], dense[50:70, 20:] = dense[30], 0
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows = [(f"d{i}", f"t{k}", float(dense[i, k]), i % 2) for i in range(90) for k in range(700) if dense[i, k]]
    got = {(r["i"], r["j"]): r["sim"] for r in vectors.sparse_edges(spark.createDataFrame(rows, "doc string, term string, weight double, within long"), 0.5, block).collect()}
    sims = dense @ dense.T
    want = {tuple(sorted((f"d{i}", f"d{j}"))): sims[i, j] for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2 and sims[i, j] >= 0.5}
    assert got.keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_controls_are_bounded():
    assert Controls(similarity=3).similarity == 0.95 and Controls(min_quotes=0).min_quotes == 1


def test_refinement_moves_to_the_nearest_centroid(spark):
    rows = [(0, "a", 1.0), (1, "a", 1.0), (2, "b", 1.0), (3, "b", 1.0)]
    v = spark.createDataFrame(rows, "doc long, term string, weight double")
    start = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 0)], "doc long, cluster long")
    assert {r["doc"]: r["cluster"] for r in vectors.refine(v, start, 0.28).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_recoder_keeps_local_coding_on_bad_answers(spark):
    from verbatim_spark.operators.recoder import recode

    def coder(texts):
        if "boom" in texts:
            raise OSError("no network")
        return [{"label": "New", "emotion": "hope", "valence": 0.5, "confidence": 0.9} if t == "ok" else {"label": "x", "emotion": "none", "valence": 9, "confidence": 1} for t in texts]

    codes = spark.createDataFrame([("ok", "old", "neutral", 0.0, 0.5), ("bad", "old", "neutral", 0.0, 0.5), ("boom", "old", "neutral", 0.0, 0.5)], "text string, label string, emotion string, valence double, confidence double")
    got = {r["text"]: (r["label"], r["recoded"]) for r in recode(codes.coalesce(1), coder, batch=1).collect()}
    assert got == {"ok": ("New", True), "bad": ("old", False), "boom": ("old", False)}


def test_clusters_that_hold_too_much_are_cut(spark):
    """Two kinds of seven that share a third term: one cluster at 0.3, two at 0.48."""
    a, b = 0.8, 0.6
    rows = [(f"{k}{i}", t, w) for k in "xy" for i in range(7) for t, w in ((k, a), ("shared", b))]
    v = spark.createDataFrame(rows, "doc string, term string, weight double")
    nodes = v.select(F.col("doc").alias("id"), F.lit("all").alias("within")).distinct()
    got = vectors.cluster(v, nodes, vectors.sparse_edges(v, 0.3), 0.3)
    sets = sorted(sorted(r["docs"]) for r in got.groupBy("cluster").agg(F.collect_list("doc").alias("docs")).collect())
    assert sets == [[f"{k}{i}" for i in range(7)] for k in "xy"]
    loose = spark.createDataFrame([(f"{k}{i}", "one") for k in "xy" for i in range(7)] + [("z", "alone")], "doc string, cluster string")
    mean = (42 * 1 + 49 * b * b) / 91
    assert {r["cluster"]: r["cohesion"] for r in vectors.sparse_cohesion(v, loose).collect()} == {"one": round(mean, 6), "alone": 0.5}


def test_engine_confidence_follows_cohesion(spark):
    """Both themes have the same codes but for how alike their units are."""
    said = ["The garden fence needs paint.", "The garden fence needs paint.", "The garden gate wants oil.", "The garden gate wants oil."]
    docs = spark.createDataFrame([("d", "\n".join(f"P{i}: {x}" for i, x in enumerate(said)))], "document_id string, text string")
    out = Engine(spark, Controls(similarity=0.05, min_quotes=2)).analyse(docs)
    mean = {r["theme_id"]: r["c"] for r in out["codes"].where("theme_id IS NOT NULL").groupBy("theme_id").agg(F.avg("confidence").alias("c")).collect()}
    got = out["themes"].collect()
    assert len(got) == 1 and got[0]["cohesion"] not in (0.5, 1.0)
    assert got[0]["confidence"] == round(mean[got[0]["theme_id"]] * (0.7 + 0.3 * min(2 * got[0]["cohesion"], 1)), 6)
