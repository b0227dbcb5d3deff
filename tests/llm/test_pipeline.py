import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from verbatim_spark.llm import pipeline, simhash

TABLES = "/root/testdata/sf0.001"


def small(spark):
    other = "Nothing of the kind happened in the old town that day, so people went home early and slept well."
    rows = [
        (1, "The quick brown fox jumps over the lazy dog while the sun shines", "en", "s", 10), (2, "The quick brown fox jumps over the lazy dog while the sun shines", "en", "s", 10),
        (3, None, "en", "s", 0), (4, "12 !!", "en", "s", 5), (5, other, "en", "t", 20), (5, other, "en", "t", 20), (6, f"token = Zx81jd7Kx0qq {other[::-1]}", "en", "t", 20),
        (None, "a text without an id that is kept", "en", None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = small(spark)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, TABLES)
    assert kept.columns == corpus_pipeline.COLUMNS and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "5", "5", "6", "None"]
    deduped = stages["near_duplicates"](spark, kept, TABLES)
    assert sorted(str(r["doc_id"]) for r in deduped.collect()) == ["1", "5", "6", "None"]
    item = spark.read.parquet(f"{TABLES}/benchmark.parquet").orderBy("item_id").first()["text"]
    copied = deduped.withColumn("text", F.when(F.col("doc_id") == 1, F.lit(item)).otherwise(F.col("text")))
    clean = stages["decontamination"](spark, copied, TABLES)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["5", "6", "None"]
    masked = {r["doc_id"]: r for r in stages["secrets"](spark, clean, TABLES).collect()}
    assert masked[6]["text"].startswith("[secret] ") and masked[6]["n_chars"] == len(masked[6]["text"])
    final = stages["encoding"](spark, stages["secrets"](spark, clean, TABLES), TABLES).collect()
    assert len(final) == 3 and all(r["n_tokens"] == len(r["ids"]) > 0 for r in final)


def test_rows_are_judged_by_id_and_text(spark):
    item = spark.read.parquet(f"{TABLES}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = "Nothing of the kind happened in the old town that day, so people went home early and slept well."
    rows = [
        (1, "A text that shares its id with another one, which says something else entirely.", "en", "s", 1), (1, clean, "en", "s", 2), (1, clean, "en", "s", 2),
        (None, item, "en", "s", 3), (7, item, "en", "s", 4), (7, "A clean text under the id of a contaminated one, which has to stay.", "en", "s", 5), (2, clean, "en", "t", 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    deduped = sorted((str(r["doc_id"]), r["n_chars"]) for r in stages["near_duplicates"](spark, docs, TABLES).collect())
    assert deduped == [("1", 1), ("1", 2), ("7", 4), ("7", 5)]
    kept = sorted((str(r["doc_id"]), r["n_chars"]) for r in stages["decontamination"](spark, docs, TABLES).collect())
    assert kept == [("1", 1), ("1", 2), ("1", 2), ("2", 2), ("7", 5)]


def test_language_fills_in_and_rejects(spark):
    english = ["the cat sat on the mat and the dog ran to the house", "this is what they said about the weather", "there is nothing more to think about"]
    finnish = ["kissa istui matolla ja koira juoksi taloon", "he sanoivat sen mitä sää teki eilen", "ei ole enää mitään mitä ajatella"]
    rows = [(4 * i + k, t, lang, "s", 1) for i in range(30) for k, (t, lang) in enumerate([*((t, "en") for t in english), (finnish[i % 3], "fi")])] + [(1000, "the house and the dog sat there", None, "s", 1), (1001, "12 34", "en", "s", 1), (1002, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["lang"] for r in dict(corpus_pipeline.STAGES)["language"](spark, docs, TABLES).collect()}
    assert kept[1000] == "en" and 1001 not in kept and 1002 not in kept and set(kept.values()) == {"en"} and len(kept) == 91


def test_empty(spark):
    docs = small(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, TABLES)
        assert after.count() == 0
        docs = after if after.columns == corpus_pipeline.COLUMNS else docs


def test_near_duplicates_keep_one_of_each_group(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, shingle=pipeline.NEAR_SHINGLE, radius=pipeline.NEAR_RADIUS).collect()}
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, TABLES).collect()}
    assert kept == {i for i, c in groups.items() if i == c}


def test_near_copies_are_caught_and_others_stay(spark):
    """Texts of 150 words of their own; copies with two words changed at random."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 150)) for _ in range(60)]
    copies = []
    for t in texts[:40]:
        line = t.split()
        for at in rng.choice(150, 2, replace=False):
            line[at] = "changed"
        copies.append(" ".join(line))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + copies)]
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), TABLES).collect()}
    assert set(range(60)) <= kept and len(kept) <= 60 + 4
