"""Each registered query, as it is, on a table of nulls, empty and long texts, ties,
repeated rows and ids, and columns with clashing names; and on an empty one."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
import sentencepiece
import xxhash

from verbatim_spark.llm import pieces, queries

from .test_operators import ASSIGN, LONG, TEXTS, lower, words

#: With texts that hold licenses, secrets, another language, and one under a used id.
ROWS = [
    *TEXTS, (9, "another text under a used id: token=abcdefgh, cc by, all rights reserved"), (20, "der hund und die katze sitzen auf der matte " * 4), (21, "the cat and the dog sit on the mat " * 4),
    (24, "der hund und die katze sitzen auf der matte " * 4), (25, "the cat and the dog sit on the mat " * 4), (26, "CC BY 4.0 and GENERAL public License, general public license"), (27, LONG + " tail"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    lang = lambda t: None if not t else "de" if "hund" in t else "en"
    rows = [(i, t, lang(t), f"src{(i or 0) % 3}" if i != 5 else None, len(t or ""), 7, "k", True, 1.5) for i, t in ROWS]
    kind = "doc_id long, text string, lang string, source string, n_chars long, h long, kind string, ghost boolean, score double"
    docs = spark.createDataFrame(rows, kind)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, 0), (9, 0, 1), (9, 1, 0), (None, 1, 1), (12, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    empty = tmp_path_factory.mktemp("empty")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{empty}/{name}.parquet")
    return str(folder), str(empty)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def compare(spark, tables, name, columns, expected):
    """The query's rows, in these columns, are what ``expected`` says of each row."""
    rows = queries.queries()[name](spark, tables[0]).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", *columns)) for r in rows) == Counter((i, *expected(i, t or "")) for i, t in ROWS)


ITEMS = [(0, "fox jumps OVER the lazy dog while the bright sun is shining on the"), (1, "one"), (2, None), (3, "..."), (None, "one"), (4, "jumps lazy fox"), (5, LONG[:400])]


def test_contaminated_documents(spark, tables):
    windows = [(str(i), w[s : s + 13]) for i, t in ITEMS if i is not None for w in [words(t)] if w for s in range(max(1, len(w) - 12))]

    def expected(_, t):
        w, hit, items = words(t), set(), set()
        for item, window in windows:
            for s in (k for k, x in enumerate(w[: len(w) - len(window) + 1]) if x == window[0] and w[k : k + len(window)] == window):
                hit.update(range(s, s + len(window)))
                items.add(item)
        return len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)

    # Two texts under one id are judged apart.
    compare(spark, tables, "op2_decontamination", ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"), expected)


def test_sentencepiece(spark, tables):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())

    def expected(_, t):
        ids = library.encode(t)
        return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))

    compare(spark, tables, "op3_sentencepiece", ("n_tokens", "ids_sha256", "decoded_sha256"), expected)


def test_licenses(spark, tables):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

    def expected(_, t):
        w = words(t)
        places = [(s, label) for p, label in phrases.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        starts = [s for s, _ in places]
        return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))

    compare(spark, tables, "op5_licenses", ("n_words", "n_base", "first_word", "last_word", "base_labels"), expected)
    for r in queries.op5_licenses(spark, tables[0]).collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_simhash(spark, tables):
    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {t: fingerprint(t or "") for _, t in ROWS}
    group = {f: f for f in prints.values()}
    for _ in group:
        for a in group:
            for b in group:
                if (a ^ b).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for i, t in ROWS:
        if i is not None:
            least[group[prints[t]]] = min(i, least.get(group[prints[t]], i))
    rows = queries.op6_simhash(spark, tables[0]).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == Counter((i, f"{prints[t]:016x}", least.get(group[prints[t]])) for i, t in ROWS)


def test_secrets(spark, tables):
    def expected(_, t):
        found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = Counter(k for _, _, k, _ in found)
        return kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found)))

    compare(spark, tables, "op7_secrets", ("n_assign", "n_access", "n_hex", "base_sha256"), expected)
    rows = queries.op7_secrets(spark, tables[0]).collect()
    # One secret in two rows of one repository; both are counted by repository and owner.
    assert {r["frequency"] for r in rows if r["doc_id"] == 9 and "hex" in r["spans"]} == {"1:1,1:1,1:1"}


def test_languages(spark, tables):
    rows = queries.op10_language(spark, tables[0]).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 4 == 2
    assert Counter((r["doc_id"], r["held_out"]) for r in rows) == Counter((i, held(i)) for i, _ in ROWS)
    told = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert told[20] == told[24] == "de" and told[21] == told[25] == "en" and told[2] == told[3] == told[5] == "und" and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("name", ["op1_token_counts", "op4_quality", "op8_pseudo_likelihood"])
def test_equal_texts_have_equal_results(spark, tables, name):
    rows = queries.queries()[name](spark, tables[0]).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS)
    pick = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for c, x in sorted(r.asDict().items()) if c != "doc_id")
    by_id = {r["doc_id"]: pick(r) for r in rows if r["doc_id"] != 9}
    assert by_id[1] == by_id[6] and by_id[2] == by_id[3] and by_id[20] == by_id[24]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_an_empty_table_gives_an_empty_result(spark, tables, name):
    assert queries.queries()[name](spark, tables[1]).count() == 0
