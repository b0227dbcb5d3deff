import io
import zipfile

import pytest
from pyspark.sql import functions as F

from verbatim_spark.sources import files, provider, reviews, sinks

NOW = "2026-01-31 00:00:00"


def test_relative_times(spark):
    said = ["2 weeks ago", "a month ago", "yesterday", "2026-01-01", "31/12/2025", "nonsense", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = {r["i"]: r["m"] for r in rows.select("i", F.round(reviews.months_ago(F.col("s"), NOW), 3).alias("m")).collect()}
    assert [got[i] for i in range(7)] == [0.46, 1.0, 0.033, 0.986, 1.018, None, None]


def test_line_format(spark):
    raw = spark.createDataFrame([("5 | Lovely place, would return (2 weeks ago)\n\n1 | Rude staff\nno stars here",)], "raw string")
    rows = [tuple(r) for r in reviews.parse_lines(raw).collect()]
    assert rows == [(5.0, "Lovely place, would return", "2 weeks ago"), (1.0, "Rude staff", None), (None, "no stars here", None)]


def test_blocks_json_and_records(spark):
    block = "(Review 1)\n*Ann B (3 days ago)*\nGood coffee and cake\n(Review 2)\n*Bo (1 year ago)*\nBad"
    rows = reviews.parse_blocks(spark.createDataFrame([(block,)], "raw string")).collect()
    assert [tuple(r) for r in rows] == [("Ann B", "3 days ago", "Good coffee and cake")]
    data = '{"reviews": [{"stars": "4/5", "text": "Nice", "when": "today"}, "only text"]}'
    rows = reviews.parse_json(spark.createDataFrame([(data,)], "raw string")).collect()
    assert [(r["rating"], r["text"]) for r in rows] == [(4.0, "Nice"), (None, "only text")]
    sheet = spark.createDataFrame([("Ann", "4.5", "Good<br>food", "a.jpg, b.jpg"), ("Bo", "x", "", "")], ["author_title", "Review_Rating", "review_text", "review_img_urls"])
    rows = reviews.from_records(sheet).collect()
    assert [(r["reviewer"], r["rating"], r["text"], r["photo_count"]) for r in rows] == [("Ann", 4.5, "Good\nfood", 2)]


def test_sniffing(spark):
    raws = ['[{"a":1}]', "rating,review,date\n5,ok,today", "(Review 1)\nx", "5 | fine"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    assert [r["f"] for r in rows.orderBy("i").select(reviews.sniff(F.col("raw")).alias("f")).collect()] == ["json", "csv", "block", "lines"]


def test_place_url(spark):
    url = "https://maps.example.com/maps/place/The+Old+Mill/@51.5,-0.12,17z/data=!1s0x4876:0xffffffffffffffff"
    row = spark.createDataFrame([(url,)], "u string").select(*[c.alias(n) for n, c in reviews.place_ids(F.col("u")).items()]).first()
    assert row["name"] == "The Old Mill" and row["cid"] == "18446744073709551615" and row["lat"] == 51.5
    assert row["feature_id"] == "0x4876:0xffffffffffffffff"


def test_files(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(25))
    (tmp_path / "a.txt").write_bytes(("﻿" + words).encode())
    (tmp_path / "b.txt").write_bytes((words + " caf\xe9").encode("cp1252"))
    (tmp_path / "c.txt").write_bytes(b"too short")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:p><w:t>{words} &amp; more</w:t></w:p><w:p>end</w:p>")
    rows = {r["participant_label"]: r["raw_text"] for r in files.read_transcripts(spark, str(tmp_path)).collect()}
    assert rows == {"P1": words, "P2": words + " café", "P3": words + " & more\nend"}


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b"), (2, None)], "n int, s string")
    data = sinks.workbook({"Codebook": df, "codebook": df.limit(1)})
    (tmp_path / "x.xlsx").write_bytes(data)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    rows = files.read_xlsx(spark, str(tmp_path))
    assert {(r["sheet"], r["row"]): r["cells"] for r in rows.collect()}[("Codebook", 2)] == ["1", "a<b"]
    assert sorted(r["record"]["n"] for r in files.records(rows).collect()) == ["1", "1", "2"]


def test_sheet_names_and_sinks(spark, tmp_path):
    assert sinks.sheet_names(["A" * 40, "A" * 40, "x/y"]) == ["A" * 31, "A" * 27 + " (2)", "x y"]
    df = spark.createDataFrame([("p", 1), ("q", 2)], "k string, v int")
    sinks.replace_partitions(df, str(tmp_path / "t"), ["k"])
    sinks.replace_partitions(spark.createDataFrame([("q", 3)], "k string, v int"), str(tmp_path / "t"), ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("p", 1), ("q", 3)]
    assert sinks.insert_ignore(df, df.limit(1), ["k"]).count() == 1


def test_payloads(spark):
    review = '{"author_title": "Ann", "review_rating": 4, "review_text": "Good<br/>food", "review_photos": ["a"]}'
    for data in (f'{{"data": [{{"name": "Mill", "reviews_data": [{review}, {{"review_text": ""}}]}}]}}', f'{{"data": [[{{"name": "Mill", "reviews_data": [{review}]}}]]}}'):
        rows = reviews.unwrap_payload(spark.createDataFrame([(data,)], "raw string")).collect()
        assert [(r["business"], r["reviewer"], r["rating"], r["text"], r["photo_count"]) for r in rows] == [("Mill", "Ann", 4.0, "Good\nfood", 1)]


def test_report_document(spark, tmp_path):
    blocks = spark.createDataFrame([(2, "Second", "a < b"), (1, "First", None)], "ord int, heading string, body string")
    (tmp_path / "r.docx").write_bytes(sinks.document(blocks, "Report"))
    assert files.docx_text((tmp_path / "r.docx").read_bytes()).split("\n") == ["Report", "First", "", "Second", "a < b"]


def test_append(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    for _ in range(2):
        sinks.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_provider_pages_and_waiting(spark):
    review = lambda text: {"author_title": "Ann", "review_rating": 4, "review_text": text, "review_datetime_utc": "2026-01-01"}
    answers = [(202, {}), (200, {"status": "Pending"}), (200, {"data": [{"name": "Mill", "reviews_data": [review("one")]}], "next_page_token": "t"}), (200, {"data": [{"name": "Mill", "reviews_data": [review("two"), review("")]}]})]
    asked, slept = [], []

    def call(request):
        asked.append(request)
        return answers[len(asked) - 1]

    rows = provider.fetch(spark, call, {"place": "x"}, NOW, sleep=slept.append).collect()
    assert sorted(r["text"] for r in rows) == ["one", "two"] and slept == [3.0, 4.5] and asked[-1] == {"place": "x", "page_token": "t"}
    with pytest.raises(TimeoutError):
        provider.wait_for(lambda _: (202, {}), {}, slept.append)
    assert sum(slept[2:]) == pytest.approx(300) and max(slept) == 15.0
    with pytest.raises(OSError, match="500"):
        provider.wait_for(lambda _: (500, {}), {}, slept.append)


def test_short_links(spark):
    links = ["https://maps.app.goo.gl/abc", "https://goo.gl/maps/abc", "https://evil.example/maps.app.goo.gl", "http://169.254.0.1/x", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i int, u string").select("i", files.allowed_link(F.col("u"), ["maps.app.goo.gl", "goo.gl"]).alias("ok")).collect()
    assert {r["i"]: r["ok"] for r in got} == {0: True, 1: True, 2: False, 3: False, 4: False}
