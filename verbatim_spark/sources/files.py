"""Transcripts and spreadsheets from files. Files are read with Spark's
``binaryFile``, so any store that Spark reads will do, and unpacked in workers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.kept import keep
from ..functions.shipping import ship
from ..operators.readings import running_total

# Encodings in the order in which they are tried.
CODECS = ["utf-8-sig", "utf-8", "cp1252", "latin-1"]
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decode_text(data: bytes) -> str:
    """The text in the first encoding that fits; the last one always does."""
    for codec in CODECS:
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            continue
    return ""


def docx_text(data: bytes) -> str:
    """The text of a word processor file, a line a paragraph."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        xml = parts.read("word/document.xml").decode("utf-8", "replace")
    xml = re.sub(r"<w:tab\s*/>", "\t", re.sub(r"</w:p>", "\n", xml))
    return unescape(re.sub(r"<[^>]+>", "", xml)).strip()


def read_transcripts(spark: SparkSession, path: str, least_words: int = 20) -> DataFrame:
    """(document_id, participant_label, raw_text, char_count) of text and .docx
    files. Files of under ``least_words`` words are left out; labels are P1, P2,
    ... in order of path."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [docx_text(bytes(c)) if p.lower().endswith(".docx") else decode_text(bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "raw_text": texts})

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, raw_text string")
    kept = keep(files.where(tx.word_count(F.col("raw_text")) >= least_words), "transcripts")
    # Paths alone are put in order; texts stay where they are.
    places = running_total(kept.select("path", F.lit(1).alias("one")), "path", "one", "n").select("path", "n")
    return kept.join(places, "path").select(
        F.sha2("path", 256).alias("document_id"), F.concat(F.lit("P"), F.col("n").cast("string")).alias("participant_label"),
        "raw_text", F.length("raw_text").alias("char_count"),
    )


def sheet_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook: shared and inline strings, cells put at
    their column, blanks kept."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        names = set(parts.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(parts.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(parts.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(parts.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(f"{_REL}id")].lstrip("/")
            root = ElementTree.fromstring(parts.read(target if target.startswith("xl/") else f"xl/{target}"))
            for number, row in enumerate(root.iter(f"{_MAIN}row"), 1):
                cells: dict[int, str] = {}
                for place, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = column_number(cell.get("r")) if cell.get("r") else place
                    value = cell.findtext(f"{_MAIN}v")
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    cells[at] = value or ""
                out.append((sheet.get("name"), int(row.get("r") or number), [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]))
    return out


def column_number(reference: str) -> int:
    """0 for A1, 27 for AB7."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells array<string>) of workbooks."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(bytes(content))
                yield pd.DataFrame({"path": p, "sheet": [r[0] for r in rows], "row": [r[1] for r in rows], "cells": [r[2] for r in rows]})

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "path string, sheet string, row int, cells array<string>")


def records(rows: DataFrame) -> DataFrame:
    """(path, sheet, row, record map<string,string>): rows by the header above them."""
    first = Window.partitionBy("path", "sheet").orderBy("row")
    headed = rows.withColumns({"header": F.first("cells").over(first), "n": F.row_number().over(first)}).where("n > 1")
    size = F.size("header")
    padded = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    lower = F.transform("header", lambda h: F.lower(F.trim(h)))
    return headed.where(size > 0).select("path", "sheet", "row", F.map_from_arrays(lower, padded).alias("record"))


def allowed_link(url: Column, hosts: list[str]) -> Column:
    """Whether a short link's host is one of those that may be followed."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(hosts), F.lit(False))
