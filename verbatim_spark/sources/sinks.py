"""Writing tables and small workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows of a sheet that are brought to the driver at most.
MOST_ROWS = 100_000


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Insert or replace by key: the keys that df has are written anew, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def insert_ignore(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, one of each key, whose key isn't there yet."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def sheet_names(names: list[str]) -> list[str]:
    """Names that a workbook may have: up to 31 characters, none twice."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", " ", name)[:31] or "Sheet"
        pick, n = base, 2
        while pick.lower() in {o.lower() for o in out}:
            mark = f" ({n})"
            pick, n = base[: 31 - len(mark)] + mark, n + 1
        out.append(pick)
    return out


def workbook(sheets: dict[str, DataFrame], most_rows: int = MOST_ROWS) -> bytes:
    """An .xlsx file with one sheet a table, for reports; a table of more rows
    than ``most_rows`` is refused rather than cut."""
    clean = lambda v: re.sub(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010FFFF]", "", "" if v is None else str(v))
    cell = lambda v: f"<c t=\"inlineStr\"><is><t xml:space=\"preserve\">{escape(clean(v))}</t></is></c>"
    names, bodies = sheet_names(list(sheets)), []
    for df in sheets.values():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"a sheet holds at most {most_rows} rows")
        lines = [df.columns, *rows]
        body = "".join(f"<row r=\"{i}\">{''.join(map(cell, r))}</row>" for i, r in enumerate(lines, 1))
        bodies.append(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    head, many = '<?xml version="1.0" encoding="UTF-8"?>', range(1, len(names) + 1)
    office = "http://schemas.openxmlformats.org"
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{office}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in many) + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="{office}/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{office}/spreadsheetml/2006/main" xmlns:r="{office}/officeDocument/2006/relationships"><sheets>'
        + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(many, names, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{office}/package/2006/relationships">'
        + "".join(f'<Relationship Id="rId{i}" Type="{office}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in many) + "</Relationships>",
    } | {f"xl/worksheets/sheet{i}.xml": head + b for i, b in zip(many, bodies, strict=True)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, body in files.items():
            file.writestr(name, body)
    return out.getvalue()


def document(blocks: DataFrame, title: str, most_rows: int = MOST_ROWS) -> bytes:
    """A .docx file of a report's blocks (ord, heading, body): a title, then a heading
    and a paragraph each. A report of more blocks than ``most_rows`` is refused."""
    rows = blocks.orderBy("ord").limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report holds at most {most_rows} blocks")
    para = lambda text, style: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(str(text or ""))}</w:t></w:r></w:p>'
    body = para(title, "Title") + "".join(para(r["heading"], "Heading1") + para(r["body"], "Normal") for r in rows)
    head, office = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org"
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{office}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{office}/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'{head}<w:document xmlns:w="{office}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, text in files.items():
            file.writestr(name, text)
    return out.getvalue()
