"""Filings as files: text, Markdown, DOCX and XLSX to layout elements.

Files come through Spark's binaryFile source; each is parsed by itself in the
tasks, with the standard library only.  A file that can't be read gives one row
with its error and no elements.  PDF needs a library that is not assumed here.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the fewest characters of a text that is not empty.
LEAST_CHARS = 20

SCHEMA = "path string, sha256 string, page int, place int, kind string, level int, text string, error string"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

Element = tuple[int, str, int, str]


def text_elements(content: bytes) -> list[Element]:
    """(page, kind, level, text): form feeds part pages, # and underlines make headings, pipe rows make table rows."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    if len(text.strip()) < LEAST_CHARS:
        raise ValueError("empty")
    out: list[Element] = []
    for page, part in enumerate(text.split("\f"), 1):
        lines = part.splitlines()
        for i, line in enumerate(lines):
            bare = line.strip()
            following = lines[i + 1].strip() if i + 1 < len(lines) else ""
            if not bare or re.fullmatch(r"[-=]{3,}|[|\s:-]+", bare):
                continue
            if heading := re.match(r"(#{1,6})\s+(.*)", bare):
                out.append((page, "heading", len(heading[1]), heading[2]))
            elif re.fullmatch(r"[-=]{3,}", following):
                out.append((page, "heading", 1, bare))
            elif bare.startswith("|"):
                out.append((page, "row", 0, " | ".join(c.strip() for c in bare.strip("|").split("|"))))
            else:
                out.append((page, "text", 0, bare))
    return out


def docx_elements(content: bytes) -> list[Element]:
    """Paragraphs and table rows in order; page breaks count pages."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    page, out = 1, []
    for block in body:
        if block.tag == f"{_W}p":
            page += sum(b.get(f"{_W}type") == "page" for b in block.iter(f"{_W}br"))
            text = "".join(t.text or "" for t in block.iter(f"{_W}t")).strip()
            style = next((s.get(f"{_W}val", "") for s in block.iter(f"{_W}pStyle")), "")
            level = re.match(r"(?i)heading\s*(\d)|title", style)
            if text:
                out.append((page, "heading" if level else "text", int(level[1] or 1) if level else 0, text))
        elif block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                cells = ["".join(t.text or "" for t in cell.iter(f"{_W}t")).strip() for cell in row.iter(f"{_W}tc")]
                if any(cells):
                    out.append((page, "row", 0, " | ".join(cells)))
    return out


def _cell(value: str) -> str:
    """Years stay plain, other whole numbers get separators."""
    try:
        number = float(value)
    except ValueError:
        return value
    if number == int(number):
        return str(int(number)) if 1900 <= number <= 2100 else f"{int(number):,}"
    return f"{number:,.2f}"


def xlsx_elements(content: bytes) -> list[Element]:
    """A page for each sheet, a row for each filled row."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out: list[Element] = []
        for page, name in enumerate(sheets, 1):
            for row in ElementTree.fromstring(archive.read(name)).iter(f"{_S}row"):
                cells = []
                for cell in row.iter(f"{_S}c"):
                    raw = "".join(t.text or "" for t in cell.iter(f"{_S}t")) or (cell.findtext(f"{_S}v") or "")
                    cells.append(shared[int(raw)] if cell.get("t") == "s" and raw else raw if cell.get("t") in ("str", "inlineStr") else _cell(raw))
                if any(c.strip() for c in cells):
                    out.append((page, "row", 0, " | ".join(c.strip() for c in cells)))
    return out


def parsed(path: str, content: bytes) -> list[Element]:
    """Elements by extension; the first bytes must fit it."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("docx", "xlsx") and not content.startswith(b"PK"):
        raise ValueError("content does not match the extension")
    if kind in ("txt", "md"):
        if b"\0" in content[:1024]:
            raise ValueError("content does not match the extension")
        return text_elements(content)
    readers = {"docx": docx_elements, "xlsx": xlsx_elements}
    if kind not in readers:
        raise ValueError("unsupported_format")
    return readers[kind](content)


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "sha256", "page", "place", "kind", "level", "text", "error"]
    for frame in frames:
        rows = []
        for path, sha, content in zip(frame["path"], frame["sha256"], frame["content"], strict=True):
            try:
                rows += [(path, sha, page, i, kind, level, text, None) for i, (page, kind, level, text) in enumerate(parsed(path, bytes(content)))]
            except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                rows.append((path, sha, None, None, None, None, None, str(error) or type(error).__name__))
        yield pd.DataFrame(rows, columns=names).astype({"page": "Int32", "place": "Int32", "level": "Int32"})


def elements(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Layout elements of the files of a folder; a content that several files have is parsed once, under the smallest path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("sha256"), "content")
    first = files.select("path", "sha256").groupBy("sha256").agg(F.min("path").alias("path"))
    return files.join(first, ["path", "sha256"], "left_semi").mapInPandas(_rows, SCHEMA)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """The labelled question set, one JSON object a line; a bad line stops the read."""
    schema = "question string, expected_answer string, relevant_document string, relevant_page int, key_facts array<string>"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def replace_document(rows: DataFrame, path: str) -> None:
    """Write rows by document_id; what a document had before is replaced, other documents stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)
