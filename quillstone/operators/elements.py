"""Texts to layout elements: headings, paragraphs and tables, page by page.

Lines are classed by Column expressions (functions/lines.py) and run, still in the
order of their text and without a shuffle, through one fold that holds a page at a
time: it finds the runs of table lines and joins the lines of paragraphs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import lines as ln
from quillstone.functions import periods
from quillstone.functions import text as t
from quillstone.operators.texttables import runs

#: Fixed value: characters of a page that are searched for what a table itself doesn't say.
CONTEXT = 800

#: Letter of a blank line, besides those of functions/lines.py.
BLANK = "B"

SCHEMA = "document_id string, page int, place int, kind string, level int, text string, start int, end int, grid array<array<string>>, context string"
_ARROW = pa.schema(
    [("document_id", pa.string()), ("page", pa.int32()), ("place", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("grid", pa.list_(pa.list_(pa.string()))), ("context", pa.string())]
)


@cache
def _expressions() -> dict[str, Column]:
    """What is worked out of a line, in columns that build on each other; made once, as they are large."""
    said, parts, marks = F.col("said"), F.col("parts"), F.col("marks")
    wraps = (F.length(said) <= ln.WRAPPED) & said.rlike("[A-Za-z]{3}")
    header = (F.size("found") > 0) & (F.col("residue") <= 3)
    part = F.coalesce((F.length(said) <= ln.HEADER_PART) & (F.col("residue") <= 3), F.lit(False))
    ten = F.lit(10.0)
    code = F.when(said == "", BLANK).when(header, ln.HEADER).when(F.col("row").isNotNull(), ln.ROW).when(F.col("values").isNotNull(), ln.VALUES).when(ln.is_label(said, F.size(parts)), ln.SUBLABEL).when(wraps, ln.WRAPS).otherwise(ln.OTHER)
    level = ln.level_of(said, parts, marks, F.col("row").isNotNull(), part, ten, F.lit(False), ten, F.col("forced"))
    return {
        "parts": F.when(ln.is_short_or_row(said), ln.words(said)), "marks": ln.marks(parts), "residue": F.when((F.length(said) <= ln.HEADER_PART) | said.rlike(r"\d\d"), ln.residue(said)), "found": F.when((F.col("residue") <= 3) & said.rlike(r"\d\d"), periods.periods(said)),
        "row": F.when(F.size(parts) > 1, ln.row_of(parts, marks)), "values": F.when(F.size(parts) > 0, ln.values_of(parts, marks)), "code": code, "level": F.when(said == "", 0).otherwise(level), "bullet": said.rlike(ln.BULLET),
        "cells": F.when(F.col("code") == ln.HEADER, F.concat(F.array(F.lit("Particulars")), ln.period_labels(said, F.col("found")))).when(F.col("code") == ln.ROW, F.concat(F.array("row.label"), F.col("row.figures"))).when(F.col("code") == ln.VALUES, F.col("values")),
    }


def classed(documents: DataFrame) -> DataFrame:
    """(document_id, page, line, code, level, bullet, figures, said, cells) of every line of (document_id, text), in order.

    Form feeds part pages.  Rules of tables and underlines are no lines; a line with an
    underline below it, or with # before it, is a heading; bars are blanks between cells.
    cells is null where a line is one cell.
    """
    said = F.col("page_text")
    raw = F.split(F.when(said.contains("\r"), F.regexp_replace(said, r"\r\n?", "\n")).otherwise(said), "\n")
    # A page is split once, not again for each of its lines.
    pairs = t.let(raw, lambda x: F.zip_with(x, F.slice(x, 2, F.size(x)), lambda own, below: F.struct(own.alias("own"), below.alias("below"))))
    pages = documents.select(F.col("document_id").cast("string").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f")).alias("page", "page_text"))
    rows = pages.select("document_id", (F.col("page") + 1).alias("page"), F.posexplode(pairs).alias("line", "pair")).select("document_id", "page", "line", t.stripped_long(F.col("pair.own")).alias("own"), F.coalesce("pair.below", F.lit("")).alias("below"))
    # Patterns run where the first character allows a match, as most lines are prose.
    own = F.col("own")
    rows = rows.where(~(F.substring(own, 1, 1).isin(*"|:-=") & own.rlike(r"^(?:[|:\- ]{3,}|[=\-]{3,})$")))
    hashes = F.when(own.startswith("#"), F.length(F.regexp_extract(own, r"^(#{1,6})\s", 1))).otherwise(0)
    forced = F.when(hashes == 1, 1).when(hashes > 1, 2).when((own != "") & F.col("below").rlike(rf"^{t.BLANK}*[=\-]{{3,}}{t.BLANK}*$"), 1).otherwise(0)
    said = F.when(hashes > 0, F.regexp_replace(own, r"^#{1,6}\s+", "")).when(own.startswith("|") & own.rlike(r"^\|.*\|$"), F.array_join(F.transform(F.split(F.regexp_replace(own, r"^\|+|\|+$", ""), r"\|"), t.stripped), "   ")).otherwise(own)
    read = rows.select("document_id", "page", "line", forced.alias("forced"), said.alias("said"))
    made = _expressions()
    for stage in (("parts", "residue"), ("marks", "found"), ("row", "values"), ("code",)):
        read = read.withColumns({name: made[name] for name in stage})
    return read.select("document_id", "page", "line", "code", made["level"].alias("level"), made["bullet"].alias("bullet"), F.col("values").isNotNull().alias("figures"), "said", made["cells"].alias("cells"))


def joined(said: list[str]) -> str:
    """Lines as one text; a word that a hyphen parts at a line's end is put together."""
    out: list[str] = []
    for part in (" ".join(s.split()) for s in said):
        if out and out[-1].endswith("-") and out[-1][-2:-1].isalpha() and part[:1].islower():
            out[-1] = out[-1][:-1] + part
        elif part:
            out.append(part)
    return " ".join(out)


def _page(lines: list[tuple]) -> Iterator[tuple]:
    """(kind, level, text, start, end, grid) of the lines (code, level, bullet, figures, said, cells) of a page."""
    inked = [x for x in lines if x[0] != BLANK]
    after_blank = [False]
    for x in lines:  # whether a blank line stands before each other line
        if x[0] == BLANK:
            after_blank[-1] = True
        else:
            after_blank.append(False)
    found = {start: (end, place) for start, end, place in runs("".join(x[0] for x in inked), [x[3] for x in inked])}
    held: list[int] = []

    def paragraph() -> Iterator[tuple]:
        if held and (text := joined([inked[k][4] for k in held])):
            yield "text", 0, text, held[0], held[-1] + 1, None
        held.clear()

    i = 0
    while i < len(inked):
        _, level, bullet, _, said, _ = inked[i]
        if i in found:
            yield from paragraph()
            end, place = found[i]
            grid: dict[int, list[str]] = {}
            for k, row in enumerate(place, i):
                if row >= 0:
                    grid.setdefault(row, []).extend(inked[k][5] or [inked[k][4]])
            yield "table", 0, None, i, end, list(grid.values())
            i = end
            continue
        if level:
            yield from paragraph()
            yield "heading", level, " ".join(said.split()), i, i + 1, None
        else:
            if held and (after_blank[i] or bullet):
                yield from paragraph()
            held.append(i)
        i += 1
    yield from paragraph()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held, place = None, [], 0

    def flushed() -> list[tuple]:
        nonlocal place
        out, found = [], list(_page(held))
        said = "\n".join(text if grid is None else "\n".join("  ".join(c for c in row if c) for row in grid) for _, _, text, _, _, grid in found)
        for kind, level, text, start, end, grid in found:
            out.append((*key, place, kind, level, text, start, end, grid, said[:CONTEXT] if grid else None))
            place += 1
        return out

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)

    for batch in batches:
        found = []
        for document, page, line, *rest in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            if line == 0 or (document, page) != key:
                if key is not None:
                    found += flushed()
                if key is None or document != key[0] or page == 1:
                    place = 0
                key, held = (document, page), []
            held.append(tuple(rest))
        yield packed(found)
    if key is not None:
        yield packed(flushed())


def elements(documents: DataFrame) -> DataFrame:
    """(document_id, page, place, kind, level, text, start, end, grid, context) of (document_id, text).

    kind is heading, text or table; start and end count the inked lines of the page;
    a table has its cells in grid and the head of its page in context.  place counts a document's elements.  Null and empty
    texts have none.
    """
    return classed(documents).mapInArrow(_folded, SCHEMA)
