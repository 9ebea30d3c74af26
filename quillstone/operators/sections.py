"""Passages that know their section: tables whole, narrative within one heading.

A fold over a document's elements in order carries the heading path, and packs what
stands between two headings or tables.  A table is one passage; a larger one is cut
between rows, and each part repeats the header.  What a passage is about follows from
its section, its words and its labels, as Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import labels
from quillstone.functions import text as t
from quillstone.operators import chunking
from quillstone.operators.texttables import markdown
from quillstone.sources.shared import written

#: Tokens of a table, the least that a part may hold, and of the longest caption; characters of paths, titles and captions.
TABLE, LEAST_PART, CAPTION, PATH, TITLE = 900, 60, 30, 250, 200

#: Headings that begin a part of their own, and years that are no figures of a table's header.
TOP_LEVEL = re.compile(r"(?i)^(notes?\s+(to|forming|on)\b|independent auditor|directors'? report|corporate governance)")
YEAR = re.compile(r"(19|20)\d{2}")

#: Sections and titles of statements, of their faces, and of each type of passage.
STATEMENT = (
    r"(?i)balance sheet|profit (and|&) loss|income statement|statement of (operations|cash flows?|financial position|"
    r"comprehensive income)|cash flow statement|financial (highlights|summary|results)|results of operations"
)
PRIMARY = (
    r"(?i)balance sheet|statement of (profit (and|&) loss|operations|cash flows?|financial position|income)|"
    r"income statement|cash flow statement|financial highlights"
)
TYPES = (
    ("risk_factor", r"(?i)\brisks?\b|threats|uncertaint|concerns"),
    ("accounting_policy", r"(?i)accounting polic|basis of preparation|critical accounting"),
    ("notes", r"(?i)^notes?\b|notes to (the )?(consolidated |standalone )?financial"),
    ("earnings_commentary", r"(?i)question|q\s*&\s*a|prepared remarks|opening remarks|closing remarks"),
    (
        "management_commentary",
        r"(?i)management|md&a|discussion and analysis|outlook|guidance|strategy|strategic|chairman|"
        r"letter to shareholders|ceo|cfo|review of operations|business overview|opportunit",
    ),
)
RISK_WORDS = (
    r"(?i)\b(risk|adverse(ly)?|uncertain(ty|ties)?|volatil(e|ity)|exposure|headwinds?|litigation|"
    r"default|impairment|downturn|disruption)\b"
)
RISK_SHARE = 0.025

SCHEMA = "document_id string, chunk_index int, page_start int, page_end int, section string, title string, kind string, table_index int, text string, n_tokens int, grid array<array<string>>, context string"
_ARROW = pa.schema(
    [("document_id", pa.string()), ("chunk_index", pa.int32()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("section", pa.string()), ("title", pa.string()), ("kind", pa.string())]
    + [("table_index", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int32()), ("grid", pa.list_(pa.list_(pa.string()))), ("context", pa.string())]
)


def _size(text: str) -> int:
    return len(chunking._TOKEN.findall(text))


@cache
def _classes() -> np.ndarray:
    """Of every code point: 0 for blanks, 1 for what words are made of, 2 for marks, as the pattern of tokens parts them."""
    return np.array([0 if c.isspace() else 1 if c.isalnum() or c == "_" else 2 for c in map(chr, range(0x110000))], np.uint8)


def sizes(said: list[str]) -> list[int]:
    """Tokens of each text, counted in one pass."""
    if not said:
        return []
    kind = _classes()[np.frombuffer("".join(f"{s} " for s in said).encode("utf-32-le", "surrogatepass"), np.uint32)]
    begins = kind != 0
    begins[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
    ends = np.cumsum([len(s) + 1 for s in said])
    return np.add.reduceat(begins, np.concatenate([[0], ends[:-1]]), dtype=np.int64).tolist()


def _sentences(text: str) -> list[str]:
    return [s for s in chunking._SENTENCE.split(text.strip()) if s.strip()]


class _Piece(NamedTuple):
    """Narrative of one page: a text, its sentences and their tokens; no token crosses the blanks between sentences."""

    text: str
    page: int
    said: list[str]
    sizes: list[int]


def _within(text: str, page: int, target: int) -> list[_Piece]:
    """The text, or runs of its sentences that keep to the target if it doesn't."""
    said = _sentences(text)
    counts = sizes(said)
    if sum(counts) <= target:
        return [_Piece(text, page, said, counts)]
    out: list[tuple[list[str], list[int]]] = []
    room = -1
    for sentence, n in zip(said, counts, strict=True):
        if n > room:
            out.append(([], []))
            room = target
        out[-1][0].append(sentence)
        out[-1][1].append(n)
        room -= n
    return [_Piece(" ".join(x), page, x, n) for x, n in out]


def _tail(piece: _Piece, overlap: int) -> tuple[str, int]:
    """The last whole sentences within the overlap, and their tokens."""
    at, kept = len(piece.said), 0
    while at and kept + piece.sizes[at - 1] <= overlap:
        at -= 1
        kept += piece.sizes[at]
    return " ".join(piece.said[at:]), kept


@dataclass
class _Pack:
    """Texts of one passage with their pages; size counts its tokens, fresh those that the passage before did not have."""

    parts: list[tuple[str, int]] = field(default_factory=list)
    size: int = 0
    fresh: int = 0
    carried: bool = False


def packs(pieces: list[_Piece], heading: str | None, target: int, overlap: int) -> list[_Pack]:
    """Narrative pieces of one section to passages; the heading leads the first."""
    out: list[_Pack] = []
    for k, (text, page, _, counts) in enumerate(pieces):
        n = sum(counts)
        if not out or out[-1].fresh and out[-1].fresh + n > target:
            tail, size = _tail(pieces[k - 1], overlap) if out else ("", 0)
            lead = [(tail, pieces[k - 1].page)] if tail else []
            if not out and heading is not None:
                lead, size = [(heading, page)], _size(heading)
            out.append(_Pack(lead, size, carried=bool(tail)))
        out[-1].parts.append((text, page))
        out[-1].size += n
        out[-1].fresh += n
    return out


def _header_rows(grid: list[list[str]]) -> int:
    """Leading rows without figures but years, one at least; some row is left below them."""
    figures = [any(_is_figure(c) and not YEAR.fullmatch(c.strip()) for c in row[1:] if c) for row in grid[:3]]
    n = figures.index(True) if True in figures else len(figures)
    return max(1, min(n, len(grid) - 1))


_FIGURE = re.compile(r"(?i)(?:[-+–—]|nil|n/?a|n\.a\.)|[-−–(]*\s*(?:rs\.?|inr|usd|us\$|eur|gbp|[$₹€£H`])?\s*[-−–(]*\s*(?:\d[\d,]*(?:\.\d+)?|\.\d+)\)?\s*%?\)?")


def _is_figure(cell: str) -> bool:
    return _FIGURE.fullmatch(cell.strip()) is not None


def table_parts(grid: list[list[str]], title: str, caption: str, limit: int = TABLE) -> list[str]:
    """A table's passages: one with title and caption, or parts of whole rows below the repeated header."""
    lead = "".join(f"{x}\n" for x in (title, caption) if x)
    whole = lead + markdown(grid)
    if _size(whole) <= limit:
        return [whole]
    n = _header_rows(grid)
    room = max(limit - _size(lead + markdown(grid[:n])), LEAST_PART)
    parts: list[list[list[str]]] = []
    used = 0
    for row in grid[n:]:
        cost = _size(" | ".join(row)) + 2
        if not parts or used + cost > room:
            parts.append([])
            used = 0
        parts[-1].append(row)
        used += cost
    name = " ".join(x for x in (title, caption) if x) or "Table"
    return [f"{name} (part {i})\n{markdown(grid[:n] + rows)}" for i, rows in enumerate(parts, 1)]


class _Document:
    """The fold over one document's elements."""

    def __init__(self, key: str, target: int, overlap: int, limit: int) -> None:
        self.key, self.target, self.overlap, self.limit = key, target, overlap, limit
        self.out: list[tuple] = []
        self.count = 0
        self.section = self.parent = self.last = ""
        self.heading: str | None = None
        self.pieces: list[_Piece] = []

    def _put(self, pages: tuple[int, int], title: str, kind: str, table: int | None, text: str, size: int, grid: list | None, context: str | None) -> None:
        self.out.append((self.key, self.count, *pages, self.section, title, kind, table, text, size, grid, context))
        self.count += 1

    def _packed(self) -> list[_Pack]:
        found = packs(self.pieces, self.heading, self.target, self.overlap)
        if self.pieces:
            self.heading = None
        self.pieces = []
        return found

    def _passages(self, found: list[_Pack]) -> None:
        for p in found:
            if p.fresh >= chunking.LEAST:
                self._put((p.parts[0][1], p.parts[-1][1]), "", "narrative", None, "\n\n".join(x for x, _ in p.parts), p.size, None, None)

    def add(self, page: int, kind: str, level: int, text: str | None, grid: list | None, context: str | None) -> None:
        if kind == "text":
            self.pieces += _within(text, page, self.target)
            return
        found = self._packed()
        if kind == "heading":
            self._passages(found)
            if level <= 1 or not self.parent or TOP_LEVEL.match(text):
                self.parent, self.section = text, text[:PATH]
            else:
                self.section = f"{self.parent} › {text}"[:PATH]
            self.heading = self.last = text
            return
        caption = ""
        if found and not found[-1].carried and found[-1].fresh <= CAPTION:  # a short text right before a table is its caption
            caption = " ".join(x for x, _ in found.pop().parts if x != self.last)
        self._passages(found)
        title, caption = self.last[:TITLE], caption[:TITLE]
        first = self.count
        for text in table_parts(grid, title, caption, self.limit):
            self._put((page, page), " ".join(x for x in (title, caption) if x), "table", first, text, _size(text), grid if self.count == first else None, context if self.count == first else None)
        self.heading = None

    def done(self) -> list[tuple]:
        self._passages(self._packed())
        return self.out


def _chunked(target: int, overlap: int, limit: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Document | None = None

        def packed(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            found = []
            for key, place, *element in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if now is None or key != now.key or place == 0:
                    found += now.done() if now else []
                    now = _Document(key, target, overlap, limit)
                now.add(*element)
            yield packed(found)
        if now:
            yield packed(now.done())

    return fold


def _typed(passages: DataFrame, document_type: Column) -> DataFrame:
    """Adds chunk_type."""
    section, text = F.col("section"), F.col("text")
    by_section = F.coalesce(*[F.when(section.rlike(pattern), name) for name, pattern in TYPES])
    # Most texts have no such word, and need no count of their tokens.
    share = t.let(F.regexp_count(text, F.lit(RISK_WORDS)), lambda n: F.when(n > 0, n / F.greatest(t.token_count(text), F.lit(1))).otherwise(0.0))
    narrative = F.coalesce(by_section, F.when(document_type == "earnings_call", "earnings_commentary").when(share > RISK_SHARE, "risk_factor").when(document_type == "mda", "management_commentary").otherwise("narrative"))
    label = F.transform("grid", lambda row: F.get(F.filter(row, lambda c: c.rlike("[A-Za-z]")), F.lit(0)))
    named = passages.where("grid is not null").select("document_id", "table_index", F.explode(F.filter(label, lambda x: x.isNotNull())).alias("label"))
    known = labels.with_metrics(named, "label").where("metric is not null").groupBy("document_id", "table_index").agg((F.count("*") >= 2).alias("reported"))
    statement = F.concat_ws(" ", "title", "section").rlike(STATEMENT) | F.coalesce("reported", F.lit(False))
    tables = passages.where("kind = 'table'").join(known, ["document_id", "table_index"], "left").withColumn("chunk_type", F.when(statement, "financial_statement").otherwise("table"))
    # Narrative stays where it is.
    return passages.where("kind = 'narrative'").withColumn("chunk_type", narrative).unionByName(tables.drop("reported"))


def passages(elements: DataFrame, document_type: Column | None = None, target: int = chunking.TARGET, overlap: int = chunking.OVERLAP, limit: int = TABLE) -> DataFrame:
    """(document_id, chunk_index, page_start, page_end, section, title, chunk_type, table_index, text, n_tokens, grid, context) of elements().

    Narrative of one section is packed up to the target; a passage begins with the last
    whole sentences of the one before.  Fewer than twelve new tokens are no passage.
    table_index is the first passage of a table, which has the whole grid and the
    head of its page.  Documents without elements have no passages.
    """
    folded = elements.select("document_id", "place", "page", "kind", "level", "text", "grid", "context").mapInArrow(_chunked(target, overlap, limit), SCHEMA)
    folded = written(folded, "passages")  # read twice: for its tables' labels, and for its rows
    return _typed(folded, F.lit("other") if document_type is None else document_type).drop("kind")


def provenance(company: Column, title: Column, section: Column, text: Column) -> Column:
    """A passage below a line with its company, title and section, those that there are."""
    known = F.filter(F.array(company, title, section), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(known) > 0, F.concat(F.array_join(known, " | "), F.lit("\n"), text)).otherwise(text)


def weighted(passages: DataFrame, most_pages: int) -> DataFrame:
    """Adds part, weight: how far the figures of a passage's table count.

    The basis is that of the last section or title that names one, consolidated first,
    standalone less; tables outside the first pages of a statement's part count less.
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    heading = F.lower(F.concat_ws(" ", "section", "title"))
    basis = F.when(heading.contains("consolidated"), 1.0).when(heading.contains("standalone"), 0.9)
    part = F.element_at(F.split("section", " › "), 1)
    rows = passages.withColumn("part", part).withColumn("basis", F.coalesce(F.last(basis, ignorenulls=True).over(order), F.lit(1.0)))
    begins = F.when(~F.col("part").eqNullSafe(F.coalesce(F.lag("part").over(order), F.lit(""))), F.col("page_start"))
    rows = rows.withColumn("begins", begins).withColumn("begins", F.coalesce(F.last("begins", ignorenulls=True).over(order), F.lit(0)))
    primary = F.col("part").rlike(PRIMARY) & (F.col("page_start") - F.col("begins") <= most_pages)
    return rows.withColumn("weight", F.col("basis") * F.when(primary, 1.0).otherwise(0.8)).drop("basis", "begins")
