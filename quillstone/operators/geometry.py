"""Layout of pages from the places of their text: columns, visual rows, boxes, body size, running lines.

Spans are (document_id, page, text, x0, y0, x1, y1, size, bold) with y downwards.  What
needs a whole page is a window or a group over it; nothing is gathered beyond a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as t

PAGE = ["document_id", "page"]

#: Where a gutter is looked for (parts of the text's width), how much may cross it, and the least spans of a side and of the whole.
SPREAD, SPREAD_CROSSING, SPREAD_SIDE, SPREAD_SPANS, LANDSCAPE = (0.5, 0.49, 0.51, 0.48, 0.52), 0.04, 4, 10, 1.2
COLUMNS, COLUMN_CROSSING, COLUMN_SIDE, COLUMN_SPANS, FIGURES = (0.5, 0.47, 0.53, 0.44, 0.56, 0.41, 0.59), 0.08, 12, 30, 0.25
EDGE = 2.0

#: How far a span may be from the mean of its row (absolute, and in sizes), gaps that part cells and words, share of bold characters of a bold line.
ROW_REACH, ROW_SIZES, CELL_GAP, WORD_GAP, BOLD = 2.5, 0.4, 12.0, 1.0, 0.6

#: Side of the grid cells in which points meet boxes.
CELL = 64.0

#: Margins of a page, the least pages and share of pages of a running line, and what a page number looks like.
TOP, BOTTOM, LEAST_PAGES, PAGES_SHARE = 0.08, 0.92, 2, 0.6
PAGE_NUMBER = r"(?i)^(page\s*)?\d{1,4}(\s*(of|/|\|)\s*\d{1,4})?$"


def outside(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """The spans of which the centre is in no box (document_id, page, x0, y0, x1, y1) of their page; edges belong to a box.

    Boxes are laid over the cells of a grid, so points and boxes meet by an equi-join.
    Cells are far more than the rows that their size is estimated from, so neither side is
    ever broadcast.
    """
    cell = lambda c: F.floor(c / CELL)
    cells = lambda low, high: F.explode(F.sequence(cell(F.col(low)), cell(F.col(high))))
    laid = boxes.where("x0 <= x1 and y0 <= y1").select(*[F.col(c).alias(f"box_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")]).select("*", cells("box_x0", "box_x1").alias("column")).select("*", cells("box_y0", "box_y1").alias("row"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    met = (F.col("document_id") == F.col("box_document_id")) & (F.col("page") == F.col("box_page")) & (cell(x) == F.col("column")) & (cell(y) == F.col("row"))
    return spans.join(laid.hint("merge"), met & x.between(F.col("box_x0"), F.col("box_x1")) & y.between(F.col("box_y0"), F.col("box_y1")), "left_anti")


def _parted(spans: DataFrame, keys: list[str], fractions: tuple[float, ...], most_crossing: float, least_side: int, may: Column, name: str, most_figures: float | None = None) -> DataFrame:
    """Adds a column that is 0 left of the first gutter that fits and 1 right of it; 0 if there is none.

    How many spans lie left of each place, right of it and across it are counts over
    the group; what crosses the gutter goes with the left side.
    """
    every = Window.partitionBy(*keys)
    total = lambda c: F.sum(c.cast("int")).over(every)
    low, high = F.min("x0").over(every), F.max("x1").over(every)
    rows = spans.withColumn("_low", low).withColumn("_wide", high - low).withColumn("_n", F.count("*").over(every))
    places = [F.col("_low") + F.col("_wide") * f for f in fractions]
    left, right = (lambda x: F.col("x1") <= x + EDGE), (lambda x: F.col("x0") >= x - EDGE)
    fit = [(total(~left(x) & ~right(x)) <= most_crossing * F.col("_n")) & (total(left(x)) >= least_side) & (total(right(x)) >= least_side) for x in places]
    rows = rows.withColumn("_may", may).withColumn("_x", F.coalesce(*[F.when(ok, x) for ok, x in zip(fit, places, strict=True)]))
    x = F.col("_x")
    on_left, on_right = left(x) | ~right(x), right(x)
    cut = F.col("_may") & x.isNotNull()
    if most_figures is not None:
        rows = rows.withColumn("_figure", t.is_figure(F.col("text")))
        share = lambda side: F.try_divide(total(side & F.col("_figure")), total(side))
        cut = cut & (share(on_left) <= most_figures) & (share(on_right) <= most_figures)
    rows = rows.withColumn("_cut", F.coalesce(cut, F.lit(False)))
    # A narrow span right in the gutter is on both sides.
    sides = F.when(F.col("_cut"), F.array_compact(F.array(F.when(on_left, 0), F.when(on_right, 1)))).otherwise(F.array(F.lit(0)))
    return rows.withColumn(name, F.explode(sides)).drop("_low", "_wide", "_n", "_may", "_x", "_cut", "_figure")


def in_columns(spans: DataFrame, partitions: int | None = None) -> DataFrame:
    """The spans with the number of their column, from 0 in reading order of the page.

    partitions is into how many tasks the pages are dealt; without it Spark merges small
    ones by their compressed bytes, which are far fewer than what their sorts hold.

    spans also have width and height of their page.  A landscape page with a gutter in the
    middle holds two printed pages, whatever stands there; a part is two columns only if
    both sides are prose.
    """
    spread = (F.col("height") > 0) & (F.col("width") > F.col("height") * LANDSCAPE) & (F.col("_n") >= SPREAD_SPANS)
    halves = _parted(spans if partitions is None else spans.repartition(partitions, *PAGE), PAGE, SPREAD, SPREAD_CROSSING, SPREAD_SIDE, spread, "half")
    sides = _parted(halves, [*PAGE, "half"], COLUMNS, COLUMN_CROSSING, COLUMN_SIDE, F.col("_n") >= COLUMN_SPANS, "side", FIGURES)
    return sides.withColumn("column", (F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("half", "side")) - 1).cast("int")).drop("half", "side")


LINES = "document_id string, page int, column int, place int, text string, y0 double, y1 double, size double, bold boolean"
_ARROW = pa.schema(
    [("document_id", pa.string()), ("page", pa.int32()), ("column", pa.int32()), ("place", pa.int32()), ("text", pa.string())] + [(c, pa.float64()) for c in ("y0", "y1", "size")] + [("bold", pa.bool_())]
)


class _Row:
    """A visual row: spans near the mean of the ones before."""

    def __init__(self) -> None:
        self.spans: list[tuple] = []
        self.middles = 0.0

    def takes(self, y0: float, y1: float, size: float) -> bool:
        return abs((y0 + y1) / 2 - self.middles / len(self.spans)) <= max(ROW_REACH, ROW_SIZES * size)

    def add(self, span: tuple) -> None:
        self.spans.append(span)
        self.middles += (span[2] + span[4]) / 2

    def line(self) -> tuple | None:
        """(text, y0, y1, size, bold), from left to right; wide gaps part cells."""
        text, edge = "", 0.0
        for said, x0, _, x1, _, _, _ in sorted(self.spans, key=lambda s: s[1]):
            if text:
                text += "   " if x0 - edge > CELL_GAP else " " if x0 - edge > WORD_GAP and not text.endswith(" ") else ""
            text, edge = text + said, x1
        chars = sum(len(s[0]) for s in self.spans)
        thick = sum(len(s[0]) for s in self.spans if s[6])
        return (text.rstrip(), min(s[2] for s in self.spans), max(s[4] for s in self.spans), max(s[5] for s in self.spans), thick > BOLD * (chars or 1)) if text.strip() else None


def _clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, row, place = None, _Row(), 0

    def closed() -> list[tuple]:
        nonlocal place, row
        line = row.line() if row.spans else None
        row = _Row()
        if line is None:
            return []
        place += 1
        return [(*key, place - 1, *line)]

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)

    for batch in batches:
        found = []
        for document, page, column, *span in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
            if (document, page, column) != key:
                found += closed()
                place = place if key is not None and (document, page) == key[:2] else 0
                key = (document, page, column)
            elif not row.takes(span[2], span[4], span[5]):
                found += closed()
            row.add(tuple(span))
        yield packed(found)
    if key is not None:
        yield packed(closed())


def visual_rows(spans: DataFrame, partitions: int | None = None) -> DataFrame:
    """(document_id, page, column, place, text, y0, y1, size, bold): the lines of in_columns() spans.

    Spans come by the height of their middle; each joins the row before if it is near the
    mean of that row's middles, so the rows depend on the order.  place counts the lines of
    a page over its columns.  Only the row at hand is held; partitions as for in_columns().
    """
    rows = spans.select(F.col("document_id").cast("string").alias("document_id"), F.col("page").cast("int").alias("page"), "column", "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "size")], "bold")
    rows = rows.repartition(*([] if partitions is None else [partitions]), *PAGE).sortWithinPartitions(*PAGE, "column", (F.col("y0") + F.col("y1")) / 2, "x0", "x1", "text")
    return rows.mapInArrow(_clustered, LINES)


def without_running_lines(lines: DataFrame) -> DataFrame:
    """The lines (document_id, page, text, y0, y1, height) without page numbers and what repeats in the margins of most pages.

    The share is of all pages of a document that have lines.
    """
    key = F.trim(F.regexp_replace(F.lower("text"), r"\d+", "#"))
    margin = (F.col("y1") < F.col("height") * TOP) | (F.col("y0") > F.col("height") * BOTTOM)
    rows = lines.withColumn("_key", key).withColumn("_margin", F.coalesce(margin, F.lit(False)))
    pages = lines.groupBy("document_id").agg(F.count_distinct("page").alias("_pages"))
    often = rows.where("_margin").groupBy("document_id", "_key").agg(F.count_distinct("page").alias("_on")).join(pages, "document_id")
    often = often.where(F.col("_on") >= F.greatest(F.lit(LEAST_PAGES), F.round(F.col("_pages") * PAGES_SHARE))).select("document_id", "_key", F.lit(True).alias("_often"))
    kept = rows.join(often, ["document_id", "_key"], "left").where(~(F.col("_margin") & (F.coalesce("_often", F.lit(False)) | F.trim("text").rlike(PAGE_NUMBER))))
    return kept.select(*lines.columns)


def body_sizes(lines: DataFrame) -> DataFrame:
    """(document_id, body_size): the median size of the lines (document_id, text, size), one vote for every twenty characters of a line, one at least.

    Votes are counted by size first, so no list of them is made.
    """
    votes = lines.groupBy("document_id", "size").agg(F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 20))).alias("votes"))
    every = Window.partitionBy("document_id")
    votes = votes.withColumn("total", F.sum("votes").over(every)).withColumn("upto", F.sum("votes").over(every.orderBy("size")))
    first = lambda n: F.min(F.when(F.col("upto") >= n, F.col("size")))
    return votes.groupBy("document_id").agg(((first(F.ceil(F.col("total") / 2)) + first(F.floor(F.col("total") / 2) + 1)) / 2).alias("body_size"))


def ruled_pages(drawings: DataFrame, words: DataFrame) -> DataFrame:
    """(document_id, page) that can hold a ruled table: rules at four heights and three places across, and eight figures.

    drawings: (document_id, page, x0, y0, x1, y1), words: (document_id, page, text).
    """
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    third = lambda c: F.bround(F.col(c) / 3).cast("long")
    cell = h.between(10, 60) & w.between(20, 400)
    flat, upright = (h <= 2) & (w >= 30), (w <= 2) & (h >= 12)
    none = F.array().cast("array<bigint>")
    marks = drawings.select(
        *PAGE, F.when(flat, F.array(third("y0"))).when(upright, none).when(cell, F.array(third("y0"), third("y1"))).otherwise(none).alias("rows"),
        F.when(flat, none).when(upright, F.array(third("x0"))).when(cell, F.array(third("x0"), third("x1"))).otherwise(none).alias("columns"),
    )
    at = marks.select(*PAGE, F.explode(F.concat(F.transform("rows", lambda v: F.struct(F.lit("row").alias("way"), v.alias("at"))), F.transform("columns", lambda v: F.struct(F.lit("column").alias("way"), v.alias("at"))))).alias("m")).select(*PAGE, "m.way", "m.at")
    grids = at.distinct().groupBy(*PAGE).agg(F.sum((F.col("way") == "row").cast("int")).alias("rows"), F.sum((F.col("way") == "column").cast("int")).alias("columns")).where("rows >= 4 and columns >= 3")
    figures = words.where(t.is_figure(F.col("text"))).groupBy(*PAGE).count().where("count >= 8")
    return grids.join(figures, PAGE, "left_semi").select(*PAGE)
