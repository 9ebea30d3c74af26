"""Registered queries over page layout: pages set in one, two or four columns, read back by geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import lines
from quillstone.operators import geometry
from quillstone.sources.shared import written
from quillstone.sources.tables import table

#: By page_id modulo four: columns and whether the page is landscape; landscape pages of two columns hold figures.
_COLUMNS = (1, 2, 2, 4)

#: Tasks that the spans of one partition of the scan are dealt into; they take far more memory than its compressed bytes.
_PARTS = 16


def _partitions(spark: SparkSession, sf_dir: str) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), _PARTS * table(spark, sf_dir, "pages").rdd.getNumPartitions())


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _partitions(spark, sf_dir)
    return geometry.visual_rows(geometry.in_columns(page_spans(spark, sf_dir), n), n)


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's words, four to a span, set in columns; five pages are a document."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), r"[ \t\n\r]+"), lambda w: w != "")
    kind = (F.col("page_id") % 4).cast("int")
    rows = table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), words.alias("words"), F.element_at(F.array(*[F.lit(c) for c in _COLUMNS]), kind + 1).alias("c")).where(F.size("words") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size("words") / 4).cast("int") - 1), lambda i: F.array_join(F.slice("words", i * 4 + 1, 4), " "))
    rows = rows.select("page_id", "kind", "c", F.posexplode(pieces).alias("i", "said"))
    width = F.when(F.col("kind") >= 2, 842.0).otherwise(595.0)
    column, row = F.col("i") % F.col("c"), F.floor(F.col("i") / F.col("c"))
    step = (width - 100) / F.col("c")
    text = F.when((F.col("kind") == 2) & (row % 3 == 1), F.format_number(F.col("i") * 37 + 1000, 0)).otherwise(F.col("said"))
    x0, y0 = 50 + column * step, 40.0 + row * 12 + (F.col("i") * 7 % 3) * 0.5
    return rows.select(
        F.concat(F.lit("d"), F.floor(F.col("page_id") / 5)).alias("document_id"), (F.col("page_id") % 5).cast("int").alias("page"), "i", text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + step * 0.8).alias("x1"), (y0 + 9).alias("y1"),
        F.when(F.col("i") % 17 == 0, 14.0).otherwise(9.0).alias("size"), (F.col("i") % 11 == 0).alias("bold"), width.alias("width"), F.when(F.col("kind") >= 2, 595.0).otherwise(842.0).alias("height"),
    )


def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many columns are found on every page, and the spans of the first."""
    found = geometry.in_columns(page_spans(spark, sf_dir), _partitions(spark, sf_dir))
    return found.groupBy("document_id", "page").agg((F.max("column") + 1).alias("n_columns"), F.count("*").alias("n_spans"), F.sum((F.col("column") == 0).cast("int")).alias("n_first"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visual rows of every page in reading order."""
    found = _lines(spark, sf_dir)
    return found.select("document_id", "page", "column", "place", "y0", "y1", "size", "bold", F.md5("text").alias("digest"))


def text_outside_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every page outside its tables: two boxes of which one reaches over the page's edge."""
    spans = page_spans(spark, sf_dir)
    pages = spans.select("document_id", "page").distinct()
    low = 100.0 + F.col("page") * 10
    boxes = pages.select("document_id", "page", F.lit(40.0).alias("x0"), low.alias("y0"), F.lit(300.0).alias("x1"), (low + 60).alias("y1")).unionByName(
        pages.where("page % 2 = 0").select("document_id", "page", F.lit(-50.0).alias("x0"), F.lit(400.0).alias("y0"), F.lit(2000.0).alias("x1"), F.lit(475.0).alias("y1"))
    )
    return geometry.outside(spans, boxes).groupBy("document_id", "page").agg(F.count("*").alias("n"), F.sum(F.col("i").cast("long")).alias("sum_i"))


def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.body_sizes(page_spans(spark, sf_dir))


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are headings, by the body size of their document."""
    found = written(_lines(spark, sf_dir), "lines")  # read twice: for the body sizes, and for the lines
    rows = lines.with_levels(found.join(geometry.body_sizes(found), "document_id"), F.col("body_size"), F.lit(0))
    return rows.where("level > 0").select("document_id", "page", "place", "level", F.md5("text").alias("digest"))


QUERIES = {"page_columns": page_columns, "page_lines": page_lines, "text_outside_boxes": text_outside_boxes, "body_sizes": body_sizes, "page_headings": page_headings}

_SPANS_SQL = r"""w AS (SELECT page_id, page_id % 4 AS kind, [1, 2, 2, 4][page_id % 4 + 1] AS c, list_filter(string_split_regex(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+'), lambda x: x <> '') AS words FROM pages),
  p AS (SELECT page_id, kind, c, len(words) AS n_words, unnest(range((len(words) + 3) // 4)) AS i, words FROM w),
  q AS (SELECT *, CASE WHEN kind >= 2 THEN 842.0 ELSE 595.0 END::DOUBLE AS width, i % c AS col, i // c AS r FROM p),
  spans AS MATERIALIZED (SELECT 'd' || (page_id // 5) AS document_id, (page_id % 5)::INTEGER AS page, kind, i, CASE WHEN kind = 2 AND r % 3 = 1 THEN format('{:,}', i * 37 + 1000) ELSE array_to_string(words[4 * i + 1:4 * i + 4], ' ') END AS text,
    50 + col * ((width - 100) / c) AS x0, 50 + col * ((width - 100) / c) + (width - 100) / c * 0.8::DOUBLE AS x1, 40::DOUBLE + r * 12 + (i * 7 % 3) * 0.5::DOUBLE AS y0, CASE WHEN i % 17 = 0 THEN 14.0 ELSE 9.0 END::DOUBLE AS size, col FROM q)"""

ORACLE_SQL = {
    "page_columns": f"""WITH {_SPANS_SQL}, n AS (SELECT document_id, page, kind, count(*) AS n, count(*) FILTER (col = 0) AS c0, count(*) FILTER (col = 1) AS c1, count(*) FILTER (col = 2) AS c2, count(*) FILTER (col = 3) AS c3 FROM spans GROUP BY ALL),
      s AS (SELECT *, CASE kind WHEN 3 THEN n >= 10 AND c0 + c1 >= 4 AND c2 + c3 >= 4 ELSE kind = 2 AND n >= 10 AND c0 >= 4 AND c1 >= 4 END AS spread FROM n)
      SELECT document_id, page, (CASE kind WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN n >= 30 AND c1 >= 12 THEN 2 ELSE 1 END WHEN 2 THEN CASE WHEN spread THEN 2 ELSE 1 END
        ELSE CASE WHEN spread THEN 2 + (c0 + c1 >= 30 AND c1 >= 12)::INT + (c2 + c3 >= 30 AND c3 >= 12)::INT ELSE 1 END END)::INTEGER AS n_columns, n AS n_spans,
        CASE kind WHEN 0 THEN n WHEN 1 THEN CASE WHEN n >= 30 AND c1 >= 12 THEN c0 ELSE n END WHEN 2 THEN CASE WHEN spread THEN c0 ELSE n END ELSE CASE WHEN NOT spread THEN n WHEN c0 + c1 >= 30 AND c1 >= 12 THEN c0 ELSE c0 + c1 END END::BIGINT AS n_first
      FROM s""",
    "text_outside_boxes": f"""WITH {_SPANS_SQL}, b AS (SELECT DISTINCT document_id, page, 40.0::DOUBLE AS bx0, 100.0::DOUBLE + page * 10 AS by0, 300.0::DOUBLE AS bx1, 160.0::DOUBLE + page * 10 AS by1 FROM spans
        UNION ALL SELECT DISTINCT document_id, page, -50, 400, 2000, 475 FROM spans WHERE page % 2 = 0)
      SELECT document_id, page, count(*) AS n, sum(i)::BIGINT AS sum_i FROM spans s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.document_id = s.document_id AND b.page = s.page
        AND (s.x0 + s.x1) / 2 BETWEEN bx0 AND bx1 AND (s.y0 + s.y0 + 9) / 2 BETWEEN by0 AND by1) GROUP BY ALL""",
    "body_sizes": f"WITH {_SPANS_SQL}, v AS (SELECT document_id, size, unnest(range(greatest(1, length(text) // 20))) FROM spans) SELECT document_id, median(size) AS body_size FROM v GROUP BY 1",
}
