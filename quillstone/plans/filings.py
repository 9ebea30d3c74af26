"""Registered queries over filings: each company's facts printed as a report, and read back by layout, sections and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import financials as f
from quillstone.operators import sections, statements
from quillstone.operators.elements import elements
from quillstone.plans.finance import SQL_WITH
from quillstone.sources.shared import written
from quillstone.sources.tables import facts, spread, table

#: Printed figures: metrics of each statement with their labels; a bar parts the printed lines of one row.
_INCOME = (("revenue", "Revenue from operations   25", 1), ("cogs", "Changes in inventories of finished goods, work-in-progress and   29|", 0), ("finance_costs", "Finance costs   31", 0), ("net_income", "Profit for the year (C=A+B)", 1))
_BALANCE = (("long_term_debt", "Borrowings", 0), ("short_term_debt", "Borrowings", 0), ("total_assets", "Total assets", 0))
_REST = (("equity", "Total equity", 0), ("inventory", "Inventories", 0), ("receivables", "Trade receivables", 0))
_NOTES = (("revenue", "Revenue", 2), ("finance_costs", "Finance costs", 2), ("net_income", "Profit for the year", 2))
_METRICS = sorted({m for rows in (_INCOME, _BALANCE, _REST, _NOTES) for m, *_ in rows})


def _figure(metric: str, year: str, more: int) -> Column:
    """A printed figure, ``more`` above the reported one; a hyphen if there is none."""
    value = F.floor(F.abs(F.col(f"{year}.{metric}")) * 10000).cast("long") + more
    shown = F.format_number(value, 0)
    return F.coalesce(F.when(F.col(f"{year}.{metric}") < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown), F.lit("-"))


def _rows(rows: tuple) -> list[Column]:
    out = []
    for metric, label, more in rows:
        figures = F.concat(_figure(metric, "now", more), F.lit("   "), _figure(metric, "past", more))
        out.append(F.concat(F.lit(label.replace("|", "\n") if "|" in label else f"{label}   "), figures))
    return out


def _page() -> Column:
    """One page of a report: statements of a year and the one before, with sections, a wrapped row, an interruption and notes.

    The last table has interim columns; a text table keeps only their names, which are no header, so it gives no facts.
    """
    now, past = F.col("year").cast("string"), (F.col("year") - 1).cast("string")
    head = lambda before, after="": F.concat(F.lit(f"Particulars   {before}"), now, F.lit(f"   {after or before}"), past)
    even = F.col("company_id") % 2 == 0
    income, balance = _rows(_INCOME), _rows(_BALANCE)
    lines = [
        F.concat(F.lit("# "), "company", F.lit(" Limited")), F.lit(""), F.concat(F.lit("Annual Report FY"), now, F.lit(". "), F.when(even, "(INR in crore)").otherwise("(USD in millions)")), F.lit(""),
        F.lit("# Standalone Statement of Profit and Loss"), F.lit(""), head("Note   FY", "FY"), F.lit("INCOME"), income[0], income[1], F.lit("stock-in-trade"), income[2], income[3], F.lit("Net profit margin   12.0%   11.0%"), F.lit(""),
        F.lit("# Consolidated Balance Sheet"), F.lit("---"), head("As at December 31, "), F.lit("Non-current liabilities"), balance[0], F.lit("Current liabilities"), balance[1], balance[2],
        F.lit("The figures below go on after this sentence in the same statement of the year."), *_rows(_REST), F.lit(""),
        F.lit("# Notes to the consolidated financial statements"), F.lit(""), head("FY"), *_rows(_NOTES), F.lit("# Quarterly results"), head("Quarter ended June 30, "), *_rows(_NOTES),
    ]
    return F.array_join(F.array(*lines), "\n")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, text): a report of each company, a page for each year that has one before it."""
    best = f.best_facts(facts(spark, sf_dir)).where(F.col("metric").isin(_METRICS))
    wide = best.groupBy("company_id", "company", F.col("fiscal_year").alias("year")).agg(F.struct(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in _METRICS]).alias("now"))
    wide = written(wide, "years")  # read twice; a row for each company and year
    past = wide.select("company_id", (F.col("year") + 1).alias("year"), F.col("now").alias("past"))
    pages = wide.join(past, ["company_id", "year"]).select("company_id", F.struct("year", _page().alias("text")).alias("page"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p["text"]), "\f")  # a page for each fiscal year
    return pages.groupBy("company_id").agg(text.alias("text")).select(F.col("company_id").cast("string").alias("document_id"), "text")


def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found in the lines of reports and of all documents: where they stand, and their first and last rows."""
    prose = spread(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"), "text"))
    found = elements(filings(spark, sf_dir).unionByName(prose)).where("kind = 'table'")
    joined = lambda row: F.array_join(row, "|")
    return found.select("document_id", "page", "start", "end", F.size("grid").alias("n_rows"), joined(F.get("grid", F.lit(0))).alias("first"), joined(F.element_at("grid", -1)).alias("last"))


def statement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the reports' tables, with inherited columns, sections of the balance sheet, interim columns and weights."""
    read = sections.weighted(sections.passages(elements(filings(spark, sf_dir))), statements.MOST_PAGES)
    return statements.facts_of(read).select("document_id", "page", "metric", "period", "value", "scale", "unit", "currency", "confidence")


def section_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the reports and of all documents by section and type."""
    prose = spread(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"), "text"))
    found = sections.passages(elements(filings(spark, sf_dir).unionByName(prose)))
    return found.select("document_id", "chunk_index", "page_start", "page_end", "section", "chunk_type", "n_tokens", F.md5("text").alias("digest"))


QUERIES = {"text_tables": text_tables, "statement_facts": statement_facts, "section_passages": section_passages}

_PAIRS_SQL = f"""{SQL_WITH}, years AS (SELECT company_id, company, fiscal_year AS year, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year) AS page
    FROM (SELECT DISTINCT company_id, company, fiscal_year FROM best) n WHERE EXISTS (SELECT 1 FROM best p WHERE p.company_id = n.company_id AND p.fiscal_year = n.fiscal_year - 1)),
  shown AS (SELECT company_id, metric, fiscal_year, floor(abs(value) * 10000)::BIGINT AS n, value < 0 AS below FROM best)"""

_PRINTED = [(t, m, more) for t, rows in enumerate((_INCOME, _BALANCE, _REST, _NOTES)) for m, _, more in rows]


def _print_sql(metric: str, year: str, more: int) -> str:
    return f"coalesce((SELECT CASE WHEN below THEN '(' || format('{{:,}}', n + {more}) || ')' ELSE format('{{:,}}', n + {more}) END FROM shown s WHERE s.company_id = y.company_id AND s.metric = '{metric}' AND s.fiscal_year = {year}), '-')"


ORACLE_SQL = {
    "text_tables": f"""{_PAIRS_SQL}, t("start", "end", n_rows) AS (VALUES (3, 12, 8), (13, 19, 6), (20, 23, 3), (24, 28, 4), (29, 33, 4))
      SELECT company_id::VARCHAR AS document_id, page::INTEGER AS page, "start", "end", n_rows,
        CASE "start" WHEN 3 THEN concat('Particulars|FY', year, '|FY', year - 1) WHEN 13 THEN concat('Particulars|FY', year, '|FY', year - 1) WHEN 24 THEN concat('Particulars|FY', year, '|FY', year - 1) WHEN 29 THEN concat('Particulars|Interim Jun ', year, '|Interim Jun ', year - 1)
          ELSE concat('Total equity|', {_print_sql("equity", "year", 0)}, '|', {_print_sql("equity", "year - 1", 0)}) END AS "first",
        CASE "start" WHEN 3 THEN 'Net profit margin|12.0%|11.0%' WHEN 13 THEN concat('Total assets|', {_print_sql("total_assets", "year", 0)}, '|', {_print_sql("total_assets", "year - 1", 0)})
          WHEN 20 THEN concat('Trade receivables|', {_print_sql("receivables", "year", 0)}, '|', {_print_sql("receivables", "year - 1", 0)})
          ELSE concat('Profit for the year|', {_print_sql("net_income", "year", 2)}, '|', {_print_sql("net_income", "year - 1", 2)}) END AS "last"
      FROM years y, t""",
    "statement_facts": f"""{_PAIRS_SQL}, p(t, metric, more) AS (VALUES {", ".join(f"({t}, '{m}', {more})" for t, m, more in _PRINTED)})
      SELECT y.company_id::VARCHAR AS document_id, page::INTEGER AS page, CASE WHEN p.metric = 'cogs' THEN 'inventory_change' ELSE p.metric END AS metric,
        'FY' || s.fiscal_year AS period, (CASE WHEN below THEN -1.0 ELSE 1.0 END * (n + more))::DOUBLE AS value,
        CASE WHEN y.company_id % 2 = 0 THEN 1e7 ELSE 1e6 END::DOUBLE AS scale, CASE WHEN y.company_id % 2 = 0 THEN 'crore' ELSE 'million' END AS unit, CASE WHEN y.company_id % 2 = 0 THEN 'INR' ELSE 'USD' END AS currency,
        round(CASE WHEN p.metric IN ('cogs', 'long_term_debt', 'short_term_debt') THEN 0.9 ELSE 1 END * CASE t WHEN 0 THEN 0.9 WHEN 3 THEN 0.8 ELSE 1 END, 3)::DOUBLE AS confidence
      FROM years y, p JOIN shown s ON s.metric = p.metric WHERE s.company_id = y.company_id AND s.fiscal_year IN (year, year - 1)""",
}
