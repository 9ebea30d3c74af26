"""Statement tables of passages to facts, with what a table takes over from those before it.

A table without a header of its own continues the last table that was read, if that
stands on the same page and in the same part; values are never given to a period by
guesswork.  Rows carry the last heading above them, their section of the balance
sheet and whether an earnings-per-share heading was met.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import labels, periods
from quillstone.functions import lines as ln
from quillstone.functions import text as t

#: Rows from the top that may be the header.
HEADER_ROWS = 6

#: Sections of a balance sheet, and pages of a statement after its first.
SECTION, MOST_PAGES = r"^(non current|current) (assets|liabilities)\b", 2

PER_SHARE = ("eps", "eps_diluted")
KEY = ["document_id", "chunk_index"]


def _cells(grid: Column) -> Column:
    """Clean rows of a grid that have a cell."""
    clean = F.transform(grid, lambda row: F.transform(row, lambda c: F.regexp_replace(t.stripped(F.coalesce(c, F.lit(""))), r"\s+", " ")))
    return F.filter(clean, lambda row: F.exists(row, lambda c: c != ""))


def _figures(cells: Column) -> Column:
    """The cells; one that holds several figures between blanks is parted."""
    def parts(cell: Column) -> Column:
        cut = F.split(cell, " ")
        return F.when((cell != "") & F.forall(cut, t.is_figure), cut).otherwise(F.array(cell))

    return F.flatten(F.transform(cells, parts))


def _resolved(norm: Column, context: Column, section: Column) -> Column:
    """(metric, confidence) of a normalized label below its headings."""
    share = norm.isin("basic", "diluted") | norm.rlike("^(basic|diluted) (in|rs)")
    named = context.contains("earnings per") | context.rlike(r"(^| )eps( |$)")
    apart = context.contains("discontinued") & ~context.contains("continuing")
    whole = context.contains("continuing and discontinued")
    answer = lambda metric, sure: F.struct(metric.alias("metric"), sure.alias("confidence"))
    eps = F.when(named & ~apart, answer(F.when(norm.startswith("basic"), "eps").otherwise("eps_diluted"), F.when(whole, 0.95).otherwise(0.9)))
    long, short = section.startswith("non current"), section.startswith("current")
    debt = answer(F.when(long, "long_term_debt").when(short, "short_term_debt").otherwise("total_debt"), F.when(long | short, 0.9).otherwise(0.8))
    return F.when(share, eps).when(norm.isin("borrowings", "financial liabilities borrowings"), debt)


@cache
def _header() -> tuple[Column, Column]:
    """Periods of a row's cells, and their labels if the row is a header; made once, as they are large."""
    joined = F.col("joined")
    found = F.when((F.col("row_no") < HEADER_ROWS) & joined.rlike(r"\d\d"), F.flatten(F.transform("cells", periods.periods)))
    return found, F.when((F.size("found") > 0) & (ln.residue(joined) <= 3), ln.period_labels(joined, F.col("found")))


def rows_of(tables: DataFrame) -> DataFrame:
    """(document_id, chunk_index, page, part, periods, inherited, row_no, label, values, metric, confidence, head) of the rows with figures.

    tables: (document_id, chunk_index, page_start, part, title, grid), one row for each
    table in the order of chunk_index.  A row counts if it has as many figures as there
    are periods; it takes the last ones.  Rows with percentages are left out.
    """
    grids = tables.select(*KEY, F.col("page_start").alias("page"), "part", "title", F.posexplode(_cells(F.col("grid"))).alias("row_no", "cells"))
    found, named = _header()
    joined = F.col("joined")
    grids = grids.withColumn("joined", F.array_join("cells", " ")).withColumn("found", found).withColumn("named", named)
    each = Window.partitionBy(*KEY)
    best = F.when(F.size("named") > 0, F.struct(F.size("named").alias("n"), (-F.col("row_no")).alias("place"), F.col("named").alias("periods")))
    grids = grids.withColumn("own", F.max(best).over(each)).withColumn("at", F.coalesce(-F.col("own.place"), F.lit(-1)))
    head = F.array_join(F.concat(F.array("title"), F.transform(F.array_sort(F.collect_list(F.when(F.col("row_no") <= F.col("at"), F.struct("row_no", joined.alias("said")))).over(each)), lambda x: x["said"])), " ")
    grids = grids.withColumn("head", head).where(F.col("row_no") > F.col("at"))

    label_at = F.array_position(F.transform("cells", lambda c: c.rlike("[A-Za-z]")), True).cast("int")
    rows = grids.withColumn("label_at", label_at).where("label_at > 0")
    rows = rows.withColumn("label", F.get("cells", F.col("label_at") - 1)).withColumn("figures", _figures(F.slice("cells", F.col("label_at") + 1, F.greatest(F.size("cells") - F.col("label_at"), F.lit(0)))))
    heading = ~F.exists("figures", t.is_figure)
    before = each.orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    so_far = each.orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    norm = labels.normalized(F.col("label"))
    rows = rows.withColumn("norm", norm).withColumn("heading", F.when(heading, F.col("norm")))
    rows = rows.withColumn("above", F.coalesce(F.last("heading", ignorenulls=True).over(before), F.lit(""))).withColumn("scope", F.max(F.lower("label").contains("earnings per")).over(so_far))
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(F.col("heading").rlike(SECTION), F.col("heading")), ignorenulls=True).over(before), F.lit("")))
    context = F.trim(F.concat_ws(" ", F.when(F.col("scope"), "earnings per share").otherwise(""), "above"))
    rows = rows.where("heading is null").withColumn("special", _resolved(F.col("norm"), context, F.col("section")))

    # The last table with a header of its own that had a row, and the same page and part: only it can be continued.
    fits = lambda named: (F.size("figures") >= F.size(named)) & ~F.exists(F.slice("figures", F.greatest(F.size("figures") - F.size(named) + 1, F.lit(1)), F.greatest(F.size(named), F.lit(1))), lambda c: c.endswith("%"))
    rows = rows.withColumn("was_read", F.max(F.col("own").isNotNull() & fits(F.col("own.periods"))).over(each))
    past = Window.partitionBy("document_id").orderBy("chunk_index").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.last(F.when(F.col("was_read"), F.struct("page", "part", F.col("own.periods").alias("periods"))), ignorenulls=True).over(past))
    same = (F.col("last.page") == F.col("page")) & F.col("last.part").eqNullSafe(F.col("part"))
    rows = rows.withColumn("inherited", F.col("own").isNull()).withColumn("periods", F.coalesce("own.periods", F.when(same, F.col("last.periods"))))
    rows = rows.where(F.col("periods").isNotNull() & fits(F.col("periods")))
    values = F.transform(F.slice("figures", F.size("figures") - F.size("periods") + 1, F.size("periods")), t.parsed_number)
    rows = labels.with_metrics(rows.withColumn("values", values), "label")
    plain = F.col("norm").isin("basic", "diluted", "borrowings", "financial liabilities borrowings") | F.col("norm").rlike("^(basic|diluted) (in|rs)")
    metric, sure = F.when(plain, F.col("special.metric")).otherwise(F.col("metric")), F.when(plain, F.col("special.confidence")).otherwise(F.col("confidence"))
    return rows.select(*KEY, "page", "part", "periods", "inherited", "row_no", "label", "values", metric.alias("metric"), sure.alias("confidence"), "head")


def facts_of(passages: DataFrame, unit: Column | None = None, currency: Column | None = None) -> DataFrame:
    """(document_id, chunk_index, page, metric, label, period, value, scale, unit, currency, confidence) of sections.weighted() passages.

    Unit and currency stand in the title or header, else at the head of the page, else
    they are the given ones.  Figures by share have no scale.  Of several rows of one
    metric and period in a table the surest counts, then the first; the weight of the
    passage takes part in how sure it is.
    """
    tables = passages.where("grid is not null")
    rows = rows_of(tables).where("metric is not null")
    long = rows.select("*", F.posexplode(F.arrays_zip("periods", "values")).alias("place", "p")).where("p.values is not null")
    first = Window.partitionBy(*KEY, "metric", "p.periods").orderBy(F.desc("confidence"), "row_no", "place")
    long = long.withColumn("n", F.row_number().over(first)).where("n = 1").join(tables.select(*KEY, "context", "weight"), KEY)
    named = F.coalesce(t.unit(F.col("head")), t.unit(F.col("context")), F.lit(None).cast("struct<name:string,scale:double>") if unit is None else unit)
    of = F.coalesce(F.nullif(t.currency(F.col("head")), F.lit("")), F.nullif(t.currency(F.col("context")), F.lit("")), F.lit("") if currency is None else currency)
    long = long.withColumn("unit", named).withColumn("per_share", F.col("metric").isin(*PER_SHARE))
    scale = F.when(F.col("per_share"), 1.0).otherwise(F.coalesce("unit.scale", F.lit(1.0)))
    name = F.when(F.col("per_share") & (F.coalesce("unit.scale", F.lit(1.0)) != 1.0), "").otherwise(F.coalesce("unit.name", F.lit("")))
    return long.select(*KEY, "page", "metric", "label", F.col("p.periods").alias("period"), F.col("p.values").alias("value"), scale.alias("scale"), name.alias("unit"), of.alias("currency"), F.round(F.col("confidence") * F.col("weight"), 3).alias("confidence"))
