"""Statement tables, given as rows of cells, to facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import labels, periods
from quillstone.functions import text as t

#: Rows from the top that may be the header.
HEADER_ROWS = 6


def _figure(cell: Column) -> Column:
    """Whether a cell holds a figure or a percentage."""
    return t.parsed_number(cell).isNotNull() | cell.rlike(r"^\s*[-(]?[\d,.]+\s*%\)?\s*$")


def facts_of(grids: DataFrame) -> DataFrame:
    """(grid_id, metric, period, value, confidence) of (grid_id, row_idx, cells).

    The header is the row among the first six that names most periods; without
    one a grid gives no facts.  A row needs as many figures as there are periods
    and takes the last ones, so note numbers are passed over; a row with a
    percentage among them is dropped.  Of several rows of one metric and period
    the surest counts, then the first.
    """
    named = F.filter(F.transform("cells", lambda c: periods.fiscal_label(c)), lambda p: p.isNotNull())
    top = grids.where(F.col("row_idx") < HEADER_ROWS).select("grid_id", F.col("row_idx").alias("header"), named.alias("periods")).where(F.size("periods") > 0)
    first = Window.partitionBy("grid_id").orderBy(F.desc(F.size("periods")), "header")
    header = top.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    body = grids.join(header, "grid_id").where("row_idx > header").withColumn("figures", F.filter(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), _figure))
    n = F.size("periods")
    body = body.where(F.size("figures") >= n).withColumn("figures", F.slice("figures", F.size("figures") - n + 1, n)).where(~F.exists("figures", lambda c: c.contains("%")))
    rows = labels.with_metrics(body.withColumn("label", F.get("cells", F.lit(0))), "label").where("metric is not null")
    long = rows.select("grid_id", "row_idx", "metric", "confidence", F.explode(F.arrays_zip("periods", "figures")).alias("p"))
    long = long.select("grid_id", "row_idx", "metric", "confidence", F.col("p.periods").alias("period"), t.parsed_number(F.col("p.figures")).alias("value")).where("value is not null")
    surest = Window.partitionBy("grid_id", "metric", "period").orderBy(F.desc("confidence"), "row_idx")
    return long.withColumn("place", F.row_number().over(surest)).where("place = 1").select("grid_id", "metric", "period", "value", "confidence")
