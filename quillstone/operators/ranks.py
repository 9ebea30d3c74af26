"""Order numbers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds number, 0 and up in this order, by a distributed sort; the order must tell all rows apart."""
    placed = rows.orderBy(*order).withColumn("n", F.monotonically_increasing_id())
    part, row = F.shiftright("n", 33), F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row for each partition of the sort
    return placed.withColumn("part", part).join(F.broadcast(before), "part").select(*rows.columns, (F.col("before") + row).alias("number"))
