"""Joins that hold when one class has very many rows, and that broadcast no side whose size isn't known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A class with more than this part of all rows is split; there are fewer of them than this, so their keys are broadcast.
HOT_CLASSES = 2000


def shuffled(df: DataFrame) -> DataFrame:
    """df, which joins meet by shuffles whatever its estimate: that of a written table is its compressed size, and one of an explosion leaves out the rows that it adds."""
    return df.hint("merge")


def attached(rows: DataFrame, classes: DataFrame, keys: list[str], place: list[str], n_rows: int) -> DataFrame:
    """The inner join of rows with classes on keys; column members leaves.

    classes has each key once, and the number of its rows in members.  A class
    with more than its share is dealt into parts by a hash of ``place``, columns
    that tell its rows apart, and repeated for each part.
    """
    share = max(1, n_rows // HOT_CLASSES)
    parts = F.ceil(F.col("members") / share).cast("int")
    hot = classes.where(F.col("members") > share).select(*keys, parts.alias("parts"))  # fewer than HOT_CLASSES rows
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*place), F.col("parts"))).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("part", part).drop("parts")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("members") > share, parts - 1).otherwise(0)))
    return dealt.join(shuffled(classes.withColumn("part", every).drop("members")), [*keys, "part"]).drop("part")
