"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.lineage import dropped, written
from quillstone.llm.skew import shuffled


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    links has the long columns a and b.  Alternating large-star and small-star
    rounds move every node next to its root; each round is a written table, a
    round that changes nothing is the last.  A node's neighbours are reduced by
    a partial minimum and joined back, never gathered, so a hub of any size is
    split by the skew-join rule.  Nulls and self-links are ignored.
    """
    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(lowest), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e")).select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        after_edges = written(small, "links")
        after = signature(after_edges)
        dropped(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
