"""A keyword index that is kept up to date by the changes of its texts.

Every batch adds a segment: the postings of its new texts, a row for each changed
document, and the change of every term's document count.  What a document had before
is found in the index, by the segment that holds it, so no old text is read again.
A segment is written under the number of its batch; a batch that runs twice writes
the same segment again, and reads only the segments before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.retrieval import text_postings
from quillstone.sources.shared import exists

DOCUMENTS = "doc_id long, sha256 string, n_terms long, deleted boolean, batch long"
POSTINGS = "doc_id long, term string, tf long, batch long"
COUNTS = "term string, change long, batch long"


class Index:
    """The segments in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _segments(self, name: str, schema: str, before: int | None) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def documents(self, before: int | None = None) -> DataFrame:
        """(doc_id, sha256, n_terms, batch): every document that is there, and the segment that holds its postings."""
        newest = self._segments("documents", DOCUMENTS, before).groupBy("doc_id").agg(F.max(F.struct("batch", "sha256", "n_terms", "deleted")).alias("d"))
        return newest.where("not d.deleted").select("doc_id", "d.sha256", "d.n_terms", "d.batch")

    def postings(self, before: int | None = None) -> DataFrame:
        """(doc_id, term, tf) of the documents that are there."""
        return self._segments("postings", POSTINGS, before).join(self.documents(before).select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").select("doc_id", "term", "tf")

    def counts(self, before: int | None = None) -> DataFrame:
        """(term, df): in how many documents each term is."""
        return self._segments("counts", COUNTS, before).groupBy("term").agg(F.sum("change").alias("df")).where("df > 0")

    def signature(self) -> tuple[int, int]:
        """How many documents there are and how many terms they have together."""
        return tuple(self.documents().agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first())

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Take (doc_id, version, text) in; a null text deletes the document, the highest version of a batch counts, equal texts change nothing."""
        newest = changes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("version", "text")).alias("c")).select("doc_id", F.col("c.text").alias("text"), F.sha2("c.text", 256).alias("sha256"))
        held = self.documents(batch).select("doc_id", F.col("sha256").alias("old"), F.col("batch").alias("old_batch"))
        moved = newest.join(held, "doc_id", "left").where(~F.col("sha256").eqNullSafe(F.col("old")))
        new = text_postings(moved.where("text is not null").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")
        self._put(new, "postings", batch)
        new = self.spark.read.parquet(f"{self.path}/postings/batch={batch}")
        sizes = new.groupBy("doc_id").agg(F.sum("tf").alias("n_terms"))
        gone = moved.where("old is not null").select("doc_id", F.col("old_batch").alias("batch"))
        lost = self._segments("postings", POSTINGS, batch).join(gone, ["doc_id", "batch"], "left_semi").groupBy("term").agg((-F.count("*")).alias("change"))
        change = new.groupBy("term").agg(F.count("*").alias("change")).unionByName(lost).groupBy("term").agg(F.sum("change").alias("change")).where("change <> 0")
        self._put(change, "counts", batch)
        rows = moved.select("doc_id", "sha256", F.col("text").isNull().alias("deleted")).join(sizes, "doc_id", "left")
        self._put(rows.select("doc_id", "sha256", F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"), "deleted"), "documents", batch)

    def scores(self, terms: DataFrame, k1: float, b: float, floor: float) -> DataFrame:
        """(query_id, doc_id, score) of (query_id, term) rows, by BM25 over what the index holds; rare-term weights below zero are a share of the mean weight."""
        n, total = self.signature()
        weight: Column = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = self.counts().withColumn("idf", weight)
        mean = weights.agg(F.avg("idf")).first()[0] or 0.0
        weights = weights.select("term", F.when(F.col("idf") < 0, floor * mean).otherwise(F.col("idf")).alias("idf"))
        mean_size = total / n if n else 1.0
        sized = self.postings().join(terms.select("term").distinct(), "term", "left_semi").join(self.documents().select("doc_id", "n_terms"), "doc_id")
        share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / mean_size))
        met = terms.join(weights, "term").join(sized, "term")
        return met.groupBy("query_id", "doc_id").agg(F.sum(F.round(F.col("idf") * share, 9).cast("decimal(38,9)")).cast("double").alias("score"))


def maintained(stream: DataFrame, index: Index, state: str) -> None:
    """Run a stream (doc_id, version, text) into the index until it has seen what is there now."""
    query = stream.writeStream.option("checkpointLocation", state).foreachBatch(index.apply).trigger(availableNow=True).start()
    query.awaitTermination()
