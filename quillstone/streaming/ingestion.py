"""Documents through their states: queued, processing, then ready or failed.

Every batch writes a segment under its number: first that its documents are in
processing, then their passages and facts, at last how they ended.  Passages and facts
count only while the newest state of their document is ready and of the same batch, so a
document is replaced as a whole, a failed one has no rows, and a batch that ran halfway
shows nothing.  A batch that runs again writes the same segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions import text as t
from quillstone.operators import sections, statements
from quillstone.operators.elements import elements
from quillstone.sources.shared import deleted, exists

#: Formats that are read, the fewest characters of a text that is not empty, and what failed documents are told.
FORMATS, LEAST_CHARS = ("txt", "md"), 20
MESSAGES = {"unsupported_format": "Unsupported file type.", "empty_document": "The text file is empty.", "no_content": "No usable content was found in the document.", "interrupted": "Processing was interrupted. Upload the document again."}

STATES = "document_id string, state string, code string, n_passages long, n_facts long, company_key string, stage int, batch long"
COMPANIES = "key string, name string, place long, batch long"


def company_key(name: Column) -> Column:
    """The key of a company; names of nothing but legal endings keep their own words."""
    key = t.company_key(name)
    return F.when(key != "", key).otherwise(F.lower(t.stripped(name)))


class Store:
    """The segments in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _segments(self, name: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            # No rows, and no Python worker for them.
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def _put(self, rows: DataFrame, name: str, batch: int, stage: int | None = None) -> None:
        part = "" if stage is None else f"/stage={stage}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/batch={batch}{part}")

    def states(self) -> DataFrame:
        """(document_id, state, code, n_passages, n_facts, company_key, batch): the newest state of every document."""
        newest = F.max(F.struct("batch", "stage", "state", "code", "n_passages", "n_facts", "company_key")).alias("s")
        return self._segments("states", STATES).groupBy("document_id").agg(newest).select("document_id", "s.state", "s.code", "s.n_passages", "s.n_facts", "s.company_key", "s.batch")

    def dead_letters(self) -> DataFrame:
        """(document_id, code, message, batch) of the documents that failed last."""
        message = F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.col("code"))
        return self.states().where("state = 'failed'").select("document_id", "code", message.alias("message"), "batch")

    def _live(self, name: str, schema: str) -> DataFrame:
        ready = self.states().where("state = 'ready'").select("document_id", "batch")
        return self._segments(name, schema).join(ready, ["document_id", "batch"], "left_semi").drop("batch")

    def passages(self) -> DataFrame:
        return self._live("passages", "document_id string, chunk_index int, page_start int, page_end int, section string, chunk_type string, text string, n_tokens int, batch long")

    def facts(self) -> DataFrame:
        return self._live("facts", "document_id string, chunk_index int, page int, metric string, label string, period string, value double, scale double, unit string, currency string, confidence double, batch long")

    def companies(self) -> DataFrame:
        """(key, name, aliases): the name that came first, and the other spellings in the order in which they came."""
        first = self._segments("companies", COMPANIES).groupBy("key", "name").agg(F.min(F.struct("batch", "place")).alias("at"))
        # Spellings of one company, which are few.
        spelled = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"])
        return first.groupBy("key").agg(spelled.alias("spelled")).select("key", F.col("spelled")[0].alias("name"), F.slice("spelled", 2, F.greatest(F.size("spelled") - 1, F.lit(0))).alias("aliases"))

    def name_companies(self, rows: DataFrame, batch: int) -> None:
        """Take (name, place) in: new keys are inserted, new spellings of known ones appended."""
        named = rows.where(t.stripped(F.col("name")) != "").select(t.stripped(F.col("name")).alias("name"), "place").groupBy("name").agg(F.min("place").alias("place"))
        keyed = named.select(company_key(F.col("name")).alias("key"), "name", "place")
        held = self._segments("companies", COMPANIES).where(F.col("batch") < batch).select("key", "name").distinct()
        self._put(keyed.join(held, ["key", "name"], "left_anti"), "companies", batch)

    def take(self, arrived: DataFrame, batch: int, facts: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Take (document_id, name, company, place, text) in; of rows of one document the last place counts.

        The batch's documents are judged and written once; what follows reads their texts
        once, and else only their short columns.
        """
        newest = F.max(F.struct("place", "name", "company", "text")).alias("d")
        rows = arrived.where("document_id is not null").groupBy(F.col("document_id").cast("string").alias("document_id")).agg(newest).select("document_id", "d.*")
        kind = F.lower(F.element_at(F.split(F.coalesce("name", F.lit("")), r"\."), -1))
        early = F.when(~kind.isin(*FORMATS), "unsupported_format").when(F.length(t.stripped_long(F.coalesce("text", F.lit("")))) < LEAST_CHARS, "empty_document")
        judged = rows.select("document_id", "place", "company", company_key(F.col("company")).alias("company_key"), early.alias("code"), "text")
        judged = judged.withColumn("text", F.when(F.col("code").isNull(), F.col("text")))
        self._put(judged, "arrived", batch)
        judged = self.spark.read.schema(judged.schema).parquet(f"{self.path}/arrived/batch={batch}")
        begun = judged.select("document_id", F.lit("processing").alias("state"), F.lit(None).cast("string").alias("code"), F.lit(0).cast("long").alias("n_passages"), F.lit(0).cast("long").alias("n_facts"), "company_key")
        self._put(begun, "states", batch, 0)
        read = sections.passages(elements(judged.where("code is null").select("document_id", "text")))
        self._put(read.select("document_id", "chunk_index", "page_start", "page_end", "section", "title", "chunk_type", "table_index", "text", "n_tokens", "grid", "context"), "passages", batch)
        read = self.spark.read.parquet(f"{self.path}/passages/batch={batch}")
        found = (facts or (lambda p: statements.facts_of(sections.weighted(p, statements.MOST_PAGES))))(read)
        self._put(found, "facts", batch)
        found = self.spark.read.parquet(f"{self.path}/facts/batch={batch}")
        sizes = read.groupBy("document_id").agg(F.count("*").alias("n_passages")).join(found.groupBy("document_id").agg(F.count("*").alias("n_facts")), "document_id", "left")
        ended = judged.join(sizes, "document_id", "left").withColumn("code", F.coalesce("code", F.when(F.col("n_passages").isNull(), "no_content")))
        number = lambda c: F.when(F.col("code").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
        self.name_companies(ended.where("code is null and company is not null").select(F.col("company").alias("name"), "place"), batch)
        self._put(ended.select("document_id", F.when(F.col("code").isNull(), "ready").otherwise("failed").alias("state"), "code", number("n_passages"), number("n_facts"), "company_key"), "states", batch, 1)
        deleted(self.spark, f"{self.path}/arrived/batch={batch}")

    def recover(self, batch: int) -> None:
        """Documents that a run left in processing fail, so that they can be sent again."""
        stuck = self.states().where("state in ('queued', 'processing')")
        gone = stuck.select("document_id", F.lit("failed").alias("state"), F.lit("interrupted").alias("code"), F.lit(0).cast("long").alias("n_passages"), F.lit(0).cast("long").alias("n_facts"), "company_key")
        self._put(gone, "states", batch, 2)


def ingested(stream: DataFrame, store: Store, state: str) -> None:
    """Run a stream (document_id, name, company, place, text) into the store until it has seen what is there now."""
    query = stream.writeStream.option("checkpointLocation", state).foreachBatch(store.take).trigger(availableNow=True).start()
    query.awaitTermination()


def queue_of(states: DataFrame, arrived: DataFrame) -> DataFrame:
    """(document_id, state): documents that came, as queued if no batch has taken them yet."""
    newest = Window.partitionBy("document_id").orderBy(F.desc("place"))
    rows = arrived.select(F.col("document_id").cast("string").alias("document_id"), "place").withColumn("n", F.row_number().over(newest)).where("n = 1")
    return rows.join(states.select("document_id", "state"), "document_id", "left").select("document_id", F.coalesce("state", F.lit("queued")).alias("state"))
