"""Registered stateful streams: rate limits, expiring counters, a maintained index, ingestion states and companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.search import tokens_sql
from quillstone.sources.shared import new_folder
from quillstone.sources.tables import table
from quillstone.streaming import feeds, limits
from quillstone.streaming.index import Index
from quillstone.streaming.ingestion import Store, ingested

#: Events that a client may send in a window of an hour, and seconds that a counter lives.
_LIMIT, _WINDOW, _LIFE, _COUNTER = 2, 3600, 5400, 6 * 3600


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its place in its client's window, and whether the limit takes it."""
    events = feeds.stream(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "event_id", "ts")
    return feeds.drained(limits.limited(events, _LIMIT, _WINDOW, _LIFE, "3650 days"), "append", "limits")


def stream_expiring_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its place in the counter of its type and user, which lives for six hours."""
    events = feeds.stream(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", "user_id").alias("key"), "event_id", "ts")
    return feeds.drained(limits.counted(events, _COUNTER, "3650 days"), "append", "counters").select("key", "event_id", "n")


def _changes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All documents; then new texts of some, the same texts of others; then some are deleted and some come back."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    of = lambda version, text, where: rows.where(where).select("doc_id", F.lit(version).cast("long").alias("version"), text.alias("text"))
    same, longer, gone = F.col("text"), F.concat("text", F.lit(" Revised wording of the outlook.")), F.lit(None).cast("string")
    return [of(1, same, "true"), of(2, longer, "doc_id % 5 = 0").unionByName(of(2, same, "doc_id % 5 = 1")), of(3, gone, "doc_id % 7 = 0").unionByName(of(3, same, "doc_id % 35 = 10"))]


def _sent(spark: SparkSession, parts: list[DataFrame], name: str) -> list[DataFrame]:
    """Each part as a stream of its own files."""
    path = new_folder(spark, name)
    out = []
    for k, part in enumerate(parts):
        part.write.parquet(f"{path}/{k}")
        out.append(spark.readStream.schema(part.schema).parquet(f"{path}/{k}"))
    return out


def index_of(spark: SparkSession, parts: list[DataFrame]) -> Index:
    """An index that took the parts in, one after the other; a batch's number is that of its part."""
    index = Index(spark, new_folder(spark, "index"))
    for k, stream in enumerate(_sent(spark, parts, "changes")):
        query = stream.writeStream.option("checkpointLocation", new_folder(spark, "state")).foreachBatch(lambda rows, n, k=k: index.apply(rows, 1000 * k + n)).trigger(availableNow=True).start()
        query.awaitTermination()
    return index


def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each term is, after three batches of changes."""
    return index_of(spark, _changes(spark, sf_dir)).counts()


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several kinds, with spellings of company names; some are empty."""
    ending = F.element_at(F.array(*[F.lit(x) for x in (" Ltd.", " Limited", ", Inc.", " PLC")]), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("file-"), "doc_id", F.element_at(F.array(*[F.lit(x) for x in (".txt", ".md", ".TXT", ".exe")]), (F.floor(F.col("doc_id") / 3) % 4 + 1).cast("int")))
    text = F.when(F.col("doc_id") % 11 == 0, F.lit("  \n")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), name.alias("name"), F.concat(F.lit("Company "), F.col("doc_id") % 25, ending).alias("company"), F.col("doc_id").alias("place"), text.alias("text"))


def ingestion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every document ended that the ingestion took in, with its passages and why it failed."""
    store = Store(spark, new_folder(spark, "ingestion"))
    (stream,) = _sent(spark, [_arrivals(spark, sf_dir)], "arrivals")
    ingested(stream, store, new_folder(spark, "state"))
    failed = store.dead_letters().select("document_id", "message")
    rows = store.states().join(failed, "document_id", "left").join(store.passages().groupBy("document_id").agg(F.count("*").alias("live")), "document_id", "left")
    return rows.select("document_id", "state", "code", "message", "n_passages", F.coalesce("live", F.lit(0).cast("long")).alias("live"), "company_key")


def company_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with their first name and other spellings, named by two batches of suppliers."""
    store = Store(spark, new_folder(spark, "companies"))
    endings = F.array(*[F.lit(x) for x in (" Ltd.", " Limited", ", Inc.", "")])
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Firm "), F.col("s_suppkey") % 40, F.element_at(endings, (F.floor(F.col("s_suppkey") / 40) % 4 + 1).cast("int"))).alias("name"), F.col("s_suppkey").alias("place"))
    for batch, part in enumerate(("place % 2 = 0", "place % 2 = 1")):
        store.name_companies(rows.where(part), batch)
    return store.companies().select("key", "name", F.array_join("aliases", ";").alias("aliases"))


QUERIES = {
    "stream_rate_limit": stream_rate_limit, "stream_expiring_counters": stream_expiring_counters, "incremental_index": incremental_index, "ingestion_states": ingestion_states, "company_upsert": company_upsert,
}

ORACLE_SQL = {
    "stream_rate_limit": f"""WITH e AS (SELECT user_id AS client, event_id, epoch_ms(ts) // {1000 * _WINDOW} AS "window", row_number() OVER (PARTITION BY user_id, epoch_ms(ts) // {1000 * _WINDOW} ORDER BY epoch_ms(ts), event_id) AS n FROM events)
      SELECT *, n <= {_LIMIT} AS accepted FROM e""",
    "stream_expiring_counters": f"""WITH RECURSIVE e AS (SELECT concat_ws('/', event_type, user_id) AS key, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY event_type, user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events),
      c AS (SELECT key, event_id, i, ms + {1000 * _COUNTER} AS ends, 1::BIGINT AS n FROM e WHERE i = 1 UNION ALL
        SELECT e.key, e.event_id, e.i, CASE WHEN ends <= ms THEN ms + {1000 * _COUNTER} ELSE ends END, CASE WHEN ends <= ms THEN 1 ELSE n + 1 END FROM c JOIN e ON e.key = c.key AND e.i = c.i + 1)
      SELECT key, event_id, n FROM c""",
    "incremental_index": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 35 = 10 THEN text WHEN doc_id % 5 = 0 THEN text || ' Revised wording of the outlook.' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)
      SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({tokens_sql("text")})) AS term FROM d) GROUP BY 1""",
    "company_upsert": """WITH n AS (SELECT 'firm ' || (s_suppkey % 40) AS key, 'Firm ' || (s_suppkey % 40) || [' Ltd.', ' Limited', ', Inc.', ''][((s_suppkey // 40) % 4 + 1)::INT] AS name, min((s_suppkey % 2) * 1000000000 + s_suppkey) AS seen FROM supplier GROUP BY 1, 2),
      o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen) AS place FROM n)
      SELECT key, max(name) FILTER (place = 1) AS name, coalesce(string_agg(name, ';' ORDER BY place) FILTER (place > 1), '') AS aliases FROM o GROUP BY 1""",
}
