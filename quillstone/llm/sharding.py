"""Two-pass external shuffle into shards.

Pass one scatters the whole records uniformly into buckets with a seeded hash;
the number of buckets follows the rows and bytes of the input, so one bucket
always fits in memory.  A text longer than ``LONG_BYTES`` is written beside the
buckets under its SHA-256, which takes its place in the record.  Each bucket is
shuffled by itself (Spark's ``shuffle`` is a Fisher-Yates shuffle) and written to
the shared folder.  Pass two reads the buckets, adds each bucket's offset to the
places inside it, deals the places out in turn and brings the long texts back:
place modulo the number of shards is the shard, so counts differ by one at most
(the law ``rows``).

Buckets come from the seed and the values of a record, never from its place in the
input, so shards follow from seed and data alone.  Equal rows whose copies would
fill much of a bucket are counted and numbered, and the number takes part in the
hash; other equal rows share a bucket.

Only DataFrame functions are used.  Buckets of one task are sorted before they
are shuffled, so a retried task deals the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.lineage import new_folder, written

#: Records and bytes of one bucket on average, whichever gives more buckets.
BUCKET_ROWS = 16384
BUCKET_BYTES = 16 << 20

#: Longer texts go beside the buckets, so that chance can't make one bucket much larger than the others.
LONG_BYTES = 1 << 20

#: Tasks of the scatter; beyond that a task holds several buckets.
TASKS = 20000

#: Different rows at most, about, whose copies are numbered (their hashes are broadcast).
HOT_ROWS = 500_000

#: Buckets up to which their offsets (16 bytes each) are broadcast.
BROADCAST_BUCKETS = 200_000


def _bytes(records: DataFrame, column: str) -> Column:
    kind = records.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(column))).cast("long")
    return F.lit(16).cast("long")


#: Internal column: the number of a copy.
_COPY = "__copy"


def _numbered_copies(records: DataFrame, columns: list[str], key: Column, row_bytes: Column, limit: int) -> DataFrame:
    """The records, with numbers in _COPY for rows whose copies hold more than ``limit`` bytes together."""
    name = F.xxhash64(key, *columns)
    hot = records.groupBy(name.alias("name")).agg(F.sum(row_bytes + 16).alias("bytes"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("bytes") > limit)).select("name")
    hot = written(hot, "hot-rows")
    if hot.isEmpty():
        return records
    known = F.broadcast(hot)  # at most all bytes / limit rows
    named = records.withColumn("__name", name)
    one = named.join(known, named["__name"] == known["name"], "left_semi").groupBy(*columns).agg(F.count("*").alias("__n"))
    copies = one.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias(_COPY))
    return named.join(known, named["__name"] == known["name"], "left_anti").select(*columns, _COPY).unionByName(copies)


def shuffled(records: DataFrame, key: Column, shards: int = 8, seed: int = 20240229, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The records with ``shard`` (int) and ``slot`` (long), each once.

    The bucket of a record is a hash of the seed, the key and all values, so null
    keys spread like all others; many copies of one row are numbered and spread too.
    Null, empty and very long texts are dealt like all others.
    Columns must be orderable (no maps); columns named shard or slot are replaced.
    Only a string column named text may go beside the buckets; values of other
    columns must be small against a bucket.  An empty table gives an empty result.
    """
    columns = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    has_text = "text" in columns and isinstance(records.schema["text"].dataType, T.StringType)
    is_long = F.octet_length("text") > long_bytes if has_text else F.lit(False)
    row_bytes = sum((F.when(is_long, F.lit(64)).otherwise(_bytes(records, c)) if c == "text" else _bytes(records, c) for c in columns), F.lit(0).cast("long"))
    n_rows, n_bytes, n_long = records.agg(F.count("*"), F.coalesce(F.sum(row_bytes), F.lit(0)), F.count_if(F.coalesce(is_long, F.lit(False)))).first()
    buckets = max(1, -(-n_rows // bucket_rows), -(-n_bytes // bucket_bytes))
    tasks = min(buckets, TASKS)
    records = _numbered_copies(records.withColumn(_COPY, F.lit(0)), columns, key, row_bytes, max(bucket_bytes // 4, n_bytes // HOT_ROWS))
    beside = F.when(is_long, F.sha2("text", 256)) if n_long else F.lit(None).cast("string")
    record = F.struct(*[F.when(is_long, F.lit(None)).otherwise(records[c]).alias(c) if c == "text" and n_long else records[c] for c in columns], beside.alias("beside"))
    placed = records.select(record.alias("record"), F.pmod(F.xxhash64(F.lit(seed), key, *columns, _COPY), F.lit(buckets)).cast("int").alias("bucket"))
    scattered = placed.withColumn("task", F.col("bucket") % tasks).repartitionById(tasks, F.col("task"))
    packed = scattered.groupBy("task", "bucket").agg(F.array_sort(F.collect_list("record")).alias("records")).sortWithinPartitions("bucket")
    dealt = written(packed.select("bucket", F.size("records").cast("long").alias("size"), F.shuffle("records", seed).alias("records")), "buckets")
    offsets = dealt.select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("offset"))
    joined = dealt.join(F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets, "bucket")
    place = F.col("offset") + F.col("pos")
    exploded = joined.select("offset", F.posexplode("records").alias("pos", "record"))
    places = exploded.select("record", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))
    plain = [F.col(f"record.`{c}`").alias(c) for c in columns]
    if not n_long:
        return places.select(*plain, "shard", "slot")
    long_texts = written(records.where(is_long).groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("long_text")), "long-texts")
    rejoined = places.where("record.beside IS NOT NULL").join(long_texts, F.col("record.beside") == F.col("digest"))
    brought = rejoined.select(*[F.col("long_text").alias(c) if c == "text" else e for c, e in zip(columns, plain, strict=True)], "shard", "slot")
    return places.where("record.beside IS NULL").select(*plain, "shard", "slot").unionByName(brought)


def assigned(documents: DataFrame, shards: int = 8, seed: int = 20240229, path: str | None = None) -> DataFrame:
    """Shard and slot of every document by its doc_id, with size and checksum of its text (null: empty).

    The whole documents are dealt and written as shards to path (by default a new
    folder in the shared one); size and checksum are those of the texts read back.
    """
    path = path or new_folder(documents.sparkSession, "shards")
    dealt = shuffled(documents.withColumn("doc_id", F.col("doc_id").cast("long")), F.col("doc_id"), shards, seed)
    write_shards(dealt, path)
    back = documents.sparkSession.read.schema(dealt.schema).parquet(path)
    text = F.coalesce("text", F.lit(""))
    return back.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(dealt: DataFrame, path: str) -> None:
    """A folder for each shard, its rows by slot within every file."""
    dealt.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
