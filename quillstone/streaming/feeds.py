"""Structured Streaming feeds: traces, rate limits and deduplicated ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.shared import new_folder


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def drained(result: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there now and read back what it wrote; in complete mode each batch replaces the last."""
    spark = result.sparkSession
    path = new_folder(spark, f"stream-{name}")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/rows")


def trace_windows(events: DataFrame, width: str = "6 hours") -> DataFrame:
    """Events of each type and window, late ones up to a day."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return grouped.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "cents")


def first_ingested(documents: DataFrame) -> DataFrame:
    """Each different text once, by its hash; state holds one hash for each text."""
    return documents.select(F.sha2("text", 256).alias("sha256")).dropDuplicates(["sha256"])
