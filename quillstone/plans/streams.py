"""Registered streaming queries, with SQL for what they give once all files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.streaming import feeds


def stream_trace_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.drained(feeds.trace_windows(feeds.stream(spark, sf_dir, "events")), "complete", "traces")


def stream_ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.drained(feeds.first_ingested(feeds.stream(spark, sf_dir, "documents")), "append", "ingest")


QUERIES = {"stream_trace_windows": stream_trace_windows, "stream_ingest_dedupe": stream_ingest_dedupe}

ORACLE_SQL = {
    "stream_trace_windows": """SELECT event_type, strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2""",
    "stream_ingest_dedupe": "SELECT DISTINCT sha256(text) AS sha256 FROM documents",
}
