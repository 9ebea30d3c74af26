"""Shards of repeated phrases follow from the rows, not from a reused exchange."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import phrases

HARD = {"spark.sql.exchange.reuse": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "3", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def hard(spark):
    before = {k: spark.conf.get(k, None) for k in HARD}
    for k, v in HARD.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_places():
    """The range of a (doc_id, digest) is that of the last edge that is not above it."""
    ids, hashes = np.array([3, 5, 5, 5, 9]), np.array([7, -4, 0, 6, 2])
    draw = np.random.default_rng(1)
    doc, digest = draw.integers(0, 12, 500), draw.integers(-6, 9, 500)
    want = [sum((i, h) <= (d, x) for i, h in zip(ids, hashes, strict=True)) for d, x in zip(doc, digest, strict=True)]
    assert phrases._found(ids, hashes, doc, digest).tolist() == want
    assert phrases._found(ids[:0], hashes[:0], doc, digest).tolist() == [0] * 500


def test_shards_are_the_same_every_time(hard, sf_dir, monkeypatch):
    monkeypatch.setattr(phrases, "SORT_BYTES", 20_000)
    docs = hard.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.unionByName(docs.where("doc_id % 50 = 0").crossJoin(hard.range(40)).select("doc_id", F.concat("text", F.col("id").cast("string")).alias("text")))  # ids with many texts
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    dealt = phrases._dealt(docs, total, 5000)
    first, second = ({(r.doc_id, r.text, r.shard) for r in dealt.collect()} for _ in range(2))
    assert first == second and len({s for *_, s in first}) > 20
    edges = {}
    for doc, _, shard in first:
        low, high = edges.get(shard, (doc, doc))
        edges[shard] = min(low, doc), max(high, doc)
    order = [edges[s] for s in sorted(edges)]
    assert all(a[1] <= b[0] for a, b in zip(order, order[1:], strict=False))


def test_rows_without_reuse(hard, sf_dir, monkeypatch):
    """Many ranges, small samples and no reuse give the rows of the plain run."""
    docs = hard.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(tuple, phrases.without_repeats(docs).collect()))
    monkeypatch.setattr(phrases, "SORT_BYTES", 20_000)
    assert sorted(map(tuple, phrases.without_repeats(docs, 5000, 4000).collect())) == want
