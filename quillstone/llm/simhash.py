"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint maps to 32 coordinates, the bit counts of its two-bit
segments.  One differing bit moves one coordinate by one, so the Manhattan
distance of two embeddings is at most the Hamming distance of the fingerprints:
no linked pair is further apart than the limit.  With two halves of 16
coordinates and a limit of 3, one half of a linked pair is within distance 1
(or else they would differ by 4 at least).  The grid has unit cells over the
coordinates of a half.  A fingerprint stands in the cell of each half; one whose
half has an even bit count also visits the cells at distance one, whose counts
are odd, so each pair at distance one meets in exactly one of the two cells.
What meets is verified by the Hamming distance inside the join.

Only distinct fingerprints are joined; copies are attached afterwards, a very
common fingerprint in parts.  Pairs that meet in a cell grow with the square of the
distinct fingerprints in it (a half's cell holds about (3/8)**16 of random ones):
few up to some 10**8 of them, and more than the links beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrowtext import LOWER, joined, slices, word_spans
from quillstone.llm.graph import components
from quillstone.llm.lineage import written
from quillstone.llm.skew import attached, shuffled

LIMIT = 3
SHINGLE = 3
SEED = 42

#: Bytes of text that a task looks at at once.
SLICE_BYTES = 1 << 19


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch, raw, off in slices(batches, limit=SLICE_BYTES):
        starts, ends, first = word_spans(raw, off)
        text, starts, ends = joined(LOWER[raw], starts, ends)
        data, n = text.tobytes(), np.diff(first)
        count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        row = np.repeat(np.arange(len(n)), count)
        begin = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
        until = begin + np.minimum(n, SHINGLE)[row] - 1
        h = np.array([digest(data[a:b], SEED) for a, b in zip(starts[begin].tolist(), ends[until].tolist(), strict=True)], dtype=">u8")
        prints = np.zeros(len(n), np.int64)
        some = np.flatnonzero(count)
        if len(some):
            ones = np.add.reduceat(np.unpackbits(h.view(np.uint8)).reshape(-1, 64), (np.cumsum(count) - count)[some], axis=0, dtype=np.int32)
            prints[some] = np.packbits(2 * ones > count[some][:, None], axis=1).view(">i8")[:, 0]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "text_hash", "print"])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, print): the SimHash of every whole text as a signed long; no words (or null): 0."""
    text = F.coalesce(text, F.lit(""))
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(_fingerprinted, "doc_id long, text_hash long, print long")


def _counts(half: Column) -> Column:
    """16 bit counts of two-bit segments, packed two bits each."""
    ones = F.lit(0x55555555).cast("long")
    return half.bitwiseAND(ones) + F.shiftright(half, 1).bitwiseAND(ones)


def _around(cell: Column) -> Column:
    """The cells at Manhattan distance one."""
    def moved(i: int) -> list[Column]:
        at = F.shiftright(cell, 2 * i).bitwiseAND(F.lit(3))
        step = F.lit(1 << (2 * i)).cast("long")
        return [F.when(at < 2, cell + step), F.when(at > 0, cell - step)]

    return F.array_compact(F.array(*[c for i in range(16) for c in moved(i)]))


def links(prints: DataFrame) -> DataFrame:
    """(a, b) of the distinct longs in column print at Hamming distance 1 to LIMIT, a < b, each once."""
    low = F.col("print").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    halves = prints.select("print", F.explode(F.array(F.struct(F.lit(0).alias("half"), _counts(low).alias("cell")), F.struct(F.lit(1).alias("half"), _counts(F.shiftrightunsigned("print", 32)).alias("cell")))).alias("h")).select("print", "h.half", "h.cell")
    key = F.col("half").cast("long") * F.lit(1 << 32).cast("long")
    own = halves.select((key + F.col("cell")).alias("key"), F.col("print").alias("a"))
    even = F.bit_count(F.when(F.col("half") == 0, low).otherwise(F.shiftrightunsigned("print", 32))) % 2 == 0
    visits = F.when(even, F.concat(F.array("cell"), _around(F.col("cell")))).otherwise(F.array("cell"))
    visiting = halves.select(F.explode(visits).alias("cell"), "half", "print", F.col("cell").alias("home")).select((key + F.col("cell")).alias("key"), F.col("print").alias("b"), (F.col("cell") == F.col("home")).alias("home"))
    # In its own cell a pair is met from both sides, in a visited one from one side.
    met = own.join(shuffled(visiting), (own["key"] == visiting["key"]) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT) & ((F.col("a") < F.col("b")) | (~F.col("home") & (F.col("a") != F.col("b")))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _members(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, print, root, component_id): root is the smallest fingerprint that a row's reaches."""
    prints = written(fingerprints(documents, doc_id, text), "prints")
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"))
    roots = written(components(links(classes.select("print"))), "roots")
    # Only linked fingerprints have a root; the least id of each root's members names it.
    linked = roots.join(shuffled(classes), roots["node"] == classes["print"]).select("print", "root", "least")
    named = linked.join(shuffled(linked.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("print", "root", "component_id")
    ids = classes.join(shuffled(named), "print", "left").select("print", "members", F.coalesce("root", "print").alias("root"), F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return attached(prints, ids, ["print"], ["doc_id", "text_hash"], prints.count())


def clustered(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Null texts count as empty; documents without words share the fingerprint
    zero; a very long text is fingerprinted whole.  Repeated rows stay, one result each.  A null doc_id gets a
    fingerprint and links others, but is never the smallest id; a component of
    such rows alone has a null id.  Other columns are ignored.
    """
    return _members(documents, doc_id, text).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(documents: DataFrame) -> DataFrame:
    """The documents with one row of each near-duplicate component, all columns kept.

    The row of the smallest doc_id stays; of several rows with that id the one
    with the smallest text hash.  A row without doc_id stays only if its
    component has no row with one.
    """
    key = lambda c: (c.isNull().alias("no_id"), F.coalesce(c, F.lit(0)).alias("key"))
    rows = _members(documents).select("root", *key(F.col("doc_id")), "text_hash")
    best = rows.groupBy("root").agg(F.min(F.struct("no_id", "key", "text_hash")).alias("best")).select("best.*")
    row = F.struct(*[documents[c] for c in documents.columns])
    named = documents.select(row.alias("row"), *key(F.col("doc_id").cast("long")), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return named.join(best, ["no_id", "key", "text_hash"], "left_semi").dropDuplicates(["no_id", "key", "text_hash"]).select("row.*")
