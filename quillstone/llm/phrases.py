"""Removal of passages that earlier documents hold, with sharded phrase automata.

A window is ``WINDOW`` consecutive words of one document.  Documents are sorted
by doc_id into ranges, and each range is cut into shards of about
``SHARD_BYTES``, so an earlier shard holds no larger id.

1. Confirm.  Each shard sends shortened hashes of its different windows, sorted
   and delta-coded, to groups of the hash range.  A group tells the first shard
   that holds a hash which later shards hold it too.  Shortened hashes can name
   too many windows, never too few.
2. Compile.  The first holder cuts the confirmed windows of each later shard into
   passages (runs of windows, as words, with the smallest doc_id that holds them)
   and sends them there.  A shard's Aho-Corasick automaton is made of the phrases
   of the passages that it was sent and of those that recur inside it; a passage is
   sent only where it can occur.  Its phrases are the consecutive blocks of
   ``BLOCK`` words: ``WINDOW`` words of it hold a whole block wherever they begin.
3. Stream.  Every document passes through its shard's automaton.  At each
   occurrence of a phrase whose holder has a smaller doc_id, the words before and
   after it are compared with the passage; ``WINDOW`` equal words or more are
   removed.  What is removed follows from these matches alone.

An automaton is bounded by its shard.  No task sees more than one shard's texts,
one hash range or one range of the sort.  Words are compared by 64-bit hashes.
Step 1 sends a row for each shard and hash range, so both grow together: for
inputs of many terabytes give ``shard_bytes`` and ``range_bytes`` that executors
of that cluster can hold (a task needs about 60 bytes for each byte of a shard).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrowtext import Powers, flat, joined, span_hashes, windows, word_spans

WINDOW = 13

#: Words of a phrase; two blocks less a word are no longer than a window.
BLOCK = 7
SHARD_BYTES = 2 << 20
RANGE_BYTES = 16 << 20

#: Bytes of one range of the sort, and the most ranges.
SORT_BYTES = 16 << 20
SORTS = 20_000

#: Bits of a window hash beyond those that number all windows; so few different windows share a shortened hash.
SPARE_BITS = 10

#: Shards that one row with a passage names at most; longer lists take several rows, so that they spread.
TAKERS = 256

#: Occurrences that are compared with their passages at once.
COMPARED = 1 << 20

#: Characters that stand for words; surrogates are no characters.
LETTERS = 0x110000 - 0x800 - 1


#: Grown once in every task.
_POWERS = Powers()


def _words(column: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, off = flat(column)
    starts, ends, first = word_spans(buf, off)
    return buf, starts, ends, first, span_hashes(buf, starts, ends, powers)


class _Shard:
    """The documents of one shard by doc_id, their words and windows."""

    def __init__(self, table: pa.Table, bits: int) -> None:
        self.table = table.combine_chunks().sort_by("doc_id")
        column = self.table["text"].combine_chunks() if self.table.num_rows else pa.array([], pa.string())
        self.powers = _POWERS
        self.buf, self.starts, self.ends, self.first, self.words = _words(column, self.powers)
        self.begin, self.row = windows(self.first, WINDOW)
        self.ids = self.table["doc_id"].to_numpy()
        # Different windows; sample is the first place of each, which has its smallest doc_id.
        self.hashes, self.sample, self.which = np.unique(span_hashes(self.words, self.begin, self.begin + WINDOW, self.powers), return_index=True, return_inverse=True)
        short = self.hashes >> np.uint64(64 - bits)
        new = np.ones(len(short), bool)
        new[1:] = short[1:] != short[:-1]
        self.short, self.group = short[new], np.append(np.flatnonzero(new), len(short))


def _ranges(short: np.ndarray, bits: int, range_bits: int) -> np.ndarray:
    """Where each of the 2**range_bits hash ranges begins among the sorted hashes, and the end."""
    edges = np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(bits - range_bits)
    return np.concatenate([[0], np.searchsorted(short, edges), [len(short)]]).astype(np.int64)


def _packed(hashes: np.ndarray) -> bytes:
    """The first of the sorted hashes in eight bytes, and the differences in as few as hold the largest; the first byte tells how many."""
    steps = np.diff(hashes)
    wide = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 1
    return bytes([wide]) + int(hashes[0]).to_bytes(8, "little") + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    rest = raw[9:].reshape(-1, raw[0])
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[0], steps[1:, : raw[0]] = raw[1:9], rest
    return np.cumsum(steps.view("<u8")[:, 0].astype(np.uint64), dtype=np.uint64)


def _asked(bits: int, range_bits: int):
    def ask(table: pa.Table) -> pa.Table:
        shard = _Shard(table, bits)
        cut = _ranges(shard.short, bits, range_bits)
        sent = np.flatnonzero(cut[1:] > cut[:-1])
        name = table["shard"][0].as_py()
        blobs = [_packed(shard.short[cut[r] : cut[r + 1]]) for r in sent]
        return pa.table({"range": pa.array(sent, pa.int32()), "shard": pa.array([name] * len(sent), pa.int64()), "hashes": pa.array(blobs, pa.binary())})

    return ask


def _answered(table: pa.Table) -> pa.Table:
    """For the first shard that holds a hash of this range: the hash's number among its own, and each later shard that holds it."""
    table = table.sort_by("shard")
    parts = [_unpacked(b) for b in table["hashes"].to_pylist()]
    every, names = np.concatenate(parts), table["shard"].to_numpy()
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    begins = np.cumsum([0, *[len(p) for p in parts]])
    order = np.argsort(every, kind="stable")  # shards stay in order
    new = np.ones(len(every), bool)
    new[1:] = every[order[1:]] != every[order[:-1]]
    giver = order[np.flatnonzero(new)][np.cumsum(new) - 1][~new]
    taker = owner[order[~new]]
    by = np.argsort(owner[giver], kind="stable")
    giver, taker = giver[by], taker[by]
    cut = np.flatnonzero(np.diff(owner[giver], prepend=-1))
    rows = []
    for a, b in zip(cut, np.append(cut, len(giver))[1:], strict=True):
        first = owner[giver[a]]
        rows.append((names[first], (giver[a:b] - begins[first]).astype("<i4").tobytes(), names[taker[a:b]].astype("<i8").tobytes()))
    shard, at, takers = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
    ranges = pa.array([table["range"][0].as_py()] * len(rows), pa.int32())
    return pa.table({"range": ranges, "shard": pa.array(shard, pa.int64()), "at": pa.array(at, pa.binary()), "takers": pa.array(takers, pa.binary())})


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every span, one span after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def _given(bits: int, range_bits: int):
    def give(table: pa.Table, orders: pa.Table) -> pa.Table:
        nothing = pa.table({"holder": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "takers": pa.array([], pa.list_(pa.int64()))})
        if not orders.num_rows or not table.num_rows:
            return nothing
        shard = _Shard(table, bits)
        edges = _ranges(shard.short, bits, range_bits)
        at = np.concatenate([edges[r] + np.frombuffer(b, "<i4") for r, b in zip(orders["range"].to_pylist(), orders["at"].to_pylist(), strict=True)])
        taker = np.concatenate([np.frombuffer(b, "<i8") for b in orders["takers"].to_pylist()])
        many = shard.group[at + 1] - shard.group[at]
        place, taker = shard.sample[_spans(shard.group[at], many)], np.repeat(taker, many)
        order = np.lexsort((place, taker))
        place, taker = place[order], taker[order]
        # Passages: windows of one document that follow each other.
        head = np.ones(len(place), bool)
        head[1:] = (taker[1:] != taker[:-1]) | (place[1:] != place[:-1] + 1) | (shard.row[place[1:]] != shard.row[place[:-1]])
        at = np.flatnonzero(head)
        begin, size, taker = place[at], np.diff(np.append(at, len(place))), taker[at]
        order = np.lexsort((taker, size, begin))
        begin, size, taker = begin[order], size[order], taker[order]
        new = np.ones(len(begin), bool)
        new[1:] = (begin[1:] != begin[:-1]) | (size[1:] != size[:-1])
        since = np.arange(len(begin)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        cut = np.flatnonzero(since % TAKERS == 0)
        begin, size = begin[cut], size[cut] + WINDOW - 1
        words = _spans(shard.begin[begin], size)
        out, starts, ends = joined(shard.buf, shard.starts[words], shard.ends[words])
        last = np.cumsum(size)
        data, lead, stop = out.tobytes(), starts[last - size].tolist(), ends[last - 1].tolist()
        texts = pa.array([data[a:b] for a, b in zip(lead, stop, strict=True)], pa.binary()).cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(taker)), pa.int32()), pa.array(taker, pa.int64()))
        return pa.table({"holder": pa.array(shard.ids[shard.row[begin]], pa.int64()), "text": texts, "takers": lists})

    return give


class _Letters:
    """Words as characters; two characters for each if there are too many words."""

    def __init__(self, words: np.ndarray) -> None:
        names, numbers = np.unique(words, return_inverse=True)
        self.wide = 1 if len(names) <= LETTERS else 2
        digits = numbers if self.wide == 1 else np.stack([numbers // LETTERS, numbers % LETTERS], axis=1).ravel()
        self.text = np.where(digits < 0xD7FF, digits + 1, digits + 0x801).astype("<u4").tobytes().decode("utf-32-le")

    def of(self, begin: int, end: int) -> str:
        return self.text[self.wide * begin : self.wide * end]

    def met(self, automaton: ahocorasick.Automaton, end: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and values of the phrases that stand in the first ``end`` words."""
        found = np.array([x for pair in automaton.iter(self.of(0, end)) for x in pair], np.int64).reshape(-1, 2)
        found = found[(found[:, 0] + 1) % self.wide == 0]
        return (found[:, 0] + 1) // self.wide - BLOCK, found[:, 1]


def _automaton(letters: _Letters, begins: np.ndarray) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for i, begin in enumerate(begins.tolist()):
        automaton.add_word(letters.of(begin, begin + BLOCK), i)
    automaton.make_automaton()
    return automaton


def _runs(place: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of every run of sorted windows that follow each other in one row."""
    head = np.ones(len(place), bool)
    head[1:] = (place[1:] != place[:-1] + 1) | (row[place[1:]] != row[place[:-1]])
    at = np.flatnonzero(head)
    return place[at], np.diff(np.append(at, len(place)))


def _extent(words: np.ndarray, x: np.ndarray, y: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from x and y on are equal, in one direction and at most room."""
    out, going = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for k in range(WINDOW - BLOCK):
        going &= room > k
        going[going] = words[x[going] + step * k] == words[y[going] + step * k]
        out += going
    return out


def _removed(shard: _Shard, passages: pa.Table) -> np.ndarray:
    """For each word of the shard, whether an occurrence of a passage of a smaller doc_id covers it."""
    edge = np.zeros(len(shard.words) + 1, np.int64)
    _, _, _, first, sent = _words(passages["text"].combine_chunks() if passages.num_rows else pa.array([], pa.string()), shard.powers)
    # Passages that recur inside the shard: some place of their windows has a larger doc_id than the first.
    least = shard.ids[shard.row[shard.sample]]
    again = np.zeros(len(shard.hashes), bool)
    again[shard.which[shard.ids[shard.row] > least[shard.which]]] = True
    own, n_windows = _runs(np.sort(shard.sample[again]), shard.row)
    words = np.concatenate([shard.words, sent])
    begin = np.concatenate([shard.begin[own], first[:-1] + len(shard.words)])
    size = np.concatenate([n_windows + WINDOW - 1, np.diff(first)])
    holder = np.concatenate([shard.ids[shard.row[own]], passages["holder"].to_numpy()])
    # The blocks of every passage; equal blocks are one phrase with several places.
    n_blocks = size // BLOCK
    passage = np.repeat(np.arange(len(size)), n_blocks)
    place = begin[passage] + BLOCK * _spans(np.zeros(len(size), np.int64), n_blocks)
    if not len(place):
        return edge[:-1] > 0
    _, phrase = np.unique(span_hashes(words, place, place + BLOCK, shard.powers), return_inverse=True)
    order = np.argsort(phrase, kind="stable")
    place, passage = place[order], passage[order]
    lead = np.append(np.flatnonzero(np.diff(phrase[order], prepend=-1)), len(order))
    letters = _Letters(words)
    at, met = letters.met(_automaton(letters, place[lead[:-1]]), len(shard.words))
    row = np.searchsorted(shard.first, at, "right") - 1
    whole = at + BLOCK <= shard.first[row + 1]  # phrases don't cross documents
    at, met, row = at[whole], met[whole], row[whole]
    many = lead[met + 1] - lead[met]
    done = np.concatenate([[0], np.cumsum(many)])
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(done, done[a] + COMPARED, "right")) - 1)
        each = _spans(lead[met[a:b]], many[a:b])
        x, r, y, p = np.repeat(at[a:b], many[a:b]), np.repeat(row[a:b], many[a:b]), place[each], passage[each]
        late = holder[p] < shard.ids[r]
        x, r, y, p = x[late], r[late], y[late], p[late]
        before = _extent(words, x - 1, y - 1, np.minimum(x - shard.first[r], y - begin[p]), -1)
        after = _extent(words, x + BLOCK, y + BLOCK, np.minimum(shard.first[r + 1] - x, begin[p] + size[p] - y) - BLOCK, 1)
        long = before + BLOCK + after >= WINDOW
        edge += np.bincount((x - before)[long], minlength=len(edge)) - np.bincount((x + BLOCK + after)[long], minlength=len(edge))
        a = b
    return np.cumsum(edge)[:-1] > 0


def _cut(bits: int):
    def cut(table: pa.Table, passages: pa.Table) -> pa.Table:
        shard = _Shard(table, bits)
        gone = _removed(shard, passages)
        kept = ~gone
        out, starts, ends = joined(shard.buf, shard.starts[kept], shard.ends[kept])
        sums = np.concatenate([[0], np.cumsum(kept)])[shard.first]
        data, n = out.tobytes(), np.diff(shard.first)
        edge = np.append(starts, len(data))
        texts = [data[edge[a] : max(edge[a], edge[b] - 1)] for a, b in zip(sums[:-1].tolist(), sums[1:].tolist(), strict=True)]
        return pa.table({"doc_id": shard.table["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.diff(sums), pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    return cut


def _edges(known: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of (doc_id, hash of the text) of about equal numbers of rows begin: ranges - 1 pairs at most, sorted."""
    if ranges == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("place")
    keys = known.select(place).repartitionByRange(ranges, "place")
    first = keys.groupBy(F.spark_partition_id().alias("range")).agg(F.min("place").alias("place")).select("place.*").toArrow()
    ids, hashes = (first[c].to_numpy() for c in ("doc_id", "hash"))
    order = np.lexsort((hashes, ids))[1:]
    return ids[order], hashes[order]


def _found(ids: np.ndarray, hashes: np.ndarray, doc_id: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """The range of every (doc_id, digest), given where the ranges after the first begin."""
    low, high = np.searchsorted(ids, doc_id, "left"), np.searchsorted(ids, doc_id, "right")
    out = low.copy()
    for at in np.unique(low[low < high]):  # a doc_id at which ranges begin
        tied = np.flatnonzero((low == at) & (low < high))
        out[tied] = at + np.searchsorted(hashes[at : high[tied[0]]], digest[tied], "right")
    return out


def _dealt(known: DataFrame, total: int, shard_bytes: int) -> DataFrame:
    """(doc_id, text, shard): shards of about shard_bytes, numbered in the order of doc_id; one document is never cut.

    The edges of the ranges are taken once, and a shard's rows follow from them and the
    rows alone, so every evaluation of this frame deals the same shards.
    """
    ids, hashes = _edges(known, max(1, min(SORTS, -(-total // SORT_BYTES))))

    @F.pandas_udf("int")
    def part(doc_id: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series(_found(ids, hashes, doc_id.to_numpy(), digest.to_numpy()).astype(np.int32))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passed = -1, 0
        for batch in batches:
            parts, (_, off) = batch.column(2).to_numpy(), flat(batch.column(1))
            before = off[:-1] + passed
            heads = np.flatnonzero(np.diff(parts, prepend=now))  # bytes count anew in each range
            base = np.zeros(len(parts), np.int64)
            base[heads] = before[heads]
            before -= np.maximum.accumulate(base) if len(base) else base
            shard = (parts.astype(np.int64) << 32) + before // shard_bytes
            if len(parts):
                now, passed = parts[-1], int(before[-1] + off[-1] - off[-2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard, pa.int64())], names=["doc_id", "text", "shard"])

    digest = F.xxhash64("text")  # so that one doc_id with very many texts is split
    dealt = known.withColumn("part", part("doc_id", digest) if len(ids) else F.lit(0))
    return dealt.repartition("part").sortWithinPartitions("part", "doc_id", digest).mapInArrow(deal, "doc_id long, text string, shard long")


def without_repeats(documents: DataFrame, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the kept words of every document, one space between them.

    Null and empty texts have no words; a very long text is a shard of its own.
    Rows with a null doc_id have no order: nothing is removed from them or
    because of them.  Rows of one doc_id don't remove from each other, and
    repeated rows stay.  Other columns are ignored; an empty table gives an
    empty result.
    """
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = narrow.where("doc_id is not null")
    total = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(64, max(32, int(total).bit_length() + SPARE_BITS))
    range_bits = max(0, (-(-total // range_bytes) - 1).bit_length())
    placed = _dealt(known, total, shard_bytes)
    asked = placed.groupBy("shard").applyInArrow(_asked(bits, range_bits), "range int, shard long, hashes binary")
    orders = asked.groupBy("range").applyInArrow(_answered, "range int, shard long, at binary, takers binary")
    passages = placed.groupBy("shard").cogroup(orders.groupBy("shard")).applyInArrow(_given(bits, range_bits), "holder long, text string, takers array<long>")
    sent = passages.repartition("text", "takers").select("holder", "text", F.explode("takers").alias("shard"))
    cut = placed.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(_cut(bits), "doc_id long, n_words long, n_removed long, text string")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    free = narrow.where("doc_id is null").select("doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(words, " ").alias("text"))
    return cut.unionByName(free)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM v) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM late, (SELECT unnest(range(0, 13)) AS k)
), x AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d
), k AS (
  SELECT x.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n, string_agg(word, ' ' ORDER BY x.i) FILTER (gone.i IS NULL) AS kept
  FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
