"""SentencePiece BPE encoding with seeded merge-dropout, and exact decoding.

The agenda of a text holds the merges of adjacent symbols that the vocabulary
knows; the best score goes first, the leftmost of equal ones.  Each candidate is
skipped if its keyed hash falls below ``dropout``.  The key is the seed, the
document and the word's place in it, the place in the word and the merged piece,
so every occurrence of a word is drawn for itself while a retried task repeats
itself.

No piece may join letters to a following space or cross a line end (the vocabulary
is checked for it), so the agenda runs word by word.  A slice of texts is encoded at once: all candidates that a
word can ever have are drawn for each occurrence, occurrences with equal words
and equal sets of skipped candidates are one row of a matrix, and all rows take
their next merge together.  Very long words take a heap instead, one by one.

Encoding is the library's (a leading dummy space, spaces as U+2581, byte pieces
for unknown characters), but U+2581 itself is written as bytes, so that decoding
gives back every text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrowtext import Powers, mixed, slices, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20240229

#: Words up to this many characters are rows of the matrix.
LONG = 64

SLICE_BYTES = 1 << 19

#: Words whose candidates are drawn at once.
DRAWN_WORDS = 50_000

_NONE = np.int32(2**31 - 1)
_SPACE = 0x2581


class Vocabulary:
    """Pieces and the merges that make them, as arrays that are sent to the tasks."""

    def __init__(self, model: bytes) -> None:
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = own.get_piece_size()
        names = [own.id_to_piece(i) for i in range(self.size)]
        usable = [not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i)) for i in range(self.size)]
        ids = {name: i for i, name in enumerate(names) if usable[i]}
        mark = chr(_SPACE)
        if joins := [name for name in ids if mark in name.lstrip(mark) or "\n" in name.rstrip("\n")]:
            raise ValueError(f"pieces that join words can't be encoded word by word: {joins[:5]}")
        if mark not in ids or min(own.piece_to_id(f"<0x{b:02X}>") for b in range(256)) == own.unk_id():
            raise ValueError("the model needs a space piece and byte pieces")
        self.byte_ids = np.array([own.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        #: The smaller, the earlier a piece is merged; equal scores share one.
        self.order = np.unique([-own.get_score(i) for i in range(self.size)], return_inverse=True)[1].astype(np.int32)
        self.longest = max(len(name) for name in ids)
        self.letters = {ord(name): i for name, i in ids.items() if len(name) == 1}
        found = {}
        for name, i in ids.items():
            for cut in range(1, len(name)):
                a, b = ids.get(name[:cut]), ids.get(name[cut:])
                if a is not None and b is not None:
                    found[a * self.size + b] = i
        self.keys = np.array(sorted(found), np.int64)
        self.merged = np.array([found[k] for k in self.keys.tolist()], np.int32)
        spelled = [name.replace(chr(_SPACE), " ").encode() if usable[i] else b"" for i, name in enumerate(names)]
        for b in range(256):
            spelled[self.byte_ids[b]] = bytes([b])
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelling_off = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])


class Agenda:
    """Merge tables of one task."""

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int) -> None:
        self.v, self.seed = vocabulary, np.uint64(seed)
        self.limit = int(dropout * 2**32)
        self.letter = np.arange(0x110000, dtype=np.int32) + vocabulary.size  # unknown: size + code point
        for point, piece in vocabulary.letters.items():
            if point != _SPACE:
                self.letter[point] = piece
        self.letter[0x20] = vocabulary.letters[_SPACE]
        self.bits = 21
        slots = self._slot(vocabulary.keys)
        self.table, self.value = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for key, value, slot in zip(vocabulary.keys.tolist(), vocabulary.merged.tolist(), slots.tolist(), strict=True):
            while self.table[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.table[slot], self.value[slot] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b make, or -1."""
        size = self.v.size
        keys = np.where((a < size) & (b < size) & (a >= 0) & (b >= 0), a.astype(np.int64) * size + b, -2)
        slot = self._slot(keys)
        there = self.table[slot]
        out = np.where(there == keys, self.value[slot], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there >= 0) & (keys >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.table[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def skipped(self, words: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the keyed hash drops a candidate; words: keys of document and place."""
        return self._below(words ^ self._salt(place, piece))

    def _salt(self, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return self.seed ^ (place.astype(np.uint64) << np.uint64(32)) ^ (piece.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def _below(self, x: np.ndarray) -> np.ndarray:
        return (mixed(x) >> np.uint64(32)) < self.limit

    def reachable(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, place and piece of every candidate that the words can have, whatever is skipped; ordered by word."""
        word = np.repeat(np.arange(len(size)), size)
        start = np.cumsum(size) - size
        place = np.arange(len(word)) - start[word]
        symbol = self.letter[points[begin[word] + place]]
        left = size[word] - place
        pieces = [symbol, np.where(symbol < self.v.size, symbol, np.int32(-1))]  # by length; 0 is not used
        there = [np.zeros(0, np.int64), np.flatnonzero(pieces[1] >= 0)]
        for length in range(2, min(self.v.longest, int(size.max(initial=0))) + 1):
            found = np.full(len(word), -1, np.int32)
            for cut in range(1, length):
                at = there[cut]
                at = at[left[at] >= length]
                at = at[(pieces[length - cut][at + cut] >= 0) & (found[at] < 0)]
                if len(at):
                    found[at] = self.merge(pieces[cut][at], pieces[length - cut][at + cut])
            pieces.append(found)
            there.append(np.flatnonzero(found >= 0))
        at = np.concatenate(there[2:]) if len(there) > 2 else there[0]
        piece = np.concatenate([p[t] for p, t in zip(pieces[2:], there[2:], strict=True)]) if len(there) > 2 else np.zeros(0, np.int32)
        order = np.argsort(word[at], kind="stable")
        return word[at][order], place[at][order], piece[order]

    def groups(self, names: np.ndarray, keys: np.ndarray, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A number for each word occurrence; equal ones have one word and one set of skipped candidates."""
        if not self.limit:
            return names
        _, sample, which, times = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        again = (times > 1) & (size[sample] <= LONG)
        alone = ~again[which]
        out = names + mixed(keys)
        some = np.flatnonzero(~alone)
        names, keys, which, sample = names[some], keys[some], (np.cumsum(again) - 1)[which[some]], sample[again]
        word, place, piece = self.reachable(points, begin[sample], size[sample])
        salt = self._salt(place, piece)
        sign = mixed(salt + np.uint64(1))
        count = np.bincount(word, minlength=len(sample))
        first = np.cumsum(count) - count
        for lo in range(0, len(names), DRAWN_WORDS):
            own = which[lo : lo + DRAWN_WORDS]
            many = count[own]
            of = np.repeat(np.arange(len(own)), many)
            at = np.arange(len(of)) + np.repeat(first[own] - (np.cumsum(many) - many), many)
            hit = np.flatnonzero(self._below(np.repeat(keys[lo : lo + DRAWN_WORDS], many) ^ salt[at]))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sign[at[hit]])])
            skipped = np.bincount(of[hit], minlength=len(own))
            to = np.cumsum(skipped)
            names[lo : lo + DRAWN_WORDS] += total[to] - total[to - skipped]
        out[some] = names
        return mixed(out)

    def candidates(self, words: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and piece of each merge, _NONE if there is none or it is skipped."""
        piece = self.merge(a, b)
        good = np.flatnonzero(piece >= 0)
        order = np.full(len(piece), _NONE, np.int32)
        good = good[~self.skipped(words[good], place[good], piece[good])] if self.limit else good
        order[good] = self.v.order[piece[good]]
        return order, piece

    def matrix(self, words: np.ndarray, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (rows x length, -1 where merged away) of words of up to ``length`` characters."""
        n, length = len(words), int(size.max())
        column = np.arange(length)
        inside = column < size[:, None]
        symbol = np.where(inside, self.letter[points[np.minimum(begin[:, None] + column, len(points) - 1)]], np.int32(-1))
        after = np.where(column + 1 < size[:, None], column + 1, length).astype(np.int16)
        before = np.tile((column - 1).astype(np.int16), (n, 1))
        order, piece = np.full((n, length), _NONE, np.int32), np.zeros((n, length), np.int32)
        if length > 1:
            rows, cols = np.nonzero(inside[:, 1:])
            order[rows, cols], piece[rows, cols] = self.candidates(words[rows], cols, symbol[rows, cols], symbol[rows, cols + 1])
        live = np.arange(n)
        while len(live):
            at = order[live].argmin(axis=1)
            some = order[live, at] != _NONE
            live, at = live[some], at[some]
            if not len(live):
                break
            gone = after[live, at].astype(np.int64)
            symbol[live, at] = piece[live, at]
            symbol[live, gone] = -1
            order[live, gone] = _NONE
            follow = after[live, gone].astype(np.int64)
            after[live, at] = follow
            right = follow < length
            before[live[right], follow[right]] = at[right]
            order[live, at] = _NONE
            r, c, f = live[right], at[right], follow[right]
            order[r, c], piece[r, c] = self.candidates(words[r], c, symbol[r, c], symbol[r, f])
            left = before[live, at] >= 0
            r, c = live[left], at[left]
            p = before[r, c].astype(np.int64)
            order[r, p], piece[r, p] = self.candidates(words[r], p, symbol[r, p], symbol[r, c])
        return symbol, symbol >= 0

    def heap(self, word: np.uint64, points: np.ndarray) -> np.ndarray:
        """The symbols of one long word."""
        symbol = self.letter[points].tolist()
        after, before = [*range(1, len(symbol) + 1)], [*range(-1, len(symbol) - 1)]
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(lefts: list[int]) -> None:
            at = np.array(lefts, np.int64)
            a, b = np.array([symbol[i] for i in lefts], np.int64), np.array([symbol[after[i]] for i in lefts], np.int64)
            order, piece = self.candidates(np.full(len(at), word), at, a, b)
            for i, o, p in zip(lefts, order.tolist(), piece.tolist(), strict=True):
                if o != _NONE:
                    heapq.heappush(queue, (o, i, symbol[i], symbol[after[i]], p))

        offer([*range(len(symbol) - 1)])
        while queue:
            _, i, a, b, p = heapq.heappop(queue)
            j = after[i] if symbol[i] == a else len(symbol)
            if j >= len(symbol) or symbol[j] != b:
                continue
            symbol[i], symbol[j] = p, -1
            after[i] = after[j]
            if after[i] < len(symbol):
                before[after[i]] = i
            offer([x for x in (before[i], i) if x >= 0 and after[x] < len(symbol)])
        return np.array([s for s in symbol if s >= 0], np.int32)

    def words(self, names: np.ndarray, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after another, and how many each has."""
        count = np.zeros(len(names), np.int64)
        parts, of = [], []
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            top = int(size[order[at]])
            if top > LONG:
                one = order[at]
                symbols = self.heap(names[one], points[begin[one] : begin[one] + size[one]])
                parts.append(symbols)
                of.append(np.full(len(symbols), one))
                at += 1
                continue
            to = int(np.searchsorted(size[order], min(LONG, top + max(1, top // 4)), "right"))
            to = min(to, at + 50_000)
            rows = order[at:to]
            symbol, kept = self.matrix(names[rows], points, begin[rows], size[rows])
            parts.append(symbol[kept])
            of.append(np.repeat(rows, kept.sum(1)))
            at = to
        symbols, of_word = (np.concatenate(parts), np.concatenate(of)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        symbols = symbols[np.argsort(of_word, kind="stable")]
        return self._as_bytes(symbols, np.bincount(of_word, minlength=len(names)))

    def _as_bytes(self, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become byte pieces."""
        unknown = np.flatnonzero(symbols >= self.v.size)
        if not len(unknown):
            return symbols, count
        coded = [chr(p).encode() for p in (symbols[unknown] - self.v.size).tolist()]
        more = np.ones(len(symbols), np.int64)
        more[unknown] = [len(c) for c in coded]
        word = np.repeat(np.arange(len(count)), count)
        out = np.repeat(symbols, more)
        start = np.cumsum(more) - more
        size = more[unknown]
        at = np.repeat(start[unknown] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[at] = self.v.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        return out, np.bincount(word, weights=more, minlength=len(count)).astype(np.int64)

    def encode(self, buf: np.ndarray, off: np.ndarray, keys: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the offsets of the rows; keys: a number of each row."""
        filled = np.flatnonzero(np.diff(off) > 0)
        buf = np.insert(buf, off[filled], 0x20)  # the dummy space
        off = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        space, line = buf == 0x20, buf == 0x0A
        start = space.copy()
        start[1:] &= ~space[:-1]
        start |= line
        start[1:] |= line[:-1]
        start[off[:-1][filled]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(buf))
        first = np.searchsorted(starts, off)
        names = span_hashes(buf, starts, ends, powers)
        row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        place = np.arange(len(starts)) - first[:-1][row]
        drawn = mixed(keys.astype(np.uint64)[row] ^ mixed(place.astype(np.uint64) ^ self.seed))
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        index = np.cumsum(np.concatenate([[0], (buf & 0xC0) != 0x80]))
        at, long = index[starts], index[ends] - index[starts]
        _, sample, which = np.unique(self.groups(names, drawn, points, at, long), return_index=True, return_inverse=True)
        symbols, count = self.words(drawn[sample], points, at[sample], long[sample])
        begin = np.cumsum(count) - count
        size = count[which]
        total = np.cumsum(size)
        at = np.arange(int(total[-1])) + np.repeat(begin[which] - (total - size), size)
        return symbols[at], np.concatenate([[0], total])[first]


def decode(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and their offsets; the dummy space of each row is left out."""
    size = np.diff(v.spelling_off)[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(int(total[-1])) + np.repeat(v.spelling_off[:-1][ids] - total[:-1], size)
    buf, edge = v.spelling[at], total[off]
    filled = edge[:-1] < edge[1:]
    return np.delete(buf, edge[:-1][filled]), edge - np.concatenate([[0], np.cumsum(filled)])


def _vocabulary(model: str) -> Vocabulary:
    with open(model, "rb") as file:
        return Vocabulary(file.read())


def encoded(documents: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless) of every whole text.

    lossless: decoding ids gave back the text's bytes.  Null and empty texts
    have no ids; a very long text is encoded whole, an empty table gives an empty
    result.  The draw depends on doc_id and place, so repeated rows are
    equal; a null doc_id draws as 0.  Other columns are ignored.  The model file
    is read by the driver only.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast(vars(_vocabulary(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = SimpleNamespace(**vocabulary.value)
        agenda, powers = Agenda(v, dropout, seed), Powers()
        for batch, buf, off in slices(batches, limit=SLICE_BYTES):
            keys = np.asarray(batch.column(0).fill_null(0))
            ids, edge = agenda.encode(buf, off, keys, powers)
            back, back_off = decode(v, ids, edge)
            same = np.array_equal(back, buf) and np.array_equal(back_off, off)
            good = [True] * batch.num_rows if same else [np.array_equal(back[back_off[i] : back_off[i + 1]], buf[off[i] : off[i + 1]]) for i in range(batch.num_rows)]
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(edge), pa.int64()), pa.array(good, pa.bool_())], names=["doc_id", "ids", "n_pieces", "lossless"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decoded(encodings: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    vocabulary = encodings.sparkSession.sparkContext.broadcast(vars(_vocabulary(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = SimpleNamespace(**vocabulary.value)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            buf, edge = decode(v, np.array([i for x in lists for i in x], np.int64), off)
            texts = [buf[a:b].tobytes().decode() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encodings.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")
