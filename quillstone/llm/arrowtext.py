"""Whole texts of Arrow batches as flat byte arrays, and their words.

Tasks work on slices of a batch of about ``limit`` bytes, so memory does not
depend on the batch size; a longer single text is its own slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Space and \t \n \v \f \r separate words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multiplier of the polynomial hashes (mod 2**64).
BASE = 0x9E3779B97F4A7C15


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not (wide or pa.types.is_string(column.type)):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with the bytes and offsets of one text column."""
    for batch in batches:
        buf, off = flat(batch.column(batch.schema.get_field_index(name)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def word_spans(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (one more at the end)."""
    ink = ~gap[buf]
    head = off[:-1][off[:-1] < off[1:]]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    start[head] = ink[head]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    last = head[1:] - 1
    end[last] = ink[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and their spans there."""
    size = ends - starts
    to = np.cumsum(size + 1)
    new = to - size - 1
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    shift = np.repeat(starts - new, size)
    at = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    out[at] = buf[at + shift]
    return out, new, new + size


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of BASE and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n + n // 4
            one = np.ones(size, np.uint64)
            up, down = one.copy(), one.copy()
            up[1:], down[1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each span of the values (bytes, or hashes of words), wherever it stands."""
    up, down = powers.to(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every run of ``size`` words inside one row, and the row of each; first as from word_spans."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row], row
