"""Quality rules as a short-circuit cascade.

Every rule is a whole-number predicate over one text.  The cost and the
rejection rate of each are measured on a sample of about ``SAMPLE`` documents,
taken by a hash, among those that pass the base rule and without what the base
rule has computed already; rules then run by rejections per second, and a text
that rules reject is not shown to later ones (see SPARSE).  A text is kept if no rule rejects it, so
the order changes the time and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrowtext import Powers, slices, span_hashes, windows, word_spans

#: Rows that the cost and selectivity estimate measures, about.
SAMPLE = 2000

WINDOW = 5

#: Texts are copied together again once fewer than this share of them is left; until then a rule sees the rejected ones too.
SPARSE = 0.8

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


class Texts:
    """Rows of one slice; what several rules need is computed once."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, powers: Powers) -> None:
        self.buf, self.off, self.powers = buf, off, powers
        self.starts, self.ends, self.first = word_spans(buf, off)
        self.n_words = np.diff(self.first)
        self._kept: dict[str, np.ndarray] = {}

    def once(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def total(self, flag: np.ndarray) -> np.ndarray:
        """Flagged bytes of each row."""
        sums = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return sums[self.off[1:]] - sums[self.off[:-1]]

    def words(self, flag: np.ndarray) -> np.ndarray:
        """Flagged words of each row."""
        sums = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    @property
    def hashes(self) -> np.ndarray:
        return self.once("hashes", lambda: span_hashes(self.buf, self.starts, self.ends, self.powers))

    @property
    def word_chars(self) -> np.ndarray:
        def make() -> np.ndarray:
            sums = np.zeros(len(self.buf) + 1, np.int64)
            np.cumsum((self.buf & 0xC0) != 0x80, out=sums[1:])
            each = np.zeros(len(self.starts) + 1, np.int64)
            np.cumsum(sums[self.ends] - sums[self.starts], out=each[1:])
            return each[self.first[1:]] - each[self.first[:-1]]

        return self.once("word_chars", make)

    @property
    def n_symbols(self) -> np.ndarray:
        return self.once("n_symbols", lambda: self.total(SYMBOL[self.buf]))

    @property
    def lines(self) -> np.ndarray:
        """Lines with a word, and those of them that equal an earlier one, by row."""
        def make() -> np.ndarray:
            cut = np.flatnonzero(self.buf == 10)
            starts = np.concatenate([self.off[:-1], cut + 1])
            row = np.concatenate([np.arange(len(self.off) - 1), np.searchsorted(self.off, cut, "right") - 1])
            order = np.lexsort((starts, row))
            starts, row = starts[order], row[order]
            ends = np.concatenate([starts[1:] - 1, self.off[-1:]])
            last = np.flatnonzero(np.diff(row))
            ends[last] = self.off[1:][row[last]]
            inked = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
            starts, ends, row = starts[inked], ends[inked], row[inked]
            named = span_hashes(self.buf, starts, ends, self.powers)
            order = np.lexsort((named, row))
            same = (row[order][1:] == row[order][:-1]) & (named[order][1:] == named[order][:-1])
            n = len(self.off) - 1
            return np.stack([np.bincount(row, minlength=n), np.bincount(row[order][1:][same], minlength=n)])

        return self.once("lines", make)

    @property
    def n_repeat_words(self) -> np.ndarray:
        def make() -> np.ndarray:
            begin, row = windows(self.first, WINDOW)
            if not len(begin):
                return np.zeros(len(self.n_words), np.int64)
            named = span_hashes(self.hashes, begin, begin + WINDOW, self.powers) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(named)
            same = named[order][1:] == named[order][:-1]
            twice = np.zeros(len(named), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(len(self.starts) + 1, np.int64)
            np.add.at(edge, begin[twice], 1)
            np.add.at(edge, begin[twice] + WINDOW, -1)
            return self.words(np.cumsum(edge)[:-1] > 0)

        return self.once("n_repeat_words", make)

    def only(self, rows: np.ndarray) -> Texts:
        """The chosen rows as a slice of their own."""
        size = np.diff(self.off)[rows]
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(off[-1]) + np.repeat(self.off[:-1][rows] - off[:-1], size)
        return Texts(self.buf[at], off, self.powers)


def most_frequent(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of the commonest word of each row, and the number of different words."""
    row = np.repeat(np.arange(len(t.n_words)), t.n_words)
    order = np.lexsort((t.hashes, row))
    new = np.ones(len(row), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (t.hashes[order][1:] != t.hashes[order][:-1])
    at = np.flatnonzero(new)
    most = np.zeros(len(t.n_words), np.int64)
    np.maximum.at(most, row[order][at], np.diff(np.append(at, len(row))))
    return most, np.bincount(row[order][at], minlength=len(most))


def _capitals(t: Texts) -> np.ndarray:
    upper = t.total((t.buf >= 65) & (t.buf <= 90))
    lower = t.total((t.buf >= 97) & (t.buf <= 122))
    return (upper + lower >= 20) & (upper > lower)


def _few_letters(t: Texts) -> np.ndarray:
    letter = ((t.buf >= 65) & (t.buf <= 90)) | ((t.buf >= 97) & (t.buf <= 122)) | (t.buf >= 128)
    sums = np.zeros(len(t.buf) + 1, np.int64)
    np.cumsum(letter, out=sums[1:])
    return 10 * t.words(sums[t.ends] > sums[t.starts]) < 6 * t.n_words


#: Each gives the rows that it rejects.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "symbols": lambda t: 10 * t.n_symbols > t.word_chars,
    "duplicate_lines": lambda t: 2 * t.lines[1] > t.lines[0],
    "word_length": lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words),
    "capitals": _capitals,
    "exclamations": lambda t: 10 * t.words(t.buf[t.ends - 1] == 33) > 3 * t.n_words,
    "few_letters": _few_letters,
    "one_word": lambda t: 10 * most_frequent(t)[0] > 3 * t.n_words,
}


def base_failed(t: Texts) -> np.ndarray:
    return (t.n_words < 10) | (100 * t.n_repeat_words > 20 * t.n_words)


def _narrow(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))


def measured(documents: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) over about ``sample`` rows, those that the base rule passes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        spent, rejected, seen = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for batch, buf, off in slices(batches):
            failed = base_failed(Texts(buf, off, powers))
            for i, (name, rule) in enumerate(RULES.items()):
                rows = Texts(buf, off, powers).only(~failed)
                base_failed(rows)  # what it computes is there already when rules run
                seen += len(rows.n_words) if i == 0 else 0
                began = time.perf_counter()
                rejected[name] += int(rule(rows).sum())
                spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(list(RULES)), pa.array([spent[k] for k in RULES], pa.float64()), pa.array([rejected[k] for k in RULES], pa.int64()), pa.array([seen] * len(RULES), pa.int64())], names=["rule", "seconds", "rejected", "seen"])

    share = min(1.0, sample / max(1, documents.count()))
    taken = _narrow(documents, doc_id, text).where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sums = taken.mapInArrow(run, "rule string, seconds double, rejected long, seen long").groupBy("rule").agg(F.sum("seconds"), F.sum("rejected") / F.greatest(F.sum("seen"), F.lit(1)))
    return [tuple(r) for r in sums.collect()]  # a row for each rule


def ordered(figures: list[tuple[str, float, float]]) -> list[str]:
    """Rules by rejections per second, most first; unmeasured ones last."""
    worth = {name: rejected / max(seconds, 1e-9) for name, seconds, rejected in figures}
    return sorted(RULES, key=lambda name: (-worth.get(name, -1.0), name))


def filtered(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Counts and verdict of every document.

    Null and empty texts have no words and fail; a very long text is judged
    whole.  Repeated rows stay, a null doc_id passes through, other columns are ignored, an empty table gives an
    empty result.
    """
    order = ordered(measured(documents, sample, doc_id, text))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, buf, off in slices(batches):
            t = Texts(buf, off, powers)
            failed = base_failed(t)
            by = np.full(batch.num_rows, None, object)
            by[failed] = "base"
            alive = ~failed
            shown, rest = np.arange(batch.num_rows), t
            for name in order:
                if not alive.any():
                    break
                if alive.sum() < SPARSE * len(shown):
                    rest, shown = rest.only(alive[shown]), np.flatnonzero(alive)
                out = shown[RULES[name](rest)]
                out = out[alive[out]]
                by[out], alive[out] = name, False
            columns = [batch.column(0), t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words, failed, by == None, pa.array(by, pa.string())]  # noqa: E711
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return _narrow(documents, doc_id, text).mapInArrow(run, schema)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), v AS (
  SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM v) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r
), top AS (
  SELECT r, max(c) AS most FROM (SELECT r, x, count(*) AS c FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x) GROUP BY r
), c AS (
  SELECT d.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^a-z]', '', 'g')) AS lo,
    len(list_filter(w, lambda x: suffix(x, '!'))) AS bang, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered, coalesce(most, 0) AS most
  FROM d LEFT JOIN l ON d.r = l.r LEFT JOIN rep ON d.r = rep.r LEFT JOIN top ON d.r = top.r
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR (up + lo >= 20 AND up > lo) OR 10 * bang > 3 * n_words OR 10 * lettered < 6 * n_words OR 10 * most > 3 * n_words) AS kept
FROM f
"""
