"""Quality classifier: regularised quadratic discriminant over document statistics.

Shares of a text are turned by arcsin of the square root and counts by the
logarithm, which makes them closer to normal.  The sums and products of the
statistics over all labelled rows are added up by Spark.  Each class gets a mean
and a covariance shrunk towards the pooled one and towards its diagonal; their
Cholesky factors are computed once and sent to the tasks.  The score is the
logistic of the difference of the two log densities (Mahalanobis distance and
log determinant) and the log odds of the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrowtext import Powers, slices
from quillstone.llm.lineage import written
from quillstone.llm.rules import Texts, most_frequent

#: Shrinkage towards the pooled covariance, and towards its mean variance.
TO_POOLED = 0.1
TO_SPHERE = 0.02

#: Log-density differences are divided by this, as the features are not independent of each other given normality.
TEMPERATURE = 2.0

NAMES = ("words", "word_length", "symbols", "capitals", "exclaimed", "barred", "repeated_lines", "repeated_words", "top_word", "distinct", "letters", "stops", "line_words", "doubled", "short_words", "capitalised")


def statistics(t: Texts) -> np.ndarray:
    """Transformed statistics of every row, finite for empty texts too."""
    n = np.maximum(t.n_words, 1)
    size = np.maximum(np.diff(t.off), 1)
    upper, lower = t.total((t.buf >= 65) & (t.buf <= 90)), t.total((t.buf >= 97) & (t.buf <= 122))
    letter = ((t.buf >= 65) & (t.buf <= 90)) | ((t.buf >= 97) & (t.buf <= 122)) | (t.buf >= 128)
    ends, heads = t.buf[t.ends - 1], t.buf[t.starts]
    new_row = np.zeros(len(t.starts), bool)
    new_row[t.first[:-1][t.n_words > 0]] = True
    doubled = np.zeros(len(t.starts), bool)
    doubled[1:] = (t.hashes[1:] == t.hashes[:-1]) & ~new_row[1:]
    top, distinct = most_frequent(t)
    share = lambda x, of: np.arcsin(np.sqrt(np.clip(x / of, 0, 1)))
    columns = [
        np.log1p(t.n_words),
        np.log1p(t.word_chars / n),
        share(t.n_symbols, np.maximum(t.word_chars, 1)),
        share(upper, np.maximum(upper + lower, 1)),
        share(t.words(ends == 33), n),
        share(t.words(heads == 124), n),
        share(t.lines[1], np.maximum(t.lines[0], 1)),
        share(t.n_repeat_words, n),
        share(top, n),
        np.log1p(distinct) - np.log1p(t.n_words),
        share(t.total(letter), size),
        share(t.words((ends == 46) | (ends == 44)), n),
        np.log1p(t.n_words / np.maximum(t.lines[0], 1)),
        share(t.words(doubled), n),
        share(t.words(t.ends - t.starts <= 3), n),
        share(t.words((heads >= 65) & (heads <= 90)), n),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, features) of every whole text; null texts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, buf, off in slices(batches):
            x = statistics(Texts(buf, off, powers))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "features"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, features array<double>")


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of both classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        log = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = (x - mean) @ factor.T
            log.append(np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0] + self.offset) / TEMPERATURE, -500, 500)))


def moments(labelled: DataFrame) -> dict[int, np.ndarray]:
    """For labels 0 and 1 the sums of (1, x) (1, x)' over the rows (features, y)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(NAMES) + 1, len(NAMES) + 1))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, len(NAMES))
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            y = np.asarray(batch.column(1))
            for k in (0, 1):
                sums[k] += x[y == k].T @ x[y == k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel())], names=["at", "value"])

    added = labelled.select("features", "y").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros((2, len(NAMES) + 1, len(NAMES) + 1))
    for r in added.collect():  # a row for each entry of two small matrices
        out.ravel()[r["at"]] = r["value"]
    return {0: out[0], 1: out[1]}


def fitted(sums: dict[int, np.ndarray]) -> Discriminant | float:
    """The discriminant of the moments of labelled rows; the share of label 1 if a class has fewer than two."""
    n = [sums[k][0, 0] for k in (0, 1)]
    if min(n) < 2:
        return n[1] / sum(n) if sum(n) else 0.5
    means = [sums[k][0, 1:] / n[k] for k in (0, 1)]
    scatter = [sums[k][1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / sum(n)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-4))
    factors = []
    for k in (0, 1):
        own = n[k] / (n[k] + 2 * len(NAMES))  # few rows lean on the pooled covariance
        shrunk = (1 - TO_POOLED) * own * scatter[k] + (1 - (1 - TO_POOLED) * own) * pooled
        shrunk = (1 - TO_SPHERE) * shrunk + TO_SPHERE * scale
        factors.append(np.linalg.inv(np.linalg.cholesky(shrunk)))
    return Discriminant(means, factors, float(np.log(n[1] / n[0])))


def held_out(doc_id) -> F.col:
    """Rows that no fit may read."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def scored(documents: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    labels: doc_id and the label, 0 or 1; null labels and ids and held-out rows
    are not read.  Null and empty texts are scored as texts without words, a very
    long text whole.  Repeated rows stay; a null doc_id is scored and not held out.
    An empty table gives an empty result.  Without labels of both classes every score is the share of label 1 (0.5 if
    there is none).  Other columns are ignored.
    """
    found = written(features(documents), "features")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(f"doc_id is not null and y in (0, 1)")
    usable = usable.where(~held_out(F.col("doc_id")))
    model = fitted(moments(found.join(usable, "doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(NAMES))
            score = model.score(x) if isinstance(model, Discriminant) else np.full(batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scores = found.mapInArrow(run, "doc_id long, score double")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
