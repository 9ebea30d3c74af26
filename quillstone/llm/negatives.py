"""Hard negatives of anchors, with bounds of scores from segment summaries.

Every vector is stored with the mean and the deviation of its segments, at several
levels.  Over a segment of n components, a.b = n * mean(a) * mean(b) + a'.b' with the
centred parts a' and b', and |a'.b'| is at most the product of their lengths, the
deviations.  Summed over the segments this bounds a score from both sides; finer
segments bound it better.

Rows and anchors are dealt by hash into blocks with a bounded number of values, and
each block of rows meets each block of anchors in a task of its own.  The bounds of
a level drop pairs that can't be among the wanted ones; what the finest level leaves
is scored exactly.  A first pass finds each anchor's positives, the second the
negatives in the windows of their scores; each task sends the few best of its block,
and the best of those are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.lineage import written

#: Segments of a level, coarse to fine.
LEVELS = (4, 16)

#: Values (rows times components) of a block of rows and of a block of anchors.
ROW_VALUES = 1 << 19
ANCHOR_VALUES = 1 << 18

#: Anchors and rows that are bounded at once.
TILE = (128, 2048)

#: Part of the product of two lengths that covers the rounding of bounds.
SLACK = 1e-9

#: Share of pairs below which survivors are scored one by one.
SPARSE = 0.05

#: Whole numbers up to this are exact in doubles.
EXACT = float(1 << 53)

_NO_ID = np.iinfo(np.int64).max


def _segments(dim: int) -> list[tuple[int, int, np.ndarray]]:
    """(first summary, end, edges) of each level for vectors of dim components."""
    out, at = [], 0
    for n in (n for n in LEVELS if n < dim):
        out.append((at, at + n, np.linspace(0, dim, n + 1).astype(np.int64)))
        at += n
    return out


def _summed(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of every level, one row for each vector."""
    parts = [q[:, a:b] for _, _, edges in _segments(q.shape[1]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    means = [p.mean(axis=1) for p in parts]
    devs = [np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, means, strict=True)]
    return (np.stack(x, axis=1) if x else np.zeros((len(q), 0)) for x in (means, devs))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


NAMES = ["row", "vec_id", "label", "dim", "q", "means", "devs"]
PREPARED = "row long, vec_id long, label long, dim int, q array<double>, means array<double>, devs array<double>"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(3)
        dims = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
        for dim in np.unique(dims):
            at = pa.array(np.flatnonzero(dims == dim))
            q = np.floor(256.0 * vectors.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim))
            means, devs = _summed(q)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(np.full(len(at), dim, np.int32)), _lists(q), _lists(means), _lists(devs)], names=NAMES)


def summarised(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, dim, q, means, devs) of the rows of (vec_id, label, embedding) that take part, written."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = known.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    return written(known.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding").mapInArrow(_prepare, PREPARED), "summaries")


class _Vectors:
    """Rows of summarised() as arrays."""

    def __init__(self, table: pa.Table) -> None:
        self.dim = table["dim"][0].as_py()
        self.row, self.label = (table[c].to_numpy() for c in ("row", "label"))
        self.id = table["vec_id"].fill_null(_NO_ID).to_numpy()
        self.q, self.means, self.devs = (table[c].combine_chunks().flatten().to_numpy().reshape(len(self.row), -1) if self.dim else np.zeros((len(self.row), 0)) for c in ("q", "means", "devs"))
        self.norm = np.sqrt((self.q**2).sum(axis=1))

    def some(self, at: np.ndarray) -> _Vectors:
        out = object.__new__(_Vectors)
        out.dim = self.dim
        for name in ("row", "label", "id", "q", "means", "devs", "norm"):
            setattr(out, name, getattr(self, name)[at])
        return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, as whole numbers."""
    if a.size == 0 or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for u, v in zip(a, b, strict=True)], np.int64)


def survivors(a: _Vectors, b: _Vectors, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of which the score is from least[i] to most[i], and the scores.

    Each level's bounds drop pairs; the rest is scored exactly.
    """
    alive = np.ones((len(a.row), len(b.row)), bool)
    slack = a.norm[:, None] * (SLACK * b.norm)
    for lo, hi, edges in _segments(a.dim):
        middle = (a.means[:, lo:hi] * np.diff(edges)) @ b.means[:, lo:hi].T
        reach = a.devs[:, lo:hi] @ b.devs[:, lo:hi].T + slack
        alive &= (middle + reach >= least[:, None]) & (middle - reach <= most[:, None])
        if not alive.any():
            break
    i, j = np.nonzero(alive)
    small = len(i) == 0 or float(np.abs(a.q).max(initial=0)) * float(np.abs(b.q).max(initial=0)) * a.dim < EXACT
    if small and len(i) > SPARSE * alive.size:
        scores = (a.q @ b.q.T)[i, j].astype(np.int64)
    else:
        scores = _exact(a.q[i], b.q[j])
    right = (scores >= least[i]) & (scores <= most[i])
    return i[right], j[right], scores[right]


class _Best:
    """The k best (score, id, row) of every group so far: high scores first, then small ids, then rows."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.held = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        group, score, ident, row = (np.concatenate([h, x]) for h, x in zip(self.held, (group, score, ident, row), strict=True))
        order = np.lexsort((row, ident, -score, group))
        group = group[order]
        first = np.searchsorted(group, group)
        near = np.arange(len(group)) - first < self.k
        self.held = [group[near], *(x[order][near] for x in (score, ident, row))]

    def edges(self, otherwise: np.ndarray) -> np.ndarray:
        """The k-th score of every group that has k, else the given ones."""
        group, score = self.held[0], self.held[1]
        out = otherwise.copy()
        last = np.flatnonzero(np.arange(len(group)) - np.searchsorted(group, group) == self.k - 1)
        out[group[last]] = score[last]
        return out


def _tiles(n: int, size: int) -> Iterator[np.ndarray]:
    return (np.arange(x, min(n, x + size)) for x in range(0, n, size))


def _ids(ident: np.ndarray) -> pa.Array:
    return pa.array(ident, pa.int64(), mask=ident == _NO_ID)


def _near(k: int) -> Callable:
    """Task: of this block, the k best other rows of each anchor's label."""

    def near(table: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and anchors.num_rows:
            rows, asked = _Vectors(table), _Vectors(anchors)
            for label in np.unique(asked.label):
                mine, theirs = np.flatnonzero(asked.label == label), np.flatnonzero(rows.label == label)
                for at in _tiles(len(mine), TILE[0]):
                    a, best = asked.some(mine[at]), _Best(k)
                    most, none = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), np.iinfo(np.int64).min)
                    for other in _tiles(len(theirs), TILE[1]):
                        b = rows.some(theirs[other])
                        i, j, score = survivors(a, b, best.edges(none), most)
                        apart = a.row[i] != b.row[j]
                        best.add(i[apart], score[apart], b.id[j[apart]], b.row[j[apart]])
                    i, score, ident, row = best.held
                    out.append((a.row[i], score, ident, row))
        anchor, score, ident, row = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"anchor": anchor, "score": score, "vec_id": _ids(ident), "row": row})

    return near


def _windows(scores: np.ndarray, window: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest negative score of every positive score, in hundredths of it."""
    low, high = window
    return -((-scores // 100) * low + (-scores % 100) * low // 100), (scores // 100) * high + (scores % 100) * high // 100


def _hard(k: int, window: tuple[int, int]) -> Callable:
    """Task: of this block, for each positive of each anchor the k best rows of another label in its window."""

    def hard(table: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and anchors.num_rows:
            rows, asked = _Vectors(table), _Vectors(anchors)
            n = np.array([len(x) for x in anchors["scores"]])
            width = int(n.max())
            scores = np.full((len(n), width), -1, np.int64)  # a negative score has an empty window
            scores[np.arange(width) < n[:, None]] = anchors["scores"].combine_chunks().flatten().to_numpy()
            low, high = _windows(scores, window)
            low[scores < 0] = _NO_ID  # so that no score is in it
            for at in _tiles(len(n), TILE[0]):
                at = at[(low[at] <= high[at]).any(axis=1)]
                a, best, lo, hi = asked.some(at), _Best(k), low[at], high[at]
                most = np.where(lo <= hi, hi, -1).max(axis=1, initial=-1)
                for other in _tiles(len(rows.row), TILE[1]):
                    b = rows.some(other)
                    least = np.maximum(best.edges(lo.ravel()).reshape(lo.shape), lo).min(axis=1, initial=_NO_ID)
                    i, j, score = survivors(a, b, least, most)
                    apart = a.label[i] != b.label[j]
                    i, j, score = i[apart], j[apart], score[apart]
                    pair, slot = np.nonzero((score[:, None] >= lo[i]) & (score[:, None] <= hi[i]))
                    best.add(i[pair] * width + slot, score[pair], b.id[j[pair]], b.row[j[pair]])
                group, score, ident, row = best.held
                out.append((a.row[group // width] if width else group, group % max(width, 1), score, ident, row))
        anchor, slot, score, ident, row = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
        return pa.table({"anchor": anchor, "slot": slot.astype(np.int32), "score": score, "vec_id": _ids(ident), "row": row})

    return hard


def _paired(rows: DataFrame, anchors: DataFrame, task: Callable, schema: str) -> DataFrame:
    """What the task makes of every block of rows with every block of anchors of one length.

    The sizes are a row for each length of a vector; there are no more lengths than the
    root of twice the values, so they are broadcast.
    """
    def blocks(df: DataFrame, values: int, name: str) -> DataFrame:
        return df.groupBy("dim").agg(F.ceil(F.count("*") * F.greatest(F.lit(1), F.col("dim")) / values).cast("int").alias(name))

    sizes = blocks(rows, ROW_VALUES, "n_rows").join(blocks(anchors, ANCHOR_VALUES, "n_anchors"), "dim")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    left = rows.join(F.broadcast(sizes), "dim").select(*rows.columns, own("n_rows").alias("rb"), every("n_anchors").alias("ab"))
    right = anchors.join(F.broadcast(sizes), "dim").select(*anchors.columns, own("n_anchors").alias("ab"), every("n_rows").alias("rb"))
    keys = ["dim", "rb", "ab"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, schema)


def mined(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of vectors that are anchors.

    vectors: (vec_id, label, embedding); other columns are ignored.  Rows with a null
    label, a null vector, or a null or non-finite component take no part; a component x
    counts as floor(256 * x).  An anchor's positives are the best other rows of its label;
    each has the best rows of other labels with 100 * score from window[0] to window[1]
    times its own score.  Ties go to the smaller vec_id, null ids last; repeated rows
    count each for itself.  Vectors of different lengths have no score; those without
    components have zero.  Scores must fit in 64 bits.  An empty table gives no rows.
    """
    rows = summarised(vectors)
    again = vectors.sparkSession.read.schema(rows.schema).parquet(rows.written_path)  # cogroup wants columns of its own
    anchors = again.where(anchor)
    found = _paired(rows, anchors, _near(positives), "anchor long, score long, vec_id long, row long")
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), "row"]
    found = found.withColumn("slot", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)) - 1).where(F.col("slot") < positives)
    slots = written(found.withColumnRenamed("anchor", "of").select("of", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # As many scores as positives, so the lists are short.
    scores = slots.groupBy("of").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asked = anchors.join(scores, F.col("row") == F.col("of")).drop("of")
    best = _paired(rows, asked, _hard(negatives, window), "anchor long, slot int, score long, vec_id long, row long")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*order))).where(F.col("rank") <= negatives)
    named = anchors.select(F.col("row").alias("of"), F.col("vec_id").alias("anchor_id")).join(slots, "of")
    told = best.select(F.col("anchor").alias("of"), "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return told.join(named, ["of", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
