"""Toxicity by weak supervision.

Many voters look at a text and vote toxic or abstain: lexicons of known insults by
language, patterns such as shouting, and lexicons induced from labelled rows.
The labelled rows are dealt into folds, and each fold builds its own lexicons of
three kinds: whole words, five-letter beginnings, and beginnings of three to six
letters that are dense in a text.  The voters look at a bounded sample of labelled
and unlabelled rows; a lexicon abstains on the rows that built it.

A generative label model estimates from the votes alone, by
expectation-maximisation, how often each voter fires in either class and how the
voters' errors correlate; correlated voters share their weight through the inverse
of the error covariance.  Its posteriors are the soft labels of a linear
classifier over all words, beginnings and dense beginnings of the sample, which
scores every text.  Labels are read only to induce lexicons.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrowtext import LOWER, Powers, mixed, slices, span_hashes, word_spans
from quillstone.llm.quality import held_out

#: Rows that the fit reads at most, about, taken by a hash of doc_id, and the bytes of their texts.
TRAIN_ROWS = 10_000
UNLABELLED_ROWS = 5_000
TRAIN_BYTES = 24 << 20

#: Insults that are known beforehand, a voter for each language.
SEEDS = {
    "english": "idiot idiots moron morons stupid scum trash loser losers pathetic disgusting worthless clown clowns imbecile filth vermin bastard bitch",
    "german": "idiotisch dumm abschaum trottel versager",
    "french": "connard imbécile ordure minable",
    "spanish": "idiota estúpido imbécil escoria basura",
}
PATTERNS = ("shouting", "masked words", "repeated exclamation marks")

#: Bytes of text that a task looks at at once.
SLICE_BYTES = 1 << 19

#: Words are split as letters: digits, a-z and every character from U+0080.
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[97:123] = _GAP[128:] = False

#: Letters of a beginning that counts where it occurs, and of those that count where they are dense.
STEM = 5
STEMS = (3, 4, 5, 6)

#: Dense: twice at least, and one word of so many.
DENSE = 125

#: Kinds of features, in the two lowest bits of their 32-bit hashes.
WORD, BEGINNING, DENSE_BEGINNING = KINDS = (0, 1, 2)

#: Columns of a model on its way from the task that fits it.
_MODEL = ["features", "weights", "bias", "voters", "accuracies", "correlation"]

#: Labelled rows are dealt into so many folds.
FOLDS = 3

#: An induced entry stands out of the non-toxic rows of its fold by this many standard errors of its log odds.
SIGNIFICANT = 3.0

#: At least this share of the fold's rows that have an entry is toxic, and so many of them.
PURE = 0.8
LEAST = 3

#: The vote of so many entries of all lexicons together.
MANY = 3

#: Features of fewer sample rows have no weight; a feature's residuals must add up to PENALTY.
RARE = 3
PENALTY = 1.0

#: Features of more than this share of the training rows don't tell copies apart.
COMMON = 0.004
ROUNDS = 40


def _named(hashes: np.ndarray, kind: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFC)) | np.uint32(kind)


def _seed_hashes(words: str) -> np.ndarray:
    words = [w.encode() for w in words.split()]
    ends = np.cumsum([len(w) for w in words])
    return np.sort(_named(span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, Powers()), WORD))


def _found(raw: np.ndarray, off: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and rows of words and STEM beginnings; features and rows of all beginnings; words of each row."""
    low = LOWER[raw]
    starts, ends, first = word_spans(low, off, _GAP)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    words = _named(span_hashes(low, starts, ends, powers), WORD)
    lead = np.append(np.flatnonzero((low & 0xC0) != 0x80), len(low))  # where characters begin
    index = np.searchsorted(lead, starts)
    names, rows, at_stem = [], [], None
    for letters in STEMS:
        stop = lead[np.minimum(index + letters, len(lead) - 1)]
        longer = np.flatnonzero(stop < ends)
        hashes = mixed(span_hashes(low, starts[longer], stop[longer], powers) ^ np.uint64(letters))
        names.append(_named(hashes, DENSE_BEGINNING))
        rows.append(row[longer])
        if letters == STEM:
            at_stem = _named(hashes, BEGINNING), row[longer]
    return np.concatenate([words, at_stem[0]]), np.concatenate([row, at_stem[1]]), np.concatenate(names), np.concatenate(rows), np.diff(first)


def _dense(names: np.ndarray, rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and rows of the beginnings that are dense in a row."""
    pairs, count = np.unique(rows.astype(np.uint64) << np.uint64(32) | names, return_counts=True)
    row = (pairs >> np.uint64(32)).astype(np.int64)
    held = (count >= 2) & (DENSE * count >= words[row])
    return (pairs[held] & np.uint64(0xFFFFFFFF)).astype(np.uint32), row[held]


def _patterns(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x 3: shouting, masked words, repeated exclamation marks."""
    def total(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag)])
        return sums[off[1:]] - sums[off[:-1]]

    upper, lower = total((raw >= 65) & (raw <= 90)), total((raw >= 97) & (raw <= 122))
    twice = np.zeros(len(raw), bool)
    twice[1:] = raw[1:] == raw[:-1]
    marks, stars = total(twice & (raw == 33)), total(twice & (raw == 42))
    return np.stack([upper > lower, stars > 0, marks > 0], axis=1)


@dataclass
class Classifier:
    """Weights of sorted features, each counting once for a text; what the label model found out about every voter."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    voters: dict[str, float] = field(default_factory=dict)  # accuracies
    correlation: np.ndarray | None = None

    def score(self, raw: np.ndarray, off: np.ndarray, powers: Powers) -> np.ndarray:
        total = np.zeros(len(off) - 1)
        if len(self.features):
            known = lambda x: self.features[np.minimum(np.searchsorted(self.features, x), len(self.features) - 1)] == x
            found, row, stems, stem_row, words = _found(raw, off, powers)
            hit, dense = known(found), known(stems)
            more, more_row = _dense(stems[dense], stem_row[dense], words)
            found, row = np.concatenate([found[hit], more]), np.concatenate([row[hit], more_row])
            at = np.searchsorted(self.features, found)
            pairs = np.unique(row * len(self.features) + at)
            total = np.bincount(pairs // len(self.features), weights=self.weights[pairs % len(self.features)], minlength=len(total))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def label_model(votes: np.ndarray, trusted: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Posteriors of rows x voters (1: toxic, 0: abstains), and accuracies and error correlations of the voters.

    The first guess counts the votes of trusted voters (all, if not given).
    """
    v = votes.astype(float)
    n, m = v.shape
    near = v if trusted is None else v[:, trusted]
    q = np.where(near.sum(1) >= 2, 0.9, np.where(near.any(1), 0.4, 0.02))
    w = np.zeros(m)
    for _ in range(ROUNDS):
        share = float(np.clip(q.mean(), 1e-3, 0.5))
        one, none = (q @ v + 0.5) / (q.sum() + 1), ((1 - q) @ v + 0.5) / ((1 - q).sum() + 1)
        error = v - q[:, None] * one - (1 - q)[:, None] * none
        spread = error.T @ error / n
        spread = 0.8 * spread + np.diag(0.2 * np.diag(spread) + 0.01)
        w = np.linalg.solve(spread, one - none)
        q = 1 / (1 + np.exp(-np.clip(v @ w - 0.5 * (one + none) @ w + np.log(share / (1 - share)), -30, 30)))
    deviation = np.sqrt(np.diag(spread))
    return q, {"accuracy": share * one + (1 - share) * (1 - none), "correlation": spread / np.outer(deviation, deviation), "weight": w}


def _logistic(at: np.ndarray, row: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels, by gradient steps with per-weight rates; weights that residuals don't carry are zero."""
    w, b, n = np.zeros(size), float(np.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3))), len(q)
    seen = np.bincount(at, minlength=size) + 5.0
    for _ in range(150):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[at], minlength=n) + b, -30, 30)))
        error = q - p
        w += 2.0 * (np.bincount(at, weights=error[row], minlength=size) - 0.02 * w) / seen
        w = np.sign(w) * np.maximum(np.abs(w) - 2.0 * PENALTY / seen, 0)
        b += error.mean()
    return w, b


def _once(lists: list[np.ndarray]) -> np.ndarray:
    """One row of each group of copies: rows that agree in two min-hashes of their uncommon features, or else have none."""
    size = np.array([len(x) for x in lists])
    names, which, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    common = (times > max(5, COMMON * len(lists))) | (times < 2)
    signs = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        drawn = mixed(names.astype(np.uint64) ^ np.uint64(salt))
        drawn[common] = np.uint64(2**64 - 1)
        least = np.full(len(lists), np.uint64(2**64 - 1))
        np.minimum.at(least, np.repeat(np.arange(len(lists)), size), drawn[which])
        signs.append(least)
    alone = signs[0] == np.uint64(2**64 - 1)
    signs[0][alone] = np.flatnonzero(alone)
    return np.sort(np.unique(np.stack(signs, axis=1), axis=0, return_index=True)[1])


def _lexicon(which: np.ndarray, row: np.ndarray, y: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """The features that tell toxic from other rows among the labelled rows ``of``."""
    chosen, label = of[row], np.where(of, y, 0)
    n, n_toxic = of.sum(), label.sum()
    toxic = np.bincount(which[chosen], weights=label[row[chosen]], minlength=size)
    clean = np.bincount(which[chosen], minlength=size) - toxic
    odds = np.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - np.log((clean + 0.5) / (n - n_toxic - clean + 0.5))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return (odds > SIGNIFICANT * error) & (toxic >= PURE * (toxic + clean)) & (toxic >= LEAST)


def voted(names: np.ndarray, which: np.ndarray, row: np.ndarray, patterns: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Voters, their votes (rows x voters), and which voters a first guess trusts.

    names: all features; which and row: the feature and the row of every
    occurrence; y: 0, 1 or -1 (no label).
    """
    n = len(y)
    fires = lambda entries: np.bincount(row[entries[which]], minlength=n)
    voters, votes, every = [], [], np.zeros(n)
    for language, words in SEEDS.items():
        hits = fires(np.isin(names, _seed_hashes(words)))
        voters.append(f"lexicon {language}")
        votes.append(hits > 0)
        every += hits
    for k in range(FOLDS):
        own = (y >= 0) & (fold == k)
        if not own.any():
            continue
        entries = _lexicon(which, row, y, own, len(names))
        for kind, title in zip(KINDS, ("words", "beginnings", "dense beginnings"), strict=True):
            hits = np.where(own, 0, fires(entries & ((names & np.uint32(3)) == kind)))
            voters.append(f"{title} of fold {k}")
            votes.append(hits > 0)
            every += hits
    trusted = np.arange(len(voters))
    return [*voters, "many entries", *PATTERNS], np.column_stack([*votes, every >= MANY, patterns]), trusted


def fitted(lists: list[np.ndarray], patterns: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Classifier:
    """The classifier of sample rows: distinct features, patterns, labels (-1: none) and folds.

    Of copies one row is used, as their shared words would all look telling.
    """
    if lists:
        kept = _once(lists)
        lists, patterns, y, fold = [lists[i] for i in kept], patterns[kept], y[kept], fold[kept]
    seeds = np.unique(np.concatenate([_seed_hashes(x) for x in SEEDS.values()]))
    if not lists:
        return Classifier(seeds, np.full(len(seeds), 2.0), -2.0)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    names, which, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    del lists
    used = (times >= RARE) | np.isin(names, seeds)
    held = used[which]
    names, which, row = names[used], (np.cumsum(used) - 1)[which[held]], row[held]
    voters, votes, trusted = voted(names, which, row, patterns, y, fold)
    q, found = label_model(votes, trusted)
    weights, bias = _logistic(which, row, q, len(names))
    # Seeds that the sample doesn't show count as the others do.
    seeded = np.isin(names, seeds)
    unseen = np.setdiff1d(seeds, names)
    typical = float(np.median(weights[seeded])) if seeded.any() else 2.0
    features = np.concatenate([names[weights != 0], unseen])
    order = np.argsort(features)
    weights = np.concatenate([weights[weights != 0], np.full(len(unseen), max(0.0, typical))])
    return Classifier(features[order], weights[order], bias, dict(zip(voters, found["accuracy"].tolist(), strict=True)), found["correlation"])


def _narrow(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _drawn(doc_id: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(F.lit("train"), doc_id), F.lit(1_000_000)) < int(share * 1_000_000)


def _sample(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, y, fold) of labelled (y 0 or 1) and unlabelled (-1) rows that are not held out, within the bounds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    usable = known.where(~held_out(F.col("doc_id")))
    rows = _narrow(documents).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, TRAIN_ROWS / max(1, usable.count()))
    other = min(1.0, UNLABELLED_ROWS / max(1, rows.select("doc_id").count()))

    def taken(share: float, other: float) -> DataFrame:
        # Both sides that are broadcast are as bounded as the sample.
        labelled = rows.join(F.broadcast(usable.where(_drawn(F.col("doc_id"), share))), "doc_id")
        unlabelled = rows.where(_drawn(F.col("doc_id"), other)).join(F.broadcast(known.where(_drawn(F.col("doc_id"), other)).select("doc_id").distinct()), "doc_id", "left_anti")
        both = labelled.unionByName(unlabelled.withColumn("y", F.lit(-1)))
        return both.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))

    size = taken(share, other).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    fits = min(1.0, TRAIN_BYTES / max(1, size))
    return taken(share * fits, other * fits)


def trained(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Classifier:
    """The classifier from rows that are not held out: TRAIN_ROWS labelled and UNLABELLED_ROWS others at most, about, and TRAIN_BYTES."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, raw, off in slices(batches, limit=SLICE_BYTES):
            found, row, stems, stem_row, words = _found(raw, off, powers)
            dense, dense_row = _dense(stems, stem_row, words)
            pairs = np.unique(np.concatenate([row, dense_row]).astype(np.uint64) << np.uint64(32) | np.concatenate([found, dense]))
            edge = np.searchsorted(pairs >> np.uint64(32), np.arange(len(off), dtype=np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
            marks = _patterns(raw, off) @ np.array([1, 2, 4])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), lists, pa.array(marks, pa.int32())], names=["y", "fold", "found", "marks"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        lists = [np.asarray(x.values).view(np.uint32) for batch in held for x in batch.column(2)]
        y, fold, marks = (np.concatenate([np.zeros(0, np.int32), *(np.asarray(batch.column(i)) for batch in held)]) for i in (0, 1, 3))
        order = np.lexsort((marks, [len(x) for x in lists], fold, y)) if lists else []  # not the order of tasks
        model = fitted([lists[i] for i in order], ((marks[:, None] >> np.arange(3)) & 1 > 0)[order] if lists else marks, y[order] if lists else y, fold[order] if lists else fold)
        found = model.features.view(np.int32), model.weights, np.array([model.bias]), list(model.voters), list(model.voters.values()), [] if model.correlation is None else model.correlation.ravel()
        kinds = pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(kind)) for x, kind in zip(found, kinds, strict=True)], names=_MODEL)

    sample = _sample(documents, labels, label).select("text", "y", "fold").mapInArrow(run, "y int, fold int, found array<int>, marks int")
    # As bounded as the sample; the fit's arrays would stay in the driver for as long as it lives.
    schema = "features array<int>, weights array<double>, bias array<double>, voters array<string>, accuracies array<double>, correlation array<double>"
    made = sample.repartition(1).mapInArrow(fit, schema).toArrow().to_batches() or list(fit(iter([])))
    features, weights, bias, voters, accuracies, correlation = (np.asarray(column[0].values) for column in made[0].columns)
    return Classifier(features.view(np.uint32), weights, float(bias[0]), dict(zip(voters.tolist(), accuracies.tolist(), strict=True)), correlation.reshape(len(voters), -1) if len(voters) else None)


def scores(documents: DataFrame, model: Classifier) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, raw, off in slices(batches, limit=SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(raw, off, powers))], names=["doc_id", "score"])

    return _narrow(documents).mapInArrow(run, "doc_id long, score double")


def scored(documents: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    labels: doc_id and the label, 0 or 1; null labels and ids and held-out rows
    are not read.  Null and empty texts have no features and get the base score;
    a very long text is scored whole.
    Repeated rows stay; a null doc_id is scored and not held out.  Without
    labelled rows the seed lexicon alone decides.  Other columns are ignored.
    """
    found = scores(documents, trained(documents, labels, label))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, all their columns kept."""
    model = trained(documents, labels)
    text = F.coalesce("text", F.lit(""))

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        array = pa.array(texts, pa.string())
        batch = pa.RecordBatch.from_arrays([array], names=["text"])
        powers = Powers()
        out = [model.score(raw, off, powers) for _, raw, off in slices(iter([batch]), limit=SLICE_BYTES)]
        return type(texts)(np.concatenate(out) if out else np.zeros(0))

    return documents.where(score(text) < threshold)
