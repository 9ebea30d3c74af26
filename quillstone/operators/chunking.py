"""Passages of about 320 tokens that never cut a sentence."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a passage, of the overlap with the one before, and of the smallest passage.
TARGET, OVERLAP, LEAST = 320, 48, 12

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def packed(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(passage, tokens): whole sentences up to the target, starting again with the last whole sentences within the overlap."""
    sentences = [(s, len(_TOKEN.findall(s))) for s in _SENTENCE.split(text) if s.strip()]
    out: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []
    size = fresh = 0
    for sentence in sentences:
        if held and fresh and size + sentence[1] > target:
            out.append((" ".join(s for s, _ in held), size))
            tail: list[tuple[str, int]] = []
            kept = 0
            while held and kept + held[-1][1] <= overlap:
                kept += held[-1][1]
                tail.insert(0, held.pop())
            held, size, fresh = tail, kept, 0
        held.append(sentence)
        size += sentence[1]
        fresh += 1
    if fresh:
        out.append((" ".join(s for s, _ in held), size))
    return [x for x in out if x[1] >= LEAST]


def chunked(documents: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, text, n_tokens) of every document; null texts have no passages."""
    def cut(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            rows = [(d, i, text, n) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for i, (text, n) in enumerate(packed(t, target, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "n_tokens"])

    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, "doc_id long, chunk_index int, text string, n_tokens int")
