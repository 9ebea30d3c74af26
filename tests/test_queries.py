import pytest

from quillstone import catalog
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_passages():
    from quillstone.operators.chunking import packed

    text = " ".join(f"Sentence number {i} has exactly nine tokens here." for i in range(40))
    found = packed(text, 120, 30)
    assert all(n <= 120 for _, n in found) and all(p.endswith("here.") and p.startswith("Sentence") for p, _ in found)
    for (a, _), (b, _) in zip(found, found[1:], strict=False):
        first = b.split(" has")[0]
        assert first in a  # each passage starts with a whole sentence of the one before
    assert packed("Too short.") == []
    assert "".join(text.split()) in "".join("".join(p.split()) for p, _ in packed(text, 10_000, 0))


def test_passages_by_brute_force(spark, sf_dir):
    """Every passage is a run of whole sentences; runs are as long as fits, and overlap by as many as fit."""
    import hashlib
    import re

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = set()
    for doc, text in texts.items():
        said = [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])", text) if s.strip()]
        size = [len(re.findall(r"\w+|[^\w\s]", s)) for s in said]
        begin, end, found = 0, 0, []
        while end < len(said):
            stop = end + 1
            while stop < len(said) and sum(size[begin : stop + 1]) <= 320:
                stop += 1
            if begin < end and sum(size[begin:stop]) > 320:  # nothing new fits behind the overlap
                stop = end + 1
            found.append((" ".join(said[begin:stop]), sum(size[begin:stop])))
            begin = end = stop
            while begin > 0 and sum(size[begin - 1 : end]) <= 48:
                begin -= 1
        want |= {(doc, i, n, hashlib.md5(p.encode()).hexdigest()) for i, (p, n) in enumerate([x for x in found if x[1] >= 12])}
    assert {tuple(r) for r in catalog.QUERIES["chunk_documents"](spark, sf_dir).select("doc_id", "chunk_index", "n_tokens", "digest").collect()} == want
