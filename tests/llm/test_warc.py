"""WARC archives: the round trip, real files, and what is saved of damaged ones."""

import gzip
import hashlib
from base64 import b32encode

import pytest

from quillstone.llm import warc
from quillstone.llm.warc import END, PADDING, member, record, salvaged

SCHEMA = "page_id long, url string, html string, sha string, top int, `a.b` int"
#: Nulls, empty and long payloads, equal payloads, repeated rows, payloads that look like records.
ODD = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (5, "http://a/5", "same"), (5, "http://a/5", "same"), (5, "http://a/5", "same"), (5, "http://a/55", "same"), (5, None, "same"), (3, None, None), (4, "http://a/\r\n4\x00", ""), (None, "http://a/n", ""),
    (None, "http://a/n", "only null"), (None, "http://a/n", "only null"), (6, "é", "é 日本 😀\x00\r\n\r\nWARC/1.1\r\n\r\n"), (7, "", "x" * 3_000_000), (8, "", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 3), (-9, "u", "minus"), (9, "u", "minus"),
]


def _digest(text):
    return b32encode(hashlib.sha1(text.encode()).digest()).decode()


def _expected(rows):
    """(page_id, bytes, digest, type, refers_to), one response for each payload."""
    out = []
    for payload in {h or "" for _, _, h in rows}:
        ids = sorted((p for p, _, h in rows if (h or "") == payload), key=lambda p: (p is not None, p or 0))
        size, told = len(payload.encode()), _digest(payload)
        out += [(p, size, told, "revisit", ids[-1]) for p in ids[:-1]] + [(ids[-1], size, told, "response", None)]
    return sorted(out, key=repr)


def _table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK_BYTES", block)
    monkeypatch.setattr(warc, "FILE_BLOCKS", 2)
    assert sorted((tuple(r) for r in warc.round_trip(_table(spark, ODD).repartition(3)).collect()), key=repr) == _expected(ODD)
    assert warc.round_trip(_table(spark, ODD).limit(0)).count() == 0


def test_files(spark, sf_dir):
    """Files are whole gzip streams of WARC records; payloads come back byte by byte; no gap."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = warc.archived(pages)
    found = warc.read_archives(spark, path, with_payload=True)
    want = {r.page_id: r for r in pages.collect()}
    got = found.collect()
    assert warc.gaps(found).count() == 0 and len(got) == len(want)
    for r in got:
        assert r.url == want[r.page_id].url and (r.record_type == "revisit" or bytes(r.payload).decode() == want[r.page_id].html)
    for f in spark.read.format("binaryFile").load(path).collect():
        plain = gzip.decompress(bytes(f.content))
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(END)
    ids = [line for f in spark.read.format("binaryFile").load(path).collect() for line in gzip.decompress(bytes(f.content)).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == len(want)


def _records(n=8):
    made = []
    for i in range(n):
        payload = f"<p>{i} WARC/1.1\r\nnot a record</p>".encode() * (i + 1)
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        made.append(record({"WARC-Type": "response", "Page-ID": i, "WARC-Payload-Digest": f"sha1:{warc.digest(payload)}"}, block))
    return made


def _walk(data):
    """Page ids, and gaps as (start, end, reason)."""
    found = list(salvaged(data))
    at = 0
    for f in found:  # records and gaps cover the file in order
        assert f[0] >= at or f[1] == at  # a member of several records
        at = f[1]
    return [warc._number(f[2].get("page-id")) for f in found if len(f) > 3], [f for f in found if len(f) == 3]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [member(r) if packed else r for r in _records()]
    whole = b"".join(parts)
    edge = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    assert _walk(whole) == (list(range(8)), [])
    for at in range(edge[2], edge[3]):  # any byte of the third record
        hurt = whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :]
        ids, gaps = _walk(hurt)
        # Some header bytes of a gzip member, and a plain record's names of fields, carry no check; all others cost this record alone.
        assert ids in ([0, 1, *range(3, 8)], list(range(8))) or not packed and ids[:2] + ids[3:] == [0, 1, *range(3, 8)]
        assert [g[:2] for g in gaps] == ([] if len(ids) == 8 else [(edge[2], edge[3])])
    cut = whole[: edge[4] + 20]  # the end is missing
    assert _walk(cut) == ([0, 1, 2, 3], [(edge[4], edge[4] + 20, _walk(cut)[1][0][2])])
    lost = whole[: edge[1] + 30] + whole[edge[2] :]  # a hole in the second record
    assert _walk(lost)[0] == [0, 2, 3, 4, 5, 6, 7] and _walk(lost)[1][0][:2] == (edge[1], edge[1] + 30)
    noise = b"\x1f\x8b\x08 noise \nWARC/1.1\r\n" + whole + b"tail"
    ids, gaps = _walk(noise)
    assert ids == list(range(8)) and [g[:2] for g in gaps] == [(0, len(noise) - len(whole) - 4), (len(noise) - 4, len(noise))]
    assert _walk(b"") == ([], []) and _walk(b"junk")[1] == [(0, 4, "no version line")] and _walk(PADDING * 2 + whole + PADDING) == (list(range(8)), [])


def test_mixed_and_wrong_digests():
    one, two, three, *_ = _records()
    assert _walk(member(one) + two + member(three)) == ([0, 1, 2], [])
    assert _walk(member(one + two) + three) == ([0, 1, 2], [])  # a member of several records
    wrong = two.replace(b"<p>1", b"<p>9", 1)
    ids, gaps = _walk(member(one) + member(wrong) + member(three))
    assert ids == [0, 2] and gaps[0][2] == "block digest differs"
    claimed = record({"WARC-Type": "response", "WARC-Payload-Digest": f"sha1:{warc.digest(b'other')}"}, b"HTTP/1.1 200 OK\r\n\r\nthis")
    assert _walk(one + claimed + three)[1][0][2] == "payload digest differs"
    longer = two.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert _walk(one + longer + three)[0] == [0, 2]


def test_gaps_of_files(spark, tmp_path):
    parts = [member(r) for r in _records()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(parts[:3]) + b"\x00" * 50 + b"".join(parts[3:]))
    (tmp_path / "c.warc.gz").write_bytes(b"")
    found = warc.read_archives(spark, str(tmp_path))
    assert sorted(r.page_id for r in found.where("gap is null").collect()) == sorted([*range(8)] * 2)
    start = sum(map(len, parts[:3]))
    assert [(r.file[-9:], r.start, r.end) for r in warc.gaps(found).collect()] == [("b.warc.gz", start, start + 50)]
