"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillstone.llm import dialogues

INK = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, key string, head int, `a.b` int"
#: Nulls, empty and long texts, ties, repeated rows, other roles.
ODD = [
    (1, 0, "system", "Hello.", "k", 1, 1), (1, 1, "user", "Ask?", "k", 1, 1), (1, 2, "assistant", "Answer", None, 1, 1), (1, 2, "assistant", "Answer", "k", 1, 1), (1, 9, "user", " \t", "k", None, 1),
    (2, None, None, "x", "k", 1, 1), (2, None, "user", None, "k", 1, 1), (2, 5, "tool", "é done!\x1c", "k", 1, 1), (2, 5, "assistant", "So. \n", "k", 1, 1), (2, 5, "user", "Why.", "k", 1, 1),
    (None, 3, "assistant", "One.", "k", 1, 1), (None, 1, "user", "Two", "k", 1, 1), (None, 1, "User", "Two", "k", 1, 1), (3, None, "", "", "k", 1, 1), (4, 0, "system", "Only me.", "k", 1, 1),
    (5, -4, "user", "word " * 200_000 + ".", "k", 1, 1), (5, 7, "user", "Same.", "k", 1, 1), (5, 8, "user", "Same.", "k", 1, 1), (5, 9, "assistant", "Same.", "k", 1, 1),
]


def _damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def _cheapest(rows):
    """(cost, audit, lines) by a search through the cheapest edits first; rows: (role, text, fault)."""
    heap = [(0, "", 0, ())]
    seen = set()
    while heap:
        cost, audit, at, kept = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in kept)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, kept
        if not re.fullmatch("s?(ua)*u?", initials) or (at, initials[-1:]) in seen:
            continue
        seen.add((at, initials[-1:]))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, (*kept, (name, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, kept))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*kept, (role, text))))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, (*kept, (name, text))))
    raise AssertionError("no repair")


def _brute(rows, ids):
    out = {}
    for conv in ids:
        own = sorted((r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest(), r[3]) for r in rows if r[0] == conv)
        seen, told = set(), []
        for _, _, role, _, text in own:
            ink = INK.findall(text)
            told.append((role, text, "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit, kept = _cheapest(told)
        turns = [t for known, t, *_ in own if known]
        initials = [r[:1] for r, _, _ in told]
        n = [sum(f == x for _, _, f in told) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def _got(df):
    rows = df.collect()
    found = {r[0]: tuple(r[1:]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_odd_conversations(spark):
    table = spark.createDataFrame(ODD, SCHEMA)
    want = _brute(_damaged(ODD), {r[0] for r in ODD})
    assert _got(dialogues.repaired(dialogues.damaged(table), table)) == want
    assert want[3][5:7] == (4, "D") or want[3][5:7] == (0, "")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in ODD]
    assert _got(dialogues.repaired(table)) == _brute(plain, {r[0] for r in ODD})


def test_no_rows(spark):
    table = spark.createDataFrame(ODD, SCHEMA)
    assert dialogues.repaired(table.limit(0)).count() == 0
    assert _got(dialogues.repaired(table.limit(0), table.where("conv_id = 1"))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("piece", [3, 1 << 20])
def test_random_conversations(spark, monkeypatch, piece):
    """Short random ones, and one with very many rows, in pieces over many ranges."""
    monkeypatch.setattr(dialogues, "PIECE", piece)
    draw = random.Random(7)
    said = lambda: (draw.choice(["system", "user", "assistant", "user", "assistant", "tool"]), draw.choice(["Yes.", "No!", "cut off", "", f"New {draw.random()}."]))
    rows = [(conv, turn, *said()) for conv in range(60) for turn in range(draw.randrange(9))] + [(99, turn // 2, *said()) for turn in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = _got(dialogues.repaired(table.repartition(5)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == _brute(rows, {r[0] for r in rows})


def test_the_automaton_decides(spark, monkeypatch):
    """Repairs follow from the nodes; suffixes with equal costs to go are one node."""
    automaton = dialogues.Automaton()
    node = automaton.END
    for letter in "IEIEIEIEIE":  # the last row comes first
        node = automaton.before(letter, node)
    assert node[0] + node[1][dialogues.START] == 0 and len(automaton.nodes) <= 4
    monkeypatch.setattr(dialogues.Automaton, "before", lambda self, letter, node: (node[0] + 4, (0, 0, 0, 0), ("D",) * 4))
    table = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    assert dialogues.repaired(table).select("cost", "audit").collect() == [(8, "DD")]


def test_damage(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in dialogues.damaged(table).collect()) == sorted(_damaged(rows))
    assert dialogues.damaged(table.withColumn("conv_id", F.lit(None).cast("long"))).where("role = 'user'").count() > 0
