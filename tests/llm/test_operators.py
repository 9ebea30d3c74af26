"""Corpus operators against brute force on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import decontamination, licences, lineage, linededup, phrases, pieces, quality, queries, rules, sharding, simhash, toxicity
from quillstone.llm.graph import components
from tests.compare import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, shard string, row int, print string"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20000))
#: Nulls, empty and very long texts, ties, repeated rows, clashing names.
ODD = [
    (1, "a b c d e f g h i j k l m n", "s", 1, "p"), (2, "a b c d e f g h i j k l m n", "s", 1, "p"), (2, "a b c d e f g h i j k l m n", "s", 1, "p"), (3, None, None, None, None), (4, "", "s", 2, "p"),
    (None, "a b c d e f g h i j k l m n", "s", 3, "p"), (5, LONG, "s", 4, "p"), (6, LONG + " tail", "s", 4, "p"), (7, "one line\none line\nMIT License, or Apache License!\n\n", "s", 5, "p"), (8, "é ▁ 日本 😀  \t x\n", "s", 6, "p"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (5, 1, 0), (6, 0, 1), (7, 1, None), (None, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)


def _apply(odd, labels, benchmark):
    return {
        "quality": quality.scored(odd, labels), "toxicity": toxicity.scored(odd, labels), "leaks": decontamination.contaminated(odd, benchmark), "licences": licences.scanned(odd), "pieces": pieces.encoded(odd),
        "shards": sharding.assigned(odd), "rules": rules.filtered(odd), "phrases": phrases.without_repeats(odd, 1000), "lines": linededup.deduplicated(odd), "simhash": simhash.clustered(odd),
        "representatives": simhash.representatives(odd), "clean": decontamination.without_contaminated(odd, benchmark), "kept": toxicity.without_toxic(odd, labels),
    }


def test_odd_rows(spark, odd, labels):
    benchmark = spark.createDataFrame([(0, "a b c d e f g h i j k l m n"), (1, None)], "item_id long, text string")
    found = {k: v.collect() for k, v in _apply(odd, labels, benchmark).items()}
    n = len(ODD)
    assert {k: len(v) for k, v in found.items()} == {
        "quality": n, "toxicity": n, "licences": n, "pieces": n, "shards": n, "rules": n, "phrases": n, "lines": n, "simhash": n,
        "leaks": 3, "clean": 6 + 1, "kept": len(found["kept"]), "representatives": len({r.component_id for r in found["simhash"]}),
    }
    assert all(r.lossless for r in found["pieces"])
    removed = {(r.doc_id, r.n_words): r.n_removed for r in found["phrases"]}
    assert removed == {(1, 14): 0, (2, 14): 14, (3, 0): 0, (4, 0): 0, (None, 14): 0, (5, 40000): removed[5, 40000], (6, 40001): 40000, (7, 9): 0, (8, 5): 0}
    assert {r.doc_id for r in found["simhash"] if r.component_id == 3} == {3, 4}
    assert sorted(zip((r.shard for r in found["shards"]), (r.slot for r in found["shards"]), strict=True)) == sorted((i % 8, i // 8) for i in range(n))
    assert set(found["lines"][0].asDict()) == {"doc_id", "text", "shard", "row", "print", "n_lines", "n_removed", "n_runs", "longest_run", "longest_repeat"}


LINED = [
    (1, "a\nb\n\nc\nonly one\nd\ne\nf", "mine", 7), (2, "x\na\nb\nc\ny", None, 7), (2, "x\na\nb\nc\ny", None, 7), (3, "d\ne\nz\n\n\nb\n\nc\n\nend", "", 7), (None, "q\nd\ne", "n", 7),
    (4, None, "n", 7), (5, "", "n", 7), (6, "a\na\na\na\nb\nc", "n", 7), (7, "c\n \n" + "b\nc\n" * 9, "n", 7), (8, "\n".join(["b", "c"] * 40), "n", 7), (9, "f\n" + "w " * 25 + "\ng\n" + "w " * 25, "n", 7),
]


def _lined(rows, min_lines=2, min_words=20):
    """Brute force of line dedup: {(doc, text): (text left, longest run that occurs elsewhere)}."""
    docs = sorted({(d, t or "") for d, t, *_ in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    lines = {x: [(i, s) for i, s in enumerate(x[1].split("\n")) if WORD.search(s)] for x in docs}
    gone, longest = {x: set() for x in docs}, dict.fromkeys(docs, 0)
    for size in range(1, max(map(len, lines.values())) + 1):
        seen, first = Counter(), {}
        windows = [(x, i, tuple(s for _, s in held[i : i + size])) for x, held in lines.items() for i in range(len(held) - size + 1)]
        for x, i, w in windows:
            seen[w] += 1
            if first.setdefault(w, (x, i)) != (x, i) and (size >= min_lines or len(WORD.findall(w[0])) >= min_words):
                gone[x].update(range(lines[x][i][0], lines[x][i + size - 1][0] + 1))
        if not any(n > 1 for n in seen.values()):
            break
        for x, _, w in windows:
            longest[x] = size if seen[w] > 1 else longest[x]
    return {x: ("\n".join(s for i, s in enumerate(x[1].split("\n")) if i not in gone[x]), longest[x]) for x in docs}


@pytest.mark.parametrize("depth", [2, 4])
def test_line_runs(spark, depth):
    docs = spark.createDataFrame(LINED, "doc_id long, text string, n_runs string, `a.b` int")
    want = _lined(LINED, depth)
    held = {d: t or "" for d, t, *_ in LINED}
    got = linededup.deduplicated(docs, depth).collect()
    assert sorted(((r.doc_id or 0, r.text or "", r.longest_repeat) for r in got)) == sorted((d or 0, *want[d, held[d]]) for d, *_ in LINED)
    kept = linededup.without_repeated_lines(docs, depth)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.n_runs or "", r["a.b"]) for r in kept.collect()) == sorted((d or 0, n or "", k) for d, _, n, k in LINED)


def test_lines_are_kept_when_the_array_says_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"only {i}\na\nb\nother {i}") for i in range(3)], "doc_id long, text string")
    assert {r.n_removed for r in linededup.deduplicated(docs).collect()} == {0, 2}
    monkeypatch.setattr(linededup, "common_prefixes", lambda ranks, rounds, own=linededup.common_prefixes: own(ranks, rounds).withColumn("lcp", F.lit(0)))
    monkeypatch.setattr(linededup, "_ranked", lambda classes, own=linededup._ranked: own(classes).withColumn("rank", -F.col("rank")))
    docs = spark.createDataFrame([(i, "a\nb\n" * (i + 1)) for i in range(3)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linededup.deduplicated(docs).collect()} != {0: 0, 1: 4, 2: 6}


def test_empty_tables(spark, odd, labels):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    counts = {k: v.count() for k, v in _apply(odd.limit(0), labels.limit(0), benchmark).items()}
    assert counts == dict.fromkeys(counts, 0)


def _fingerprint(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(prints):
    """The smallest id that each reaches, by relaxation over all pairs."""
    root = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def test_simhash_components(spark, sf_dir, texts):
    prints = {d: _fingerprint(t) for d, t in texts}
    root = _roots(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op10_simhash_near_dedup"](spark, sf_dir).collect()}
    assert got == {d: (format(prints[d], "016x"), root[d]) for d in prints}


def test_representatives(spark):
    rows = [(None, "a b c d e"), (None, "f g h i j k"), (None, "f g h i j k"), (3, "l m n o p"), (3, "l m n o p"), (9, "l m n o p"), (None, "l m n o p"), (4, "q r s t u v w"), (4, "x y z a b c d")]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(None, "a b c d e"), (None, "f g h i j k"), (3, "l m n o p"), (4, "q r s t u v w"), (4, "x y z a b c d")], key=repr)


def test_simhash_links(spark):
    import random

    draw = random.Random(1)
    values = [draw.getrandbits(64) for _ in range(60)]
    for v in values[:40]:
        for flips in (1, 2, 3, 4):
            for b in draw.sample(range(64), flips):
                v ^= 1 << b
            values.append(v)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    got = sorted((r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "print long")).collect())
    assert got == [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_sides_that_may_be_large_are_not_broadcast(spark):
    """All are tiny here, so Spark would broadcast them; only the hot classes are few whatever the input."""
    prints = lineage.written(spark.range(50).select(F.col("id").alias("print")), "prints")
    assert not _broadcasts(simhash.links(prints))
    classes = prints.groupBy("print").agg(F.count("*").alias("members"))
    assert _broadcasts(simhash.attached(prints, classes, ["print"], ["print"], 50)) == 1


def test_rounds_of_lines_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "\n".join(f"line {i * j % 7}" for j in range(9))) for i in range(6)], "doc_id long, text string")
    _, ranks, rounds = linededup.suffix_array(linededup._repeated(linededup.lines(docs), 2))
    prefixes = []
    monkeypatch.setattr(linededup, "written", lambda df, name: prefixes.append(df) or lineage.written(df, name))
    linededup.common_prefixes(ranks, rounds)
    assert rounds and len(prefixes) == 1 + len(rounds) and not any(map(_broadcasts, prefixes))  # a plan for each round


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}


def _phrased(rows):
    """Brute force of phrase removal: (doc_id, words, removed, text left) of every row."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 12 if d is not None else 0):
            first[tuple(w[i : i + 13])] = min(d, first.get(tuple(w[i : i + 13]), d))
    kept = []
    for d, w in words:
        gone = {i + k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(13)}
        kept.append((d or 0, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(kept)


def test_phrases_in_small_shards(spark, sf_dir, texts, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(phrases, "SORT_BYTES", 100_000)
    monkeypatch.setattr(phrases, "TAKERS", 2)
    got = sorted(tuple(r) for r in phrases.without_repeats(docs, 20_000, 50_000).select("doc_id", "n_words", "n_removed", "text").collect())
    assert got == _phrased(texts)


def test_phrases_of_one_id_and_of_many_words(spark, monkeypatch):
    passage = [f"p{i}" for i in range(40)]
    rows = [(7, " ".join([f"x{i}", *passage[i % 9 : 30], f"y{i}"])) for i in range(12)] + [(9, " ".join(passage)), (3, " ".join(passage[20:34])), (9, "a " * 30), (11, "a " * 20), (7, None), (None, " ".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _phrased(rows)
    for letters, shard in ((phrases.LETTERS, 200), (7, 200), (7, 1 << 20)):  # few letters: two for each word
        monkeypatch.setattr(phrases, "LETTERS", letters)
        assert sorted((r.doc_id or 0, *r[1:]) for r in phrases.without_repeats(docs, shard).collect()) == want
    assert any(n for _, _, n, _ in want)


def test_only_automata_remove_words():
    table = pa.table({"doc_id": [1, 2], "text": [" ".join(f"w{i}" for i in range(20))] * 2, "shard": [0, 0]})
    shard = phrases._Shard(table, 40)
    sent = pa.table({"holder": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    assert phrases._removed(shard, sent).sum() == 20
    other = phrases._Shard(table.slice(1), 40)
    assert phrases._removed(other, sent).sum() == 0  # nothing recurs inside, and nothing was sent
    sent = pa.table({"holder": pa.array([1], pa.int64()), "text": [" ".join(f"w{i}" for i in range(3, 17))]})
    assert phrases._removed(other, sent).sum() == 14


def test_licence_places(spark, sf_dir, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in queries.QUERIES["op4_licence_scan"](spark, sf_dir).collect():
        w = word.findall(dict(texts)[r.doc_id].translate(lower))
        at = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert {x for _, x in at} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licence_expressions(spark):
    assert licences.evaluated("MIT OR GPL-3.0-only")[0] == 0.95
    assert licences.evaluated("MIT AND GPL-3.0-only")[0] == 0.3
    assert licences.evaluated("(MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0") == (pytest.approx(0.37), ["mit", "apache-2.0", "gpl-2.0"])
    assert licences.evaluated("MIT OR")[0] == 0.95
    assert licences.evaluated(")(") is None
    rows = spark.createDataFrame([(1, "x SPDX-License-Identifier: MIT OR GPL-3.0\ny"), (2, "mit license mit license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scanned(rows).collect()}
    assert (got[1].labels, got[1].score) == ("gpl-3.0,mit", 0.95)
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (2, 0, 2)


def test_prose_after_a_tag_is_no_licence():
    assert licences.evaluated("is used to choose a license.") is None and licences.evaluated("see LICENSE file") is None
    assert licences.evaluated("MIT/Apache-2.0") == (0.95, ["mit", "apache-2.0"])
    assert licences.evaluated("EPL-2.0 or later versions") == (licences.UNKNOWN, ["epl-2.0"])
    assert licences.evaluated("GPL-2.0 WITH care") == (0.3, ["gpl-2.0"])


def _value(tokens):
    """Recursive descent over a well-formed expression."""
    def parse(level):
        if level == 3:
            if tokens[0] == "(":
                tokens.pop(0)
                out = parse(0)
                tokens.pop(0)
                return out
            return licences.freedom(tokens.pop(0).lower())
        out = parse(level + 1)
        while tokens and tokens[0].lower() in (("or", "/"), ("and",), ("with",))[level]:
            tokens.pop(0)
            if level == 2:
                tokens.pop(0)
                out = out + (1 - out) * 0.1
            else:
                out = (max, min)[level](out, parse(level + 1))
        return out

    return parse(0)


def test_licence_expressions_by_recursive_descent():
    import random

    draw = random.Random(3)
    names = ["MIT", "GPL-3.0-only", "Apache-2.0", "LGPL-2.1-or-later", "EPL-1.0", "0BSD", "CC-BY-SA-4.0"]

    def made(depth):
        kind = draw.randrange(6 if depth else 2)
        if kind < 2:
            return [draw.choice(names)] + (["WITH", "Classpath-exception-2.0"] if kind else [])
        return ["(", *made(depth - 1), ")"] if kind == 2 else [*made(depth - 1), draw.choice(["or", "AND", "/", "Or", "and"]), *made(depth - 1)]

    for _ in range(300):
        tokens = made(4)
        value, found = licences.evaluated(" ".join(tokens))
        assert value == pytest.approx(_value(list(tokens))) and found == [x.lower() for x in tokens if x in names]


def test_shards_follow_from_seed_and_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one, other = (sharding.shuffled(d, F.col("doc_id"), bucket_rows=50).select("doc_id", "shard", "slot").collect() for d in (docs, docs.repartition(7)))
    assert sorted(one) == sorted(other) != sorted(sharding.shuffled(docs, F.col("doc_id"), seed=1, bucket_rows=50).select("doc_id", "shard", "slot").collect())


def test_copies_of_one_row_spread(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(sharding, "written", lambda df, name, own=sharding.written: kept.setdefault(name, own(df, name)))
    rows = [(1, "same", None)] * 400 + [(None, None, "x")] * 300 + [(i, f"text {i}", "y") for i in range(2, 302)]
    got = sharding.shuffled(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").withColumnRenamed("a.b", "other"), F.col("doc_id"), bucket_rows=50, bucket_bytes=4000).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, _ in rows)
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 8, i // 8) for i in range(1000))
    assert kept["hot-rows"].count() == 2 and max(r["size"] for r in kept["buckets"].collect()) < 200


def test_shards(spark, sf_dir, texts):
    rows = queries.QUERIES["op6_external_shuffle"](spark, sf_dir).collect()
    by = {d: (t or "").encode() for d, t in texts}
    assert sorted(r.doc_id for r in rows) == sorted(by)
    assert all((r.size, r.text_crc32) == (len(by[r.doc_id]) + 1, zlib.crc32(by[r.doc_id])) for r in rows)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in range(8))
    small = sharding.shuffled(spark.range(1000), F.lit(0), bucket_rows=64).collect()
    assert sorted(r.id for r in small) == list(range(1000)) and [r.id for r in sorted(small, key=lambda r: (r.slot, r.shard))] != list(range(1000))


def test_shards_hold_whole_documents(spark, odd, tmp_path):
    path = str(tmp_path / "shards")
    digests = sharding.assigned(odd, path=path).collect()
    back = spark.read.parquet(path)
    assert sorted(((r.doc_id, r.text, r.row, r.print) for r in back.collect()), key=repr) == sorted(((d, t, n, p) for d, t, _, n, p in ODD), key=repr)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in digests) == sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ODD)


def test_buckets_follow_bytes_and_long_texts_go_beside(spark, odd, monkeypatch):
    kept = {}
    monkeypatch.setattr(sharding, "written", lambda df, name, own=sharding.written: kept.setdefault(name, own(df, name)))
    got = sharding.shuffled(odd, F.col("doc_id"), bucket_bytes=100, long_bytes=1000).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((d, t) for d, t, *_ in ODD), key=repr)
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 8, i // 8) for i in range(len(ODD)))
    assert kept["long-texts"].count() == 2 and kept["buckets"].count() > 2
    assert max(len(x.text or "") for r in kept["buckets"].collect() for x in r.records) <= 1000


def test_reparameterised_questions(spark):
    item = "If Mary buys 5 kg of apples at 2 dollars each then how much money must Mary pay in total today?"
    docs = [
        (1, "Start. " + item.replace("Mary", "Anna").replace("5", "12") + " End."),  # one value for another
        (2, item.replace("Mary buys", "Bob buys").replace("must Mary", "must Carl")),  # two for one
        (3, "If it rains then how much money must we pay?"),
        (4, item),
    ]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {(1, 7), (4, 7)}


def test_slots_follow_the_row_and_not_its_id(spark):
    item = "If Mary buys 5 kg of apples at 2 dollars each then how much money must Mary pay in total today?"
    docs = [(None, item.replace("Mary", "Anna")), (1, item), (1, item.replace("Mary", "Bob")), (1, "Other words of this id. " * 9)]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.item_id) for r in found.collect()) == [(0, 7), (1, 7)]


def test_items_without_template_windows_are_found_exactly(spark):
    items = [(0, "What is 12 + 7 * 3 - 44 / 5 + 9 * 8?"), (1, "Anna Bob Carl Dora Emil Fritz Gerd Hans Ida"), (2, "how tall is the tower"), (3, "What do the seven small dwarfs eat tonight"), (4, "THE CAPITAL OF FRANCE IS THE CITY OF PARIS"), (5, None), (6, " ?")]
    docs = [(i, f"Some words before {x} and after it.") for i, x in items if x] + [(10, "What is 13 + 7 * 3 - 44 / 5 + 9 * 8?"), (11, "How tall is a tower"), (12, "the Capital of france is the city of Paris")]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} >= {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (12, 4)}
    assert {(r.doc_id, r.item_id) for r in found.collect() if r.doc_id in (6, 11)} == set()


_UNITS = "|".join(decontamination.UNITS)


def _tokens(text):
    """(template, word) of every token: names, numbers and units are placeholders."""
    clean = re.sub(r"[^\w \x01]+|_", "", re.sub(r"[\t\r\f\v]", " ", re.sub(r"(?<=[.!?:]) |\n", " \x01", "\x01" + (text or ""))))
    clean = re.sub(rf"(?<=\d)(?=(?:{_UNITS})(?: |$))", " ", clean, flags=re.I)
    out = []
    for raw in clean.split(" "):
        word, head = raw.replace("\x01", ""), raw.startswith("\x01")
        if not word:
            continue
        if word[0].isdigit() or word.lower() in decontamination.NUMBERS:
            kind = "<n>"
        elif word[0].isupper() and not (head and word.lower() in decontamination.STARTERS):
            kind = "<p>"
        else:
            kind = "<u>" if out and not head and out[-1][0] == "<n>" and re.fullmatch(_UNITS, word, re.I) else word.lower()
        out.append((kind, word))
    return out


def _runs(tokens, size, column):
    """Where each run of so many tokens stands; words in lower case, or templates."""
    out = {}
    for i in range(len(tokens) - size + 1):
        said = [x[1].lower() if column else x[0] for x in tokens[i : i + size]]
        if said and said[0] == "<u>":  # the number before it is not in the window
            said[0] = tokens[i][1].lower()
        out.setdefault(tuple(said), []).append(i)
    return out


def _leaked(text, items, known={}):  # noqa: B006
    """The items that a text holds: all places of all of an item's windows, by offset."""
    doc, found = _tokens(text), set()
    words = {n: _runs(doc, n, 1) for n in range(1, 9)}
    templates = {n: _runs(doc, n, 0) for n in range(1, 9)}
    for item_id, item in items:
        if item not in known:
            own = _tokens(item)
            size = min(8, len(own))
            able = {k: v for k, v in _runs(own, size, 0).items() if size and len({x for x in k if not x.startswith("<")}) >= 2}
            known[item] = own, size, _runs(own, size, 1) if size else {}, able
        own, size, exact, able = known[item]
        groups = {}
        for kind, windows, places in ((0, exact, words.get(size, {})), (1, able, templates.get(size, {}))):
            for window, own_places in windows.items():
                strong = kind == 0 or len({x for x in window if not x.startswith("<")}) >= 4
                for i in own_places:
                    for j in places.get(window, []):
                        group = groups.setdefault(j - i, (set(), set(), set(), set()))
                        group[kind if strong else 2].add(i)
                        if kind:
                            group[3].update((own[i + k][0], own[i + k][1], doc[j + k][1]) for k in range(size) if window[k].startswith("<"))
        n = len(own) - size + 1
        n_able = sum(len(v) for k, v in able.items() if len({x for x in k if not x.startswith("<")}) >= 4)
        for in_exact, in_able, in_weak, slots in groups.values():
            fixed = {x for x in slots if x[0] != "<n>"}
            consistent = len(slots) == len({x[:2] for x in slots}) and len(fixed) == len({(k, d) for k, _, d in fixed}) or len(in_exact) == n
            held = n if len(in_exact | in_able | in_weak) == n else len(in_exact | in_able)
            if consistent and (held >= 6 or 2 * held >= n or (n_able and 2 * len(in_able) >= n_able)):
                found.add(item_id)
    return found


ASKED = [
    (0, "Tom has 5 apples and gives 3 away."), (1, "A car drives 60 km in one hour and 90 km in the next."), (2, "If twelve men dig a hole in 5 days, how long do they need?"), (3, "Anna and Tom have 5 pears and Tom eats them."),
    (4, "Tom ran 5 km in 30 minutes today"), (5, "the"), (6, "What is 12 + 7 * 3 - 44 / 5 + 9 * 8 - 6?"),
]
POSED = [
    (10, "Anna has 7 apples and gives 2 away."), (11, "A car drives 70km in two hours and 80km in the next. A car drives 70km in one hour and 80km in the next."), (12, "So. If fifteen men dig a hole in 9 days, how long do they need?"), (13, "Carl and Carl have 7 pears and Carl eats them."),
    (14, "Emil and Fritz have nine pears and Fritz eats them."), (15, "Emil and Fritz have 5 pears and Emil eats them."), (16, "Ida ran 9 miles in 40 minutes today"), (17, "Ida ran 9 miles in 40 minutes once"), (18, "The one and the other. " * 50), (19, "5 5 5 5 5 5 5 5 5 5 is 5"), (20, "Anna has 7 apples and gives 7 away."),
]


def test_changed_items(spark):
    """Names at the start of a sentence, numbers in words, units at their number, slots from both sides."""
    docs, items = spark.createDataFrame(POSED, "doc_id long, text string"), spark.createDataFrame(ASKED, "item_id long, text string")
    found = decontamination.contaminated(docs, items).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(found) == len(got) == len({(d, i) for d, t in POSED for i in _leaked(t, ASKED)}) and got == {(d, i) for d, t in POSED for i in _leaked(t, ASKED)}
    assert got == {(10, 0), (20, 0), (11, 1), (11, 5), (12, 2), (14, 3), (16, 4), (18, 5)}


def test_the_benchmark_need_not_be_broadcast(spark, monkeypatch):
    docs, items = spark.createDataFrame(POSED, "doc_id long, text string"), spark.createDataFrame(ASKED, "item_id long, text string")
    want = sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == want


def test_templates_by_brute_force(spark, texts, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    changed = [(10_000 + i, f"Before it. {re.sub('[0-9]+', lambda m: str(int(m[0]) + 7), x)} After it.") for i, x in items]
    mixed = [(20_000 + i, re.sub(r"(?<= )[A-Z][a-z]+", "Zora", x)) for i, x in items]
    halves = [(30_000 + i, " ".join(x.split()[: len(x.split()) * 2 // 3]) + " and so on") for i, x in items]
    short = [(900, "how tall is the tower"), (902, "What is the capital city of France?"), (901, "Anna Bob Carl Dora Emil Fritz Gerd Hans Ida")]
    docs = [*texts[:60], *changed, *mixed, *halves, (40_000, "So how tall is the Tower, Anna?"), (40_002, "What is the capital city of Spain? Yes"), (40_003, "What is the main city of Spain?"), (40_001, "anna bob Carl Dora Emil Fritz gerd hans ida")]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + short, "item_id long, text string"))
    want = {(d, i) for d, t in docs for i in _leaked(t, items + short)}
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and {d // 10_000 for d, _ in want} >= {1, 4}
    assert (40_002, 902) in want and not any(d == 40_003 for d, _ in want)


def test_leaks_are_found(spark, sf_dir, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op3_benchmark_decontamination"](spark, sf_dir).collect()}
    assert got == {(d, i) for d, t in texts for i, x in items if x in t}


def test_pieces_equal_the_library_without_dropout(spark, sf_dir, texts):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = {r.doc_id: r.ids for r in pieces.encoded(docs, dropout=0).collect()}
    assert plain == {d: own.encode(t) for d, t in texts}
    varied = pieces.encoded(docs)
    got = {r.doc_id: r.ids for r in varied.collect()}
    assert got == {r.doc_id: r.ids for r in varied.collect()} and sum(got[d] != plain[d] for d in got) > len(got) / 2
    assert {r.doc_id: r.text for r in pieces.decoded(varied).collect()} == dict(texts)


def test_every_occurrence_is_drawn_for_itself(spark):
    docs = spark.createDataFrame([(d, " ".join(["international"] * 500)) for d in range(20)], "doc_id long, text string").repartition(1)
    v = pieces._vocabulary(pieces.MODEL)
    cuts = Counter()
    for r in pieces.encoded(docs).collect():
        assert r.lossless
        cuts.update("|".join(v.spelling[v.spelling_off[i] : v.spelling_off[i + 1]].tobytes().decode() for i in r.ids).split("| "))
    assert len(cuts) > 20


def test_shared_work_does_not_change_the_pieces(monkeypatch):
    agenda = pieces.Agenda(pieces._vocabulary(pieces.MODEL), 0.1, 7)
    monkeypatch.setattr(pieces, "DRAWN_WORDS", 1000)
    texts = [t.encode() for _, t, *_ in ODD if t] + [("x" * 90 + " internationalisation of  tokens\n日本 ").encode() * 300]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf, keys = np.frombuffer(b"".join(texts), np.uint8), np.arange(len(texts))
    shared = agenda.encode(buf, off, keys, pieces.Powers())
    monkeypatch.setattr(agenda, "groups", lambda names, own, *_: own)  # every occurrence by itself
    alone = agenda.encode(buf, off, keys, pieces.Powers())
    assert all(np.array_equal(a, b) for a, b in zip(shared, alone, strict=True))


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    for name, label, least in (("op1_quality_discriminant", "quality", 0.97), ("op2_weak_toxicity", "toxic", 0.95)):
        rows = queries.QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
        right, n = rows.selectExpr(f"sum(int(predicted = {label}))", "count(*)").first()
        assert right / n > least
        row = rows.first()
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)


def _statistics(text):
    w, raw = WORD.findall(text), text.encode()
    n, chars = max(1, len(w)), sum(map(len, w))
    share = lambda x, of: np.arcsin(np.sqrt(min(1, x / of)))
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
    size = [len(x.encode()) for x in w]
    return [
        np.log1p(len(w)), np.log1p(chars / n), share(len(re.findall(r"[#*$%&|<>]", text)), max(1, chars)), share(upper, max(1, upper + lower)),
        share(sum(x[-1] == "!" for x in w), n), share(sum(x[0] == "|" for x in w), n), share(len(lines) - len(set(lines)), max(1, len(lines))), share(len(again), n),
        share(max(Counter(w).values(), default=0), n), np.log1p(len(set(w))) - np.log1p(len(w)), share(sum(b >= 128 or chr(b).isalpha() for b in raw), max(1, len(raw))),
        share(sum(x[-1] in ".," for x in w), n), np.log1p(len(w) / max(1, len(lines))), share(sum(a == b for a, b in zip(w, w[1:])), n), share(sum(x <= 3 for x in size), n), share(sum("A" <= x[0] <= "Z" for x in w), n),
    ]


def test_quality_by_brute_force(spark, sf_dir, texts):
    """All statistics in plain Python, densities by inverse and determinant."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    x = {d: np.array(_statistics(t)) for d, t in texts}
    rows = {k: np.array([x[d] for d in x if labels.get(d) == k and zlib.crc32(str(d).encode()) % 4 != 2]) for k in (0, 1)}
    covariance = {k: np.cov(r, rowvar=False, bias=True) for k, r in rows.items()}
    pooled = sum(len(rows[k]) * covariance[k] for k in rows) / sum(map(len, rows.values()))
    log = {}
    for k, r in rows.items():
        own = (1 - quality.TO_POOLED) * len(r) / (len(r) + 32)
        c = (1 - quality.TO_SPHERE) * (own * covariance[k] + (1 - own) * pooled) + quality.TO_SPHERE * np.diag(np.maximum(np.diag(pooled), 1e-4))
        log[k] = {d: np.log(len(r)) - 0.5 * ((v - r.mean(0)) @ np.linalg.inv(c) @ (v - r.mean(0)) + np.linalg.slogdet(c)[1]) for d, v in x.items()}
    want = {d: 1 / (1 + np.exp(-np.clip((log[1][d] - log[0][d]) / quality.TEMPERATURE, -500, 500))) for d in x}
    got = {r.doc_id: r.score for r in queries.QUERIES["op1_quality_discriminant"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-6) for d in want)


def test_label_model_finds_accuracies_and_correlations():
    draw = np.random.default_rng(1)
    n = 20_000
    y = draw.random(n) < 0.15
    hit, slip = np.array([0.9, 0.7, 0.5, 0.3, 0.05]), np.array([0.01, 0.02, 0.01, 0.05, 0.05])
    votes = draw.random((n, 5)) < np.where(y[:, None], hit, slip)
    votes = np.column_stack([votes, votes[:, 2] ^ (draw.random(n) < 0.02)])  # the last repeats the third
    q, found = toxicity.label_model(votes, np.arange(4))
    want = (votes == y[:, None]).mean(0)
    assert np.abs(found["accuracy"] - want).max() < 0.04
    assert found["correlation"][2, 5] > 0.5 > np.abs(found["correlation"][0, 1:5]).max()
    assert ((q > 0.5) == y).mean() > 0.97


def _features(text):
    """Features of a text: words, five-letter beginnings, dense beginnings of three to six letters."""
    def named(letters, size=None, kind=0):
        b = np.frombuffer(letters.encode(), np.uint8)
        h = toxicity.span_hashes(b, np.array([0]), np.array([len(b)]), toxicity.Powers())
        return int(toxicity._named(h if size is None else toxicity.mixed(h ^ np.uint64(size)), kind)[0])

    words = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    out = {named(x) for x in words} | {named(x[:5], 5, 1) for x in words if len(x) > 5}
    for size in toxicity.STEMS:
        heads = Counter(x[:size] for x in words if len(x) > size)
        out |= {named(h, size, 2) for h, n in heads.items() if n >= 2 and toxicity.DENSE * n >= len(words)}
    return out


def test_toxicity_is_fitted_in_a_task(spark, sf_dir, monkeypatch):
    """The driver gets the model alone, not the features of the sample; without rows too."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    sent, to_arrow = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: sent.append(to_arrow(self)) or sent[-1])
    model = toxicity.trained(docs, labels)
    assert [x.num_rows for x in sent] == [1] and len(sent[0]["features"][0]) == len(model.features) and model.correlation.shape == (len(model.voters),) * 2
    assert len(toxicity.trained(docs.where("false"), labels).features) and not toxicity.trained(docs.where("false"), labels).voters


def test_toxicity_by_brute_force(spark, sf_dir, texts):
    """Scores from features that plain Python finds; voters, weights and folds are those of the model."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.trained(docs, labels)
    again = toxicity.trained(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model.features, again.features) and np.allclose(model.weights, again.weights)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    want = {d: 1 / (1 + np.exp(-model.bias - sum(weight.get(f, 0) for f in _features(t)))) for d, t in texts}
    got = {r.doc_id: r.score for r in queries.QUERIES["op2_weak_toxicity"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-6) for d in want)
    assert {"lexicon english", "words of fold 0", "shouting"} <= model.voters.keys() and model.correlation.shape == (len(model.voters),) * 2


def test_toxicity_learns_from_unlabelled_rows(spark):
    """A word that stands only in unlabelled texts beside known insults gets a weight; held-out rows teach nothing."""
    def held(i):
        return zlib.crc32(str(i).encode()) % 4 == 2

    free, taken = [i for i in range(4000) if not held(i)], [i for i in range(4000) if held(i)]
    toxic = "you idiot and moron, zarkon"
    rows = [(i, f"{toxic} w{i}x q{i}y" if n % 5 == 0 else f"a plain text of the day w{i}x q{i}y") for n, i in enumerate(free[:600])]
    rows += [(i, f"you idiot and moron, veltruk w{i}x") for i in taken[:300]]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert weight[next(iter(_features("zarkon") - _features("zarkox")))] > 0.1
    assert not any(f in weight for f in _features("veltruk"))


def test_cascade_order_does_not_change_the_verdict(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = {r.doc_id: r.kept for r in rules.filtered(docs).collect()}
    monkeypatch.setattr(rules, "ordered", lambda figures: list(reversed(list(rules.RULES))))
    assert one == {r.doc_id: r.kept for r in rules.filtered(docs).collect()}
    monkeypatch.undo()
    assert rules.ordered([("symbols", 1.0, 0.5), ("capitals", 0.1, 0.1), ("one_word", 0.1, 0.0)])[:2] == ["capitals", "symbols"]


def test_pipeline(spark, sf_dir, texts):
    """Every stage against brute force on its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    held = {"documents": {r.doc_id: r for r in docs.collect()}}
    stage, before = docs, "documents"
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = lineage.written(function(spark, stage, sf_dir), "stage")
        assert stage.columns == docs.columns, name
        held[name] = {r.doc_id: r for r in stage.collect()}
        if name != "line dedup":
            assert all(held[before][d] == r for d, r in held[name].items())
        before = name
    first, second, third, last = (name for name, _ in corpus_pipeline.STAGES[:-1])
    toxic = {r.doc_id for r in toxicity.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert held[first].keys() == held["documents"].keys() - toxic and toxic
    lined = {d: t for (d, _), (t, _) in _lined([(d, r.text) for d, r in held[first].items()]).items()}
    assert {d: r.text for d, r in held[second].items()} == lined and all(r.n_chars == len(r.text) for r in held[second].values())
    prints = {d: _fingerprint(r.text) for d, r in held[second].items()}
    roots = _roots(prints)
    assert held[third].keys() == set(roots.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert held[last].keys() == {d for d, r in held[third].items() if not _leaked(r.text, items)}
    assert rows.keys() == held[last].keys() and all(r.lossless for r in rows.values())
    decoded = {r.doc_id: r.text for r in pieces.decoded(corpus_pipeline.STAGES[-1][1](spark, stage, sf_dir)).collect()}
    assert decoded == {d: r.text for d, r in held[last].items()}


def test_pipeline_stages_keep_odd_rows_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    names = ["n_lines", "n_removed", "n_runs", "longest_run", "score", "predicted", "doc", "text_hash", "print", "root", "row", "hit", "gone"]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    odd = spark.createDataFrame([(d, t, None, None, len(t or ""), *[f"own {n}" for n in names]) for d, t, *_ in ODD], schema)
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "what is the name of the tallest tower of all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, odd.limit(0)):
        for name, function in corpus_pipeline.STAGES[:-1]:
            kept = function(spark, docs, str(tmp_path))
            assert kept.columns == docs.columns, name
            found = kept.collect()
            assert all([r[n] for n in names] == [f"own {n}" for n in names] for r in found), name
            assert name in ("SimHash near-dedup",) or len(found) == docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
