"""Stateful streams in several micro-batches against batch results, and page geometry against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone import catalog
from quillstone.functions.text import term_rows
from quillstone.operators import geometry, retrieval
from quillstone.plans import states
from quillstone.streaming import feeds, limits
from quillstone.streaming.index import Index
from quillstone.streaming.ingestion import Store, queue_of


def _in_batches(spark, folder, rows, schema, cuts):
    """The rows as a stream of files, one for each cut, read one file at a time."""
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows")


def test_counters_in_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    draw = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = sorted((draw.choice("abc"), i, start + timedelta(seconds=draw.randrange(4000))) for i in range(300))
    rows.sort(key=lambda r: (r[2], r[1]))
    stream = _in_batches(spark, tmp_path, rows, "key string, event_id long, ts timestamp", [0, 80, 81, 200, 300])
    got = {(r.key, r.event_id): r.n for r in feeds.drained(limits.counted(stream, 90, "10 minutes"), "append", "counters").collect()}
    want, open_until = {}, {}
    for key, event, ts in rows:
        ends, n = open_until.get(key, (None, 0))
        ends, n = (ts + timedelta(seconds=90), 1) if ends is None or ends <= ts else (ends, n + 1)
        open_until[key] = ends, n
        want[key, event] = n
    assert got == want and max(got.values()) > 2

    seen = Counter()
    clients = [({"a": 1, "b": 2, "c": 3}[k], e, t) for k, e, t in rows]
    stream = _in_batches(spark, tmp_path / "more", clients, "client long, event_id long, ts timestamp", [0, 100, 300])
    got = {r.event_id: (r.n, r.accepted) for r in feeds.drained(limits.limited(stream, 3, 60, 90, "10 minutes"), "append", "limits").collect()}
    for client, event, ts in clients:
        window = client, int((ts - start).total_seconds()) // 60
        seen[window] += 1
        assert got[event] == (seen[window], seen[window] <= 3)


def test_counters_of_many_keys(spark, tmp_path):
    """A batch's keys are read and written by the group, not one by one; keys of a group don't meet, and ended counters go."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(None if k == 7 else f"k{k}", 1000 * i + k, start + timedelta(seconds=i * 40)) for i in range(9) for k in range(200)]
    stream = _in_batches(spark, tmp_path, rows, "key string, event_id long, ts timestamp", [0, 400, 1000, 1800])
    query = limits.counted(stream, 90, "10 seconds", groups=4).writeStream.outputMode("append").format("memory").queryName("many_keys").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.key, r.event_id): r.n for r in spark.table("many_keys").collect()}
    assert got == {(key, event): event // 1000 % 3 + 1 for key, event, _ in rows}  # of events 40 s apart a counter of 90 s takes three
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held and 0 < max(held) <= 4 * 7  # a group's state, and its timers


def test_index_after_three_batches(spark, sf_dir, monkeypatch):
    """Equal to an index built at once; old texts are not read; a batch may run twice; searches agree."""
    parts = states._changes(spark, sf_dir)
    index = states.index_of(spark, parts)
    final = {}
    for part in parts:
        final |= {r.doc_id: r.text for r in part.collect()}
    whole = spark.createDataFrame([(d, 1, t) for d, t in final.items() if t is not None], "doc_id long, version long, text string")
    once = states.index_of(spark, [whole])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.counts()) == rows(once.counts()) and index.signature() == once.signature()
    assert rows(index.postings()) == rows(once.postings()) and rows(index.documents().drop("batch")) == rows(once.documents().drop("batch"))
    assert rows(index.postings().groupBy("term").agg(F.count("*"))) == rows(index.counts())
    again = Index(spark, index.path)
    again.apply(parts[2], 2000)
    assert rows(again.counts()) == rows(once.counts()) and index.documents().where("batch = 1000").count() > 0
    asked = term_rows(spark.createDataFrame([(1, whole.first().text[:300])], "query_id long, text string"), "query_id", "text").distinct()
    found = {(r.query_id, r.doc_id): r.score for r in index.scores(asked, 1.5, 0.75, 0.25).collect()}
    texts, question = whole.select(F.col("doc_id").alias("id"), "text"), asked.groupBy("query_id").agg(F.array_join(F.collect_list("term"), " ").alias("text"))
    want = {(r.query_id, r.id): r.score for r in retrieval.bm25_scores(texts, question).collect()}
    assert {k: round(v, 4) for k, v in found.items() if v > 0} == {k: pytest.approx(round(v, 4), abs=2e-4) for k, v in want.items()}


def test_postings_are_counted_in_place(spark, sf_dir):
    """A text's terms are counted where it is, without a table of all pairs in a task's memory."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text").where("id is not null")
    texts = texts.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "FY24 fy2024 the 3.5 sales sale")], "id long, text string"))
    found = retrieval.text_postings(texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in retrieval.postings(texts).collect()}


def test_ingestion(spark, tmp_path):
    schema = "document_id string, name string, company string, place long, text string"
    table = "# Balance Sheet\n\nParticulars   FY2025   FY2024\nTotal assets   5   6\nTotal equity   3   4\n"
    body = "This paragraph explains the accounting treatment in enough words to be kept as a passage for retrieval."
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    store = Store(spark, str(tmp_path / "store"))
    assert store.states().count() == 0 == store.passages().count()
    first = frame(("a", "a.md", "Acme Ltd.", 1, table), ("b", "b.txt", "Acme Limited", 2, body), ("c", "c.pdf", "Other", 3, body), ("d", "d.txt", None, 4, " "), ("e", "e.txt", "Last", 5, "Too short to be kept."), ("a", "a.md", "Acme Ltd.", 0, "older"))
    store.take(first, 0)
    held = {r.document_id: (r.state, r.code, r.n_passages, r.n_facts) for r in store.states().collect()}
    assert held == {"a": ("ready", None, 1, 4), "b": ("ready", None, 1, 0), "c": ("failed", "unsupported_format", 0, 0), "d": ("failed", "empty_document", 0, 0), "e": ("failed", "no_content", 0, 0)}
    assert {r.document_id for r in store.passages().collect()} == {"a", "b"} and store.facts().count() == 4
    assert {(r.document_id, r.code) for r in store.dead_letters().collect()} == {(d, c) for d, (s, c, *_) in held.items() if s == "failed"}
    assert [(r.key, r.name, r.aliases) for r in store.companies().collect()] == [("acme", "Acme Ltd.", ["Acme Limited"])]
    # A new version replaces the old as a whole; a failing one leaves no rows; the same batch again changes nothing.
    second = frame(("a", "a.md", "ACME PLC", 1, table.replace("5   6", "7   8")), ("b", "b.txt", "New Co", 2, ""))
    for _ in range(2):
        store.take(second, 1)
        assert {r.value for r in store.facts().collect()} == {7.0, 8.0, 3.0, 4.0} and {r.document_id for r in store.passages().collect()} == {"a"}
        assert {r.document_id: r.state for r in store.states().collect()} == {"a": "ready", "b": "failed", "c": "failed", "d": "failed", "e": "failed"}
        assert [(r.key, r.name, r.aliases) for r in store.companies().collect()] == [("acme", "Acme Ltd.", ["Acme Limited", "ACME PLC"])]

    def broken(_):
        raise RuntimeError("facts")

    with pytest.raises(RuntimeError):
        store.take(frame(("a", "a.md", "Acme", 1, table), ("f", "f.txt", "F", 2, body)), 2, broken)
    assert {r.document_id: r.state for r in store.states().where("document_id in ('a', 'f')").collect()} == {"a": "processing", "f": "processing"} and store.passages().count() == 0
    arrived = spark.createDataFrame([("f", 1), ("g", 1)], "document_id string, place long")
    assert {r.document_id: r.state for r in queue_of(store.states(), arrived).collect()} == {"f": "processing", "g": "queued"}
    store.recover(2)
    assert {r.document_id for r in store.dead_letters().where("code = 'interrupted'").collect()} == {"a", "f"}
    store.take(frame(("a", "a.md", "Acme", 1, table)), 3)
    assert {r.document_id for r in store.passages().collect()} == {"a"} and store.facts().count() == 4


def test_arrivals_are_read_once(spark, tmp_path):
    """A batch's texts pass once, however many segments it writes; what it held of them is gone at its end."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    body = "This paragraph explains the accounting treatment in enough words to be kept as a passage for retrieval."
    rows = [(str(k), f"{k}.{'pdf' if k % 3 == 0 else 'txt'}", "Acme", k, "\u2028 \x85" if k % 5 == 0 else body) for k in range(20)]
    schema = "document_id string, name string, company string, place long, text string"
    store = Store(spark, str(tmp_path / "store"))
    store.take(spark.createDataFrame(rows, schema).mapInArrow(counted, schema), 0)
    assert read.value == len(rows) and not list((tmp_path / "store").glob("arrived/*"))
    want = {str(k): "unsupported_format" if k % 3 == 0 else "empty_document" if k % 5 == 0 else None for k in range(20)}
    assert {r.document_id: r.code for r in store.states().collect()} == want and store.passages().count() == sum(c is None for c in want.values())


SPAN = "document_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, width double, height double"


def _span(page, text, x0, y, wide=200.0, width=595.0, height=842.0):
    return ("d", page, text, float(x0), float(y), float(x0 + wide), y + 9.0, 8.5, False, width, height)


def test_columns(spark):
    """Spreads are split whatever they hold, columns only if both sides are prose; what crosses goes left."""
    rows = []
    for k in range(20):  # page 1: two tables side by side
        y = 60 + k * 12
        rows += [_span(1, t, x, y, w, 1191.0) for t, x, w in ((f"Left item {k}", 50, 150), ("1,234", 480, 40), (f"Right item {k}", 650, 150), ("5,678", 1080, 40))]
    for k in range(40):  # page 2: two columns on each side; page 4: two columns and headings across
        rows += [_span(2, "management believes the outlook remains positive", x, 60 + k * 11, 240, 1191.0) for x in (50, 320, 650, 920)]
        rows += [_span(4, "management believes the outlook remains positive", x, 60 + k * 11, 240) for x in (50, 320)]
    for k in range(30):  # page 3: a table
        rows += [_span(3, t, x, 60 + k * 12, w) for t, x, w in ((f"Line item {k}", 50, 180), ("1,234", 400, 40), ("987", 480, 30))]
    rows += [_span(4, f"A heading across {k}", 50, 600 + k * 20, 510) for k in range(6)] + [_span(5, "one", 50, 60), _span(6, "narrow", 304, 60, 2)]
    found = geometry.in_columns(spark.createDataFrame(rows, SPAN)).collect()
    columns = {p: Counter(r.column for r in found if r.page == p) for p in range(1, 7)}
    assert columns[1] == {0: 40, 1: 40} and columns[2] == dict.fromkeys(range(4), 40) and columns[3] == {0: 90} and columns[4] == {0: 46, 1: 40} and columns[5] == {0: 1} and columns[6] == {0: 1}
    assert all(r.x1 < 600 for r in found if r.page == 1 and r.column == 0) and all(r.column == 0 for r in found if r.text.startswith("A heading"))


def test_visual_rows_by_brute_force(spark, sf_dir):
    spans = geometry.in_columns(catalog.QUERIES["page_columns"].__globals__["page_spans"](spark, sf_dir))
    draw = random.Random(3)
    odd = [_span(p, f"w{i} ", draw.randrange(500), 60 + draw.random() * 120, draw.choice([5, 40])) for p in range(8) for i in range(60)] + [_span(9, " ", 1, 60)]
    spans = spans.drop("i").unionByName(geometry.in_columns(spark.createDataFrame(odd, SPAN)).withColumn("document_id", F.lit("odd")))
    pages = {}
    for r in spans.collect():
        pages.setdefault((r.document_id, r.page, r.column), []).append(r)
    want = set()
    for key, held in pages.items():
        groups = []
        for r in sorted(held, key=lambda r: ((r.y0 + r.y1) / 2, r.x0, r.x1, r.text)):
            mid = (r.y0 + r.y1) / 2
            if groups and abs(mid - sum((s.y0 + s.y1) / 2 for s in groups[-1]) / len(groups[-1])) <= max(2.5, 0.4 * r.size):
                groups[-1].append(r)
            else:
                groups.append([r])
        for g in groups:
            g.sort(key=lambda r: r.x0)
            text = ""
            for before, r in zip([None, *g], g, strict=False):
                if before is not None:
                    gap = r.x0 - before.x1
                    text += "   " if gap > 12 else " " if gap > 1 and not text.endswith(" ") else ""
                text += r.text
            if text.strip():
                want.add((*key, hashlib.md5(text.rstrip().encode()).hexdigest(), min(r.y0 for r in g), max(r.y1 for r in g)))
    got = {(r.document_id, r.page, r.column, hashlib.md5(r.text.encode()).hexdigest(), r.y0, r.y1) for r in geometry.visual_rows(spans).collect()}
    assert got == want and len(want) > 1000


def test_points_and_boxes(spark):
    draw = random.Random(9)
    point = lambda: (draw.choice("ab"), draw.randrange(3), "t", x := draw.uniform(-50, 900), y := draw.uniform(-50, 900), x + draw.choice([0, 7, 300]), y + draw.choice([0, 9]))  # noqa: E731, F821
    spans = [point() for _ in range(400)] + [("a", 0, "edge", 100.0, 100.0, 100.0, 100.0)]
    boxes = [("a", 0, 100.0, 100.0, 164.0, 128.0), ("b", 1, -300.0, -300.0, 2000.0, 450.0), ("a", 1, 5.0, 5.0, 4.0, 9.0)] + [(draw.choice("ab"), draw.randrange(3), x := draw.uniform(0, 700), y := draw.uniform(0, 700), x + draw.uniform(0, 200), y + draw.uniform(0, 200)) for _ in range(12)]
    df = geometry.outside(spark.createDataFrame(spans, "document_id string, page int, text string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(boxes, "document_id string, page int, x0 double, y0 double, x1 double, y1 double"))
    inside = lambda s: any(b[:2] == s[:2] and b[2] <= (s[3] + s[5]) / 2 <= b[4] and b[3] <= (s[4] + s[6]) / 2 <= b[5] for b in boxes)
    assert sorted(map(tuple, df.collect())) == sorted(s for s in spans if not inside(s)) and sum(map(inside, spans)) > 40
    assert "Cartesian" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_margins_sizes_and_rules(spark):
    lines = [("d", p, text, y, y + 9.0, 800.0) for p in range(1, 6) for text, y in ((f"Annual Report {p}", 10.0), ("Only here" if p == 2 else f"Body {p}", 400.0), (f"Page {p} of 5", 780.0), ("Rare" if p < 3 else f"Own {'x' * p}", 20.0))]
    kept = geometry.without_running_lines(spark.createDataFrame(lines, "document_id string, page int, text string, y0 double, y1 double, height double")).collect()
    assert {r.text for r in kept} == {"Body 1", "Only here", "Body 3", "Body 4", "Body 5", "Rare", "Own xxx", "Own xxxx", "Own xxxxx"}
    votes = [("a", "x" * 45, 9.0), ("a", "x", 12.0), ("a", "y", 14.0), ("a", "z", 20.0), ("b", "x", 8.0), ("b", "x" * 39, 10.0), ("c", "", 7.5)]
    sizes = geometry.body_sizes(spark.createDataFrame(votes, "document_id string, text string, size double")).collect()
    assert {r.document_id: r.body_size for r in sizes} == {"a": 12.0, "b": 9.0, "c": 7.5}
    ruled = [("d", 1, 50.0, 100.0 + 30 * k, 500.0, 101.0 + 30 * k) for k in range(4)] + [("d", 1, 50.0 + 60 * k, 100.0, 51.0 + 60 * k, 200.0) for k in range(3)] + [("d", 2, 50.0, 100.0, 90.0, 130.0), ("d", 2, 150.0, 200.0, 190.0, 230.0)] + [("d", 3, 50.0, 100.0 + k, 500.0, 100.0 + k) for k in range(9)]
    words = [("d", p, str(k)) for p in (1, 2, 3) for k in range(8)]
    found = geometry.ruled_pages(spark.createDataFrame(ruled, "document_id string, page int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(words, "document_id string, page int, text string"))
    assert {r.page for r in found.collect()} == {1, 2}


def test_answer_scores_of_short_turns(spark, tmp_path):
    """A figure such as 1,250 is two terms, so a turn of one term makes a statement with it."""
    import duckdb

    from quillstone.plans import evidence

    said = ["That the atorea on.", "Oneahe inshth thion.", "Of the.", "Bleha thonan.", "Ingeseu", "Ening eas bleand thor."]
    spark.createDataFrame([(1, i, "user", x) for i, x in enumerate(said)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.turn: r.faithfulness for r in evidence.answer_scores(spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = {r[1]: r[2] for r in c.execute(evidence.ORACLE_SQL["answer_scores"]).fetchall()}
    assert found == want and found[1] == 0.5 and found[3] == 0.0


def test_pages_are_dealt_into_tasks_and_read_once(spark, sf_dir, monkeypatch):
    """Sorts of a page's spans are cut by the given number of tasks, which Spark doesn't merge; headings make their lines once."""
    spans = spark.createDataFrame([("d", p, f"w{i}", 50.0, 40.0 + 12 * i, 90.0, 49.0 + 12 * i, 9.0, False, 595.0, 842.0) for p in range(40) for i in range(3)], "document_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, width double, height double")
    found = geometry.visual_rows(geometry.in_columns(spans, 7), 7)
    assert found.count() == 120 and found.rdd.getNumPartitions() == 7
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in geometry.visual_rows(geometry.in_columns(spans)).collect()}

    made, fold = spark.sparkContext.accumulator(0), geometry._clustered

    def counted(batches):
        for batch in fold(batches):
            made.add(batch.num_rows)
            yield batch

    lines = catalog.QUERIES["page_lines"](spark, sf_dir).count()
    monkeypatch.setattr(geometry, "_clustered", counted)
    assert catalog.QUERIES["page_headings"](spark, sf_dir).count() > 0 and made.value == lines
