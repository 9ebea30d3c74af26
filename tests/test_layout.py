"""Readers, lines, text tables, sections and statements: literal cases and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone import catalog
from quillstone.functions import labels, lines
from quillstone.functions import text as t
from quillstone.operators import sections, statements, texttables
from quillstone.operators.elements import classed, elements
from tests.test_reference_cases import given

NUMBERS = [
    ("1,234.50", 1234.5), ("(1,730)", -1730.0), ("-45", -45.0), ("₹ 2,500", 2500.0), ("1,23,456", 123456.0), ("$3.30", 3.3), ("0.5", 0.5), ("", None), ("-", None), ("nil", None), ("12.5%", None), ("N/A", None), ("abc", None), ("12a", None), (None, None),
    ("H17,265", 17265.0), ("H (0.04)", -0.04), ("`250", 250.0), ("H", None), ("HDFC", None), ("US$ 5", 5.0), (".5", 0.5), ("H 1,200", 1200.0), ("Rs. 5", 5.0), ("Rs.5", 5.0), ("− 7", -7.0), ("  9\t", 9.0), ("+5", None), ("1.2.3", None),
]

CAPTIONS = [
    ("(INR in crore, except per share data)", "crore", 1e7, "INR"), ("Amounts in USD millions", "million", 1e6, "USD"), ("₹ in lakhs", "lakh", 1e5, "INR"), ("no unit here", None, 1.0, ""), ("USD in millions", "million", 1e6, "USD"), ("Revenue grew strongly", None, 1.0, ""),
    ("(All amounts in H crores, unless otherwise stated)", "crore", 1e7, "INR"), ("Hindustan Unilever reported growth", None, 1.0, ""), ("₹ mn", "million", 1e6, "INR"), ("Rs. cr", "crore", 1e7, "INR"), ("(₹ in lacs)", "lakh", 1e5, "INR"), ("$ '000", "thousand", 1e3, "USD"),
    ("a million customers", None, 1.0, ""), ("'000s of €", "thousand", 1e3, "EUR"), ("£ bn", "billion", 1e9, "GBP"), ("5 pounds of tea", None, 1.0, ""), ("euros and US dollars", None, 1.0, "EUR"),
]

LABELS = [
    ("PROFIT FOR THE YEAR (C=A+B)", "net_income"), ("TOTAL ASSETS (A+B)", "total_assets"), ("Total - Equity (A)", "equity"), ("Total - Current liabilities (C)", "current_liabilities"), ("Net cash flows generated from operating activities - [A]", "cfo"),
    ("Net cash flows (used in) / generated from investing activities - [B]", "cfi"), ("Net cash flows used in financing activities - [C]", "cff"), ("Net cash from/ (used in) operating activities", "cfo"), ("Profit/ (Loss) for the year", "net_income"),
    ("PROFIT FOR THE YEAR FROM CONTINUING OPERATIONS (A)", None), ("Purchase of property, plant and equipment and intangible assets", "capex"), ("Payment for purchase of property, plant and equipment", "capex"), ("Net cash inflow from operating activities", "cfo"),
    ("Net cash generated from operations", "cfo"), ("Net cash provided by financing activities", "cff"),
]


def test_numbers(spark):
    assert [(x, r["v"]) for (x, _), r in zip(NUMBERS, given(spark, [x for x, _ in NUMBERS], v=t.parsed_number), strict=True)] == NUMBERS
    cells = ["1,2", "-", "--", "nil", "N.A.", "n/a", "12%", "%", "", " ", "x", "(3)%", None]
    assert [r["f"] for r in given(spark, cells, f=t.is_figure)] == [True, True, True, True, True, True, True, False, False, False, False, True, None]


def test_units_and_currencies(spark):
    found = given(spark, [c for c, *_ in CAPTIONS], u=t.unit, s=t.unit_scale, c=t.currency)
    assert [(r["u"] and r["u"]["name"], r["s"], r["c"]) for r in found] == [tuple(rest) for _, *rest in CAPTIONS]


def test_labels(spark):
    found = given(spark, [x for x, _ in LABELS], m=lambda x: labels.matched(labels.normalized(x)))
    assert [(x, r["m"] and r["m"]["metric"]) for (x, _), r in zip(LABELS, found, strict=True)] == LABELS


def test_lines(spark):
    said = [
        "Revenue from operations   10,600   9,400", "Finance costs 21 (240) (170)", "This sentence has no figures at the end.", "12,500 10,000", "| a row | 5 | - |", "Growth nil", "A label, 5", "  (395)    (78)", "nil", "- 5 nil", "x " * 15 + "5", "Ends with stop. 5",
    ]
    found = given(spark, said, r=lines.row, v=lines.values)
    rows = [r["r"] and (r["r"]["label"], r["r"]["figures"]) for r in found]
    assert rows == [
        ("Revenue from operations", ["10,600", "9,400"]), ("Finance costs", ["21", "(240)", "(170)"]), None, None, ("a row", ["5", "-"]), ("Growth", ["nil"]), None, None, None, None, None, None,
    ]
    assert [r["v"] for r in found] == [None, None, None, ["12,500", "10,000"], None, None, None, ["(395)", "(78)"], None, ["-", "5", "nil"], None, None]
    heads = ["Particulars   FY2025   FY2024", "Year ended March 31, 2025   Year ended March 31, 2024", "Revenue grew strongly in FY2025 compared with FY2024", "Particulars   Note", "As at    As at", "Year ended    Year ended", "Risk Factors", "Quarter ended June 30, 2025 Q1 FY24", None]
    found = given(spark, heads, h=lines.is_header, p=lines.is_header_part, n=lines.header_periods)
    assert [bool(r["h"]) for r in found] == [True, True, False, False, False, False, False, True, False]
    assert [bool(r["p"]) for r in found] == [True, True, False, True, True, True, False, True, False]
    assert found[7]["n"] == ["Interim Jun 2025", "Q1 FY2024"] and found[1]["n"] == ["FY2025", "FY2024"]


HEADINGS = [
    ("Particulars   Note", 8.0, True, 0, 0), ("Risk Factors", 8.0, True, 0, 2), ("Risk Factors", 8.5, False, 0, 2), ("Some words here", 8.5, False, 0, 0), ("Some words here", 10.0, False, 0, 2), ("Some words here", 12.0, False, 0, 1), ("Ends with a stop.", 12.0, True, 0, 0),
    ("ALL CAPITAL WORDS", 8.5, False, 0, 2), ("• an item", 8.5, False, 0, 0), ("• an item", 12.0, False, 0, 1), ("Total assets 5 6", 12.0, True, 0, 0), ("ab", 12.0, True, 0, 0), ("anything at all.", 8.5, False, 2, 2), ("1. Outlook", 8.5, False, 0, 2), ("x " * 15, 12.0, True, 0, 0),
]


def test_headings(spark):
    df = spark.createDataFrame([(i, *h) for i, h in enumerate(HEADINGS)], "i int, text string, size double, bold boolean, forced int, want int")
    got = lines.with_levels(df, F.lit(8.5), F.col("forced")).orderBy("i").collect()
    assert [(r.text, r.level) for r in got] == [(r.text, r.want) for r in got]


def _filled(taken):
    """Rows with figures among the classes of a run's lines."""
    return taken.count("R") + sum(b == "V" and a in "SW" for a, b in zip(taken, taken[1:], strict=False))


def _naive(codes, figures):
    """(start, end, rows): from every line on, the longest run of which each line may follow those before it."""
    out, start = [], 0
    while start < len(codes):
        end = start
        while end < len(codes):
            taken, c = codes[start:end], codes[end]
            labels = len(taken) - len(taken.rstrip("SW"))
            label = c == "S" or c == "W" and figures[end + 1 : end + 2] == [True]
            if not (c == "R" or c == "H" and not _filled(taken) or taken and (c == "V" or label and labels < 4)):
                break
            end += 1
        taken = codes[start:end].rstrip("SW")
        if taken[:1] in ("H", "R") and _filled(taken) >= (2 if "H" in taken else 3):
            out.append((start, start + len(taken), len(taken) - taken.count("V")))
            start += len(taken)
        else:
            start += 1
    return out


def test_runs_by_brute_force():
    draw = random.Random(11)
    for _ in range(3000):
        codes = "".join(draw.choices("HRVSWO", (1, 4, 2, 3, 2, 1), k=draw.randrange(30)))
        figures = [c == "V" or c in "HR" and draw.random() < 0.2 for c in codes]
        found = texttables.runs(codes, figures)
        assert [(a, b, len({p for p in place if p >= 0})) for a, b, place in found] == _naive(codes, figures), codes
        assert all(len(place) == b - a for a, b, place in found)


def _tables(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    return [(int(r.document_id), r.start, r.end, r.grid) for r in elements(df).where("kind = 'table'").orderBy("document_id", "place").collect()]


REAL = [
    "Year ended    Year ended", "Particulars   Note", "31st March, 2026   31st March, 2025", "CONTINUING OPERATIONS", "INCOME", "Revenue from operations    25    61,975    59,676",
    "Changes in inventories of finished goods, work-in-progress and     29", " (395)    (78)", "stock-in-trade", "TOTAL EXPENSES    49,060    47,004", "PROFIT BEFORE EXCEPTIONAL ITEMS AND TAX FROM CONTINUING", " 13,874    13,849", "OPERATIONS", "Liabilities",
    "Non-current liabilities", "Financial liabilities", "Finance costs    31    363    350", "PROFIT FOR THE YEAR (C=A+B)    15,427    10,644", "The accompanying notes are an integral part of these financial statements.",
]


def test_text_tables(spark):
    plain = ["Management commentary paragraph that should stay as prose.", "Particulars   FY2025   FY2024", "ASSETS", "Inventories   1,620   1,300", "Trade receivables   1,420   1,180", "Total assets   11,200   9,400", "The notes form an integral part of these statements."]
    prose = ["Revenue grew to 10,600", "which was above our plan.", "Costs rose too."]
    found = _tables(spark, ["\n".join(plain), "\n".join(REAL), "\n".join(prose), "", None])
    assert [(d, a, b) for d, a, b, _ in found] == [(0, 1, 6), (1, 2, 18)]
    assert found[0][3][0] == ["Particulars", "FY2025", "FY2024"] and found[0][3][-1] == ["Total assets", "11,200", "9,400"]
    grid = found[1][3]
    assert ["Changes in inventories of finished goods, work-in-progress and", "29", "(395)", "(78)"] in grid and ["PROFIT BEFORE EXCEPTIONAL ITEMS AND TAX FROM CONTINUING", "13,874", "13,849"] in grid
    assert texttables.markdown([["A", "B"], ["x", "1"]]) == "| A | B |\n| --- | --- |\n| x | 1 |" and texttables.markdown([["a|b"], ["c", "d"]]) == "| a/b |  |\n| --- | --- |\n| c | d |"


def _facts(spark, grids, **more):
    """{(metric, period): value} of each grid, as tables of one document on one page."""
    df = spark.createDataFrame([("d", i, 1, "part", "", g, "", 1.0) for i, g in enumerate(grids)], "document_id string, chunk_index int, page_start int, part string, title string, grid array<array<string>>, context string, weight double")
    for k, v in more.items():
        df = df.withColumn(k, v)
    out = [{} for _ in grids]
    for r in statements.facts_of(df).collect():
        out[r.chunk_index][r.metric, r.period] = r
    return out


def test_statement_facts(spark):
    head = ["Particulars", "FY2025", "FY2024"]
    grids = [
        [head, ["Revenue from operations", "1,250", "1,000"], ["Finance costs", "(40)", "(30)"], ["Net profit margin", "12.0%", "11.0%"], ["Some unrecognised line", "5", "4"], ["Profit for the year", "150", "110"]],
        [["Particulars", "As at March 31, 2025", "As at March 31, 2024"], ["Non-current liabilities"], ["Borrowings", "2,600", "1,700"], ["Current liabilities"], ["Borrowings", "900", "600"], ["Total equity and liabilities", "11,200", "9,400"]],
        [head, ["Earnings per equity share"], ["Basic (INR)", "14.40", "16.32"]], [head, ["Basic", "14.40", "16.32"]], [["Particulars", "Note", "FY2025", "FY2024"], ["Revenue from operations", "21", "500", "400"]],
        [["Particulars", "Quarter ended June 30, 2025", "Quarter ended June 30, 2024"], ["Revenue", "300", "250"]], [["for the year ended 31st March, 2026"], ["Particulars", "31st March, 2026", "31st March, 2025"], ["Revenue from operations", "100", "90"]],
        [["Particulars", "FY2026", "FY2025"], ["Earnings per equity share", "35"], ["For Continuing operations"], ["Basic (in H)", "H46.90", "H45.34"], ["For Discontinued operations"], ["Basic (in H)", "H18.76", "H0.04"], ["For Continuing and Discontinued operations"], ["Basic (in H)", "H65.66", "H45.30"]],
        [head, ["Revenue", "1 2"], ["", "Total assets", "7", "8"]],
    ]
    found = [{k: r.value for k, r in each.items()} for each in _facts(spark, grids, title=F.when(F.col("chunk_index") == 0, "Statement of Profit and Loss (INR in crore)").otherwise(""))]
    assert found[0] == {("revenue", "FY2025"): 1250.0, ("revenue", "FY2024"): 1000.0, ("finance_costs", "FY2025"): -40.0, ("finance_costs", "FY2024"): -30.0, ("net_income", "FY2025"): 150.0, ("net_income", "FY2024"): 110.0}
    assert found[1] == {("long_term_debt", "FY2025"): 2600.0, ("long_term_debt", "FY2024"): 1700.0, ("short_term_debt", "FY2025"): 900.0, ("short_term_debt", "FY2024"): 600.0}
    assert found[2] == {("eps", "FY2025"): 14.4, ("eps", "FY2024"): 16.32} and found[3] == {}
    assert found[4] == {("revenue", "FY2025"): 500.0, ("revenue", "FY2024"): 400.0} and found[5] == {("revenue", "Interim Jun 2025"): 300.0, ("revenue", "Interim Jun 2024"): 250.0}
    assert found[6] == {("revenue", "FY2026"): 100.0, ("revenue", "FY2025"): 90.0} and found[7] == {("eps", "FY2026"): 65.66, ("eps", "FY2025"): 45.3}
    assert found[8] == {("revenue", "FY2025"): 1.0, ("revenue", "FY2024"): 2.0, ("total_assets", "FY2025"): 7.0, ("total_assets", "FY2024"): 8.0}
    unit = _facts(spark, grids[:3], title=F.lit("Statement (INR in crore)"))
    assert {(r.unit, r.scale, r.currency) for r in unit[0].values()} == {("crore", 1e7, "INR")} and {(r.unit, r.scale) for r in unit[2].values()} == {("", 1.0)}


def test_reports_read_the_tables_once(spark, sf_dir):
    """A report's years and the years before them come from one pass over the line items."""
    from quillstone.plans import filings

    plan = filings.filings(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "relation" in plan.lower()


def test_tables_without_a_header(spark):
    """Only the last table that was read, on the same page and in the same part, is continued."""
    bare = [["Total - Current liabilities (C)", "15,549", "16,537"], ["Total liabilities", "30,744", "30,271"]]
    headed = [["Particulars", "FY2026", "FY2025"], ["Total assets", "1", "2"]]
    nothing = [["Particulars", "FY2020", "FY2019"], ["Only a heading"]]
    index, whole = F.col("chunk_index"), {("current_liabilities", "FY2026"), ("current_liabilities", "FY2025"), ("total_liabilities", "FY2026"), ("total_liabilities", "FY2025")}
    assert _facts(spark, [bare])[0] == {}
    assert [set(x) for x in _facts(spark, [headed, bare, bare, nothing, bare])] == [{("total_assets", "FY2026"), ("total_assets", "FY2025")}, whole, whole, set(), whole]
    parts = _facts(spark, [headed, bare, bare, headed, bare, bare], part=F.element_at(F.array(*[F.lit(x) for x in "abaaba"]), index + 1))
    assert [len(x) for x in parts] == [2, 0, 4, 2, 0, 4]
    pages = _facts(spark, [headed, bare, headed, bare], page_start=F.element_at(F.array(*[F.lit(x) for x in (1, 2, 2, 2)]), index + 1))
    assert [len(x) for x in pages] == [2, 0, 2, 4]


def _passages(spark, text, document_type=None, **limits):
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    return sections.passages(elements(df), document_type, **limits).orderBy("chunk_index").collect()


BODY = "This paragraph explains the accounting treatment in enough words to be kept as a passage for retrieval."


def test_sections(spark):
    text = f"# Consolidated Statement of Cash Flows\n\n{BODY}\n\n## Notes to the consolidated financial statements\n\n{BODY}\n\n## Contingent items\n\n{BODY}\n\n# Risk Factors\n{BODY}\n## Empty\n\nShort one."
    found = _passages(spark, text)
    assert [c.section for c in found] == ["Consolidated Statement of Cash Flows", "Notes to the consolidated financial statements", "Notes to the consolidated financial statements › Contingent items", "Risk Factors"]
    assert [c.chunk_type for c in found] == ["narrative", "notes", "notes", "risk_factor"] and found[0].text.startswith("Consolidated Statement of Cash Flows\n\nThis paragraph")
    risky = "The litigation and default risk add volatility and downturn exposure to all of it, adversely and with impairment of the assets."
    assert _passages(spark, risky)[0].chunk_type == "risk_factor" and _passages(spark, BODY, F.lit("earnings_call"))[0].chunk_type == "earnings_commentary" and _passages(spark, BODY, F.lit("mda"))[0].chunk_type == "management_commentary"
    assert _passages(spark, "") == [] == _passages(spark, None) == _passages(spark, "Too few words here.")


def test_long_narrative(spark):
    text = "# Outlook\n\n" + " ".join(f"Sentence number {i} explains the strategic outlook of the business in some detail." for i in range(200))
    found = _passages(spark, text)
    assert len(found) > 5 and all(c.text.rstrip().endswith(".") and c.n_tokens <= 320 + 48 + 2 for c in found)
    for a, b in zip(found, found[1:], strict=False):
        assert b.text.split(".")[0] in a.text  # starts with whole sentences of the one before
    said = [re.findall(r"number (\d+) ", c.text) for c in found]
    assert {int(x) for s in said for x in s} == set(range(200))


def test_large_tables(spark):
    rows = "\n".join(f"Line item A{i}B   {i * 1000:,}   {i * 900:,}" for i in range(1, 200))
    found = _passages(spark, f"# Balance Sheet\n\nAmounts in INR crore\n\nParticulars   FY2025   FY2024\n{rows}\n\n{BODY}")
    parts = [c for c in found if c.table_index is not None]
    assert len(parts) > 2 and all(c.n_tokens <= 900 + 4 for c in parts) and all("| Particulars | FY2025 | FY2024 |" in c.text and c.chunk_type == "financial_statement" for c in parts)
    assert [c.text.split("\n")[0] for c in parts] == [f"Balance Sheet Amounts in INR crore (part {i})" for i in range(1, len(parts) + 1)]
    assert [int(x) for c in parts for x in re.findall(r"Line item A(\d+)B ", c.text)] == list(range(1, 200)) and [c.grid is not None for c in parts] == [True] + [False] * (len(parts) - 1)
    assert found[-1].table_index is None and found[-1].text == BODY
    small = _passages(spark, "Totals\n\nName   1   2\nOther   3   4\nThird   5   6")
    assert [(c.text.split("\n")[0], c.chunk_type) for c in small] == [("Totals", "table")]


def test_bases_and_statements(spark):
    text = (
        "# Meridian Foods Limited\n\nAnnual Report FY2025. (INR in crore)\n\n# Standalone Statement of Profit and Loss\n\nParticulars   FY2025   FY2024\nRevenue from operations   900   800\nFinance costs   20   18\nProfit for the year   90   80\n\n"
        "# Consolidated Statement of Profit and Loss\n\nParticulars   FY2025   FY2024\nRevenue from operations   1,500   1,300\nFinance costs   35   30\nProfit for the year   150   120\n\n"
        "# Notes to the consolidated financial statements\n\nSummarised financial information of a subsidiary is given below for reference by readers.\n\nParticulars   FY2025   FY2024\nRevenue from operations   40   35\nFinance costs   2   1\nProfit for the year   4   3\n"
    )
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    found = statements.facts_of(sections.weighted(sections.passages(elements(df)), statements.MOST_PAGES)).collect()
    assert len(found) == 18
    assert {(r.value, r.confidence) for r in found if (r.metric, r.period) == ("revenue", "FY2025")} == {(900.0, 0.9), (1500.0, 1.0), (40.0, 0.8)}
    assert {(r.unit, r.currency, r.scale) for r in found} == {("crore", "INR", 1e7)}
    part = spark.createDataFrame([("d", i, p, s, "") for i, (p, s) in enumerate([(1, "Balance Sheet"), (3, "Balance Sheet › A"), (4, "Balance Sheet"), (5, ""), (6, "Balance Sheet")])], "document_id string, chunk_index int, page_start int, section string, title string")
    assert [r.weight for r in sections.weighted(part, 2).orderBy("chunk_index").collect()] == [1.0, 1.0, 0.8, 0.8, 1.0]


def test_provenance(spark):
    df = spark.createDataFrame([("Acme", "Annual Report", "Outlook", "text"), (None, "", "Outlook", "text"), (None, None, None, "text")], "company string, title string, section string, text string")
    got = [r.p for r in df.select(sections.provenance(*[F.col(c) for c in df.columns]).alias("p")).collect()]
    assert got == ["Acme | Annual Report | Outlook\ntext", "Outlook\ntext", "text"]


def test_section_passages_by_brute_force(spark, sf_dir):
    """Every document's passages against the rules applied to its paragraphs one token at a time."""
    found = {}
    for r in catalog.QUERIES["section_passages"](spark, sf_dir).where("startswith(document_id, 'd')").collect():
        found.setdefault(int(r.document_id[1:]), []).append((r.chunk_index, r.n_tokens, r.digest))
    size = lambda s: len(re.findall(r"\w+|[^\w\s]", s))
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as string) as document_id", "text")
    parts = {}
    for r in elements(table).orderBy("document_id", "place").collect():
        parts.setdefault(int(r.document_id), []).append(r)
    import hashlib

    for doc, told in parts.items():
        want, held, fresh, carried = [], [], 0, False

        def close(last=False):
            nonlocal held, fresh, carried
            if held and fresh >= 12:
                want.append("\n\n".join(held))
            cut = [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])", held[-1]) if s.strip()] if held and fresh and not last else []
            tail = []
            while cut and sum(map(size, tail)) + size(cut[-1]) <= 48:
                tail.insert(0, cut.pop())
            held, fresh, carried = [" ".join(tail)] if tail else [], 0, bool(tail)

        if any(r.kind != "text" for r in told):
            continue  # headings and tables have cases of their own
        for r in told:
            pieces, room = [[]], 320
            for s in [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])", r.text) if s.strip()] if size(r.text) > 320 else [r.text]:
                if pieces[-1] and size(s) > room:
                    pieces.append([])
                    room = 320
                pieces[-1].append(s)
                room -= size(s)
            for p in (" ".join(x) for x in pieces):
                if fresh and fresh + size(p) > 320:
                    close()
                held.append(p)
                fresh += size(p)
        close(True)
        assert sorted(found.get(doc, [])) == [(i, size(x), hashlib.md5(x.encode()).hexdigest()) for i, x in enumerate(want)], doc
    assert sum(len(v) for v in found.values()) > 100


def test_boxes_are_never_broadcast(spark):
    from quillstone.operators import geometry

    spans = spark.createDataFrame([("d", 0, "in", 10.0, 10.0, 20.0, 20.0), ("d", 0, "out", 500.0, 10.0, 510.0, 20.0), ("e", 0, "none", 10.0, 10.0, 20.0, 20.0)], "document_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([("d", 0, 0.0, 0.0, 400.0, 400.0)], "document_id string, page int, x0 double, y0 double, x1 double, y1 double")
    found = geometry.outside(spans, boxes)
    assert sorted(r.text for r in found.collect()) == ["none", "out"]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_lines_of_one_long_page(spark):
    """A page is split once, not again for each of its lines, which would take minutes here."""
    import time

    began = time.time()
    df = spark.createDataFrame([("1", "\n".join(f"Line {i}" for i in range(60_000)))], "document_id string, text string")
    assert classed(df).agg(F.count("*"), F.max("line")).first()[:] == (60_000, 59_999)
    assert time.time() - began < 60


def test_words_of_long_lines(spark):
    """Of a long line that doesn't end like a row nothing but its own class depends on its words; rows of any length are still found."""
    prose, row = "The group went on with its work in all of its parts. " * 4, "Revenue from operations" + " 1,234" * 30
    texts = [prose, row, f"{row} |", prose + "12", "# " + prose, "x" * 200, "|" + row + "|"]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "document_id string, text string")
    assert [(r.code, r.level) for r in classed(df).orderBy("document_id").collect()] == [("O", 0), ("R", 0), ("R", 0), ("O", 0), ("O", 1), ("O", 0), ("R", 0)]
    shorts = spark.createDataFrame([(x,) for x in (prose.strip(), row, f"{row} |", "Outlook")], "said string")
    assert [r[0] for r in shorts.select(lines.is_short_or_row(F.col("said"))).collect()] == [False, True, True, True]


def test_documents_are_folded_once(spark, monkeypatch):
    folded = spark.sparkContext.accumulator(0)
    made = sections._chunked

    def counting(*limits):
        fold = made(*limits)

        def counted(batches):
            for batch in fold(batches):
                folded.add(batch.num_rows)
                yield batch

        return counted

    monkeypatch.setattr(sections, "_chunked", counting)
    text = "# Balance Sheet\n\nParticulars FY2023 FY2022\nRevenue 10 20\nTotal assets 30 40\nInventories 5 6\n"
    df = spark.createDataFrame([("1", text), ("2", text)], "document_id string, text string")
    found = sections.passages(elements(df)).collect()
    assert {r.chunk_type for r in found} == {"financial_statement"} and folded.value == len(found) == 2


def test_tokens_are_counted_once(monkeypatch):
    """A document's tokens are counted in one pass over its sentences, as the pattern counts them; only headings and tables are counted apart."""
    odd = ["", " ", "a_b c-d", "naïve “quotes”…", "١٢ ½ Ⅷ", "e\u0301 \u00a0x\x1cy\u2028z", "日本語、です。", "🙂🙂 ok", "_", "x" * 500]
    assert sections.sizes(odd) == [sections._size(x) for x in odd] and sections.sizes([]) == []
    text = " ".join(f"Sentence {i} has a few words, and it ends here." for i in range(400))
    counted = []
    monkeypatch.setattr(sections, "_size", lambda s: counted.append(len(s)) or len(re.findall(r"\w+|[^\w\s]", s)))
    document = sections._Document("d", 320, 48, 900)
    document.add(1, "heading", 1, "Outlook", None, None)
    document.add(1, "text", 0, text, None, None)
    document.add(2, "text", 0, "A last paragraph of its own. " * 3, None, None)
    found = document.done()
    assert len(found) > 10 and sum(counted) <= len("Outlook")
    assert [r[9] for r in found] == [len(re.findall(r"\w+|[^\w\s]", r[8])) for r in found]


def test_stripped_at_the_ends(spark):
    odd = ["", " ", "a b", " a b", "a b ", "\u3000a\u2028", "\x1ca", "a\x85", "a\u200b", "🙂 ", "a \n b\r\n", None]
    rows = spark.createDataFrame([(x,) for x in odd], "said string").select(t.stripped(F.col("said")), t.stripped_long(F.col("said"))).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]


def test_rules_and_underlines(spark):
    """Lines behind first characters that patterns allow, underlines between blanks of any kind, and joined words."""
    from quillstone.operators.elements import joined

    text = "Title one\n \u00a0=== \nplain\n-- -\n|:--|\n| a | b |\n|\n#\n# \u00a0Head\n####### no\nend\r---\r\nFY2024 2023 notes of the year"
    found = classed(spark.createDataFrame([("1", text)], "document_id string, text string")).orderBy("line").collect()
    assert [(r.said, r.level) for r in found] == [("Title one", 1), ("plain", 0), ("a   b", 0), ("|", 0), ("#", 0), ("\u00a0Head", 1), ("####### no", 0), ("end", 1), ("FY2024 2023 notes of the year", 0)]
    assert joined(["pre-", "", "fix-", "es and -", "no", "A-", "B", "-"]) == "prefixes and - no A- B -"


def test_tables_of_documents_are_given(spark, tmp_path, monkeypatch):
    from quillstone.plans import filings

    said = [(5, "Particulars   FY2021   FY2020\nRevenue   1,200   1,100\nProfit   300   200\n"), (6, "No table here."), (7, None)]
    spark.createDataFrame(said, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(filings, "filings", lambda spark, sf_dir: spark.createDataFrame([("1", "A report.")], "document_id string, text string"))
    found = filings.text_tables(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("d5", 1, 0, 3, 3, "Particulars|FY2021|FY2020", "Profit|300|200")]
