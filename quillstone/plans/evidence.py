"""Registered queries over evidence: hash embeddings, lanes, support of answers, runs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as t
from quillstone.operators import evaluation
from quillstone.operators import financials as f
from quillstone.operators.tables import facts_of
from quillstone.plans.finance import SQL_WITH
from quillstone.plans.search import tokens_sql
from quillstone.sources.tables import facts, table

WANTED = ["revenue", "net_income", "eps", "inventory"]


def statement_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six documents of each company: most wanted metrics first, the wanted year before others, then by id."""
    rows = facts(spark, sf_dir).where(F.col("metric").isin(WANTED))
    each = rows.groupBy("company_id", "document_id").agg(F.countDistinct("metric").alias("n_metrics"), F.max(F.when(F.col("fiscal_year") == 1998, 1).otherwise(0)).alias("in_year"))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("n_metrics"), F.desc("in_year"), "document_id"))
    return each.withColumn("place", place).where("place <= 6")


def answer_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each assistant turn the share of terms that the turn before it has, and whether that is enough."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(t.tokens(F.col("text"))).alias("terms"))
    rows = rows.withColumn("before", F.lag("terms").over(order)).where("role = 'assistant' and before is not null and size(terms) > 0")
    share = F.size(F.array_intersect("terms", "before")) / F.size("terms")
    return rows.select("conv_id", "turn", F.round(share, 6).alias("share"), (share >= 0.6).alias("supported"))


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an answer to the one before it, which is question and context: its second statement has a figure and markup of its own."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(order).alias("before")).where("before is not null and text is not null")
    # Sentences would also end inside the texts; one statement is the whole of either.
    plain = lambda c: F.regexp_replace(c, r"[^A-Za-z]+", " ")
    own, before = plain("text"), plain("before")
    answer = F.concat(F.lit("# Heading of four words\n| a | table row 99 |\n"), before, F.lit("\n**"), before, F.lit("** 1,250 [S1]\n"), own, F.lit(" figure 77"))
    context = F.concat(before, F.lit(" Sales 1,250."))
    cited = F.array(*[F.struct(F.lit(d).alias("document"), F.lit(p).alias("page"), F.lit(e).cast("int").alias("page_end")) for d, p, e in (("a", 3, 5), ("b", 4, None), ("a", 9, None), ("a", 1, None))])
    page = (F.col("turn") % 10).cast("int")
    scored = {
        "faithfulness": evaluation.faithfulness(answer, context), "relevance": evaluation.relevance(before, answer), "key_facts": evaluation.key_fact_recall(answer, F.array(F.lit("Figure 77"), F.lit("not there"))),
        "citation_precision": evaluation.citation_precision(cited, F.lit("a")), "page_hit": evaluation.page_hit(cited, F.lit("a"), page),
    }
    return rows.select("conv_id", "turn", *[F.round(c, 4).alias(k) for k, c in scored.items()])


def carried_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn up to each turn."""
    past = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(past).alias("question_turn"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type of each user: first event, length."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    marked = rows.withColumn("new", F.when(F.lag("event_type").over(order) == F.col("event_type"), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("least_event")).where("n > 1").select("user_id", "run", "event_type", "n", "least_event")


def company_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last digits of customers' names as keys, with the market segments met under each, in order."""
    rows = table(spark, sf_dir, "customer").select(F.substring("c_name", -1, 1).alias("key"), "c_mktsegment")
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("aliases"), F.count("*").alias("n"))


def _cell(value: Column) -> Column:
    return F.when(value.isNull(), "Not available").otherwise(F.format_number(value, 2))


def company_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown table of each company: years down, revenue, profit and debt-to-equity across."""
    rows = f.with_ratios(f.panel(f.best_facts(facts(spark, sf_dir))))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("fiscal_year").cast("string"), _cell(F.col("revenue")), _cell(F.col("net_income")), _cell(F.col("debt_to_equity"))), F.lit(" |"))
    lines = F.array_sort(F.collect_list(line))  # a line for each fiscal year
    return rows.groupBy("company_id").agg(F.concat(F.lit("| year | revenue | profit | debt to equity |\n"), F.array_join(lines, "\n")).alias("report"))


_ROWS = {"revenue": "Revenue from operations", "net_income": "Profit for the year", "equity": "Total equity", "cash": "(a) Cash and cash equivalents"}
_YEARS = (1997, 1998, 1999)


def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's figures printed as a statement table and read back."""
    rows = f.best_facts(facts(spark, sf_dir)).where(F.col("metric").isin(list(_ROWS)) & F.col("fiscal_year").isin(list(_YEARS)))
    shown = F.format_number(F.abs(F.col("value")) * 10000, 2)
    wide = rows.select("company_id", "metric", "fiscal_year", F.when(F.col("value") < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown).alias("cell"))
    wide = wide.groupBy("company_id", "metric").pivot("fiscal_year", list(_YEARS)).agg(F.first("cell"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in _ROWS.items() for x in kv]), F.col("metric"))
    place = F.element_at(F.create_map(*[x for i, m in enumerate(_ROWS) for x in (F.lit(m), F.lit(i + 2))]), F.col("metric"))
    cells = F.array(label, F.lit("7"), *[F.coalesce(F.col(str(y)), F.lit("-")) for y in _YEARS])
    body = wide.select(F.col("company_id").alias("grid_id"), place.alias("row_idx"), cells.alias("cells"))
    fixed = [(0, ["Statement for FY1999"]), (1, ["Particulars", "Note", "FY1997", "FY1998", "FY1999"]), (9, ["Net profit", "8", "1.5%", "2.5%", "3.5%"])]
    given = F.explode(F.array(*[F.struct(F.lit(i).alias("row_idx"), F.array(*[F.lit(c) for c in row]).alias("cells")) for i, row in fixed])).alias("g")
    extra = body.select("grid_id").distinct().select("grid_id", given).select("grid_id", "g.row_idx", "g.cells")
    return facts_of(body.unionByName(extra)).select(F.col("grid_id").alias("company_id"), "metric", "period", "value", "confidence")


def _public(name: str, value: object) -> bool:
    return callable(value) and getattr(value, "__module__", "") == __name__ and not name.startswith("_")


QUERIES = {name: value for name, value in list(globals().items()) if _public(name, value)}


ORACLE_SQL = {
    "statement_lane": f"""{SQL_WITH}, e AS (SELECT company_id, document_id, count(DISTINCT metric) AS n_metrics, max((fiscal_year = 1998)::INT) AS in_year FROM facts WHERE metric IN {tuple(WANTED)} GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n_metrics DESC, in_year DESC, document_id)::INT AS place FROM e QUALIFY place <= 6""",
    "answer_support": f"""WITH r AS (SELECT conv_id, turn, role, list_distinct({tokens_sql("text")}) AS x FROM conversations), b AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM r)
      SELECT conv_id, turn, round(len(list_intersect(x, y))::DOUBLE / len(x), 6) AS share, len(list_intersect(x, y))::DOUBLE / len(x) >= 0.6 AS supported FROM b WHERE role = 'assistant' AND y IS NOT NULL AND len(x) > 0""",
    "answer_scores": f"""WITH b AS (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z]+', ' ', 'g') AS own, regexp_replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '[^A-Za-z]+', ' ', 'g') AS before FROM conversations),
      t AS (SELECT conv_id, turn, {tokens_sql("before")} AS bt FROM b WHERE before IS NOT NULL AND own IS NOT NULL),
      n AS (SELECT conv_id, turn, bt, len(bt) >= 3 AS counts, len(bt) + len({tokens_sql("'1,250'")}) >= 3 AS counts_with_figure FROM t),
      o AS (SELECT b.conv_id, b.turn, len({tokens_sql("own || ' figure 77'")}) >= 3 AS own_counts FROM b)
      SELECT n.conv_id, n.turn, round(CASE WHEN counts_with_figure::INT + counts::INT + own_counts::INT = 0 THEN 0 ELSE (counts::INT + counts_with_figure::INT)::DOUBLE / (counts::INT + counts_with_figure::INT + own_counts::INT) END, 4) AS faithfulness,
        CASE WHEN len(bt) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS relevance, 0.5::DOUBLE AS key_facts, 0.75::DOUBLE AS citation_precision, CASE WHEN n.turn % 10 IN (1, 3, 4, 5, 9) THEN 1.0 ELSE 0.0 END::DOUBLE AS page_hit
      FROM n JOIN o ON o.conv_id = n.conv_id AND o.turn = n.turn""",
    "carried_question": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question_turn FROM conversations",
    "event_runs": """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM m) SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS least_event FROM r GROUP BY ALL HAVING n > 1""",
    "table_facts": f"""{SQL_WITH}, b AS (SELECT company_id, metric, fiscal_year, value, count(*) OVER (PARTITION BY company_id, metric) AS n FROM best WHERE metric IN {tuple(_ROWS)} AND fiscal_year IN {_YEARS})
      SELECT company_id, metric, 'FY' || fiscal_year AS period, sign(value) * replace(format('{{:,.2f}}', abs(value) * 10000), ',', '')::DOUBLE AS value, 1.0::DOUBLE AS confidence FROM b WHERE n = 3""",
    "company_aliases": "SELECT c_name[-1] AS key, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS aliases, count(*) AS n FROM customer GROUP BY 1",
    "company_report": f"""{SQL_WITH} SELECT company_id, '| year | revenue | profit | debt to equity |' || chr(10) || string_agg('| ' || fiscal_year || ' | ' || coalesce(format('{{:,.2f}}', revenue), 'Not available') || ' | '
      || coalesce(format('{{:,.2f}}', net_income), 'Not available') || ' | ' || coalesce(format('{{:,.2f}}', debt_to_equity), 'Not available') || ' |', chr(10) ORDER BY fiscal_year) AS report FROM rated GROUP BY 1""",
}
