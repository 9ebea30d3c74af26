"""Registered queries over the fact table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numeric import change_text, number_text, ratio_text
from quillstone.operators import financials as f
from quillstone.sources.tables import FACTS_SQL, facts, table

COMPANIES = [1, 2, 3]
FIRST, LAST = 1996, 1999


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.panel(f.best_facts(facts(spark, sf_dir)))


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.with_ratios(_panel(spark, sf_dir))


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.series(_panel(spark, sf_dir), ["revenue", "ebitda", "net_income", "eps", "free_cash_flow"])


def _all_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).unionByName(f.series(_ratios(spark, sf_dir), ["operating_margin", "net_margin", "roe"], "%"))


def flagship_debt_to_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debt-to-equity of every company and year with its display text."""
    rows = _ratios(spark, sf_dir)
    return rows.select("company_id", "company", "fiscal_year", "total_debt", "equity", "debt_to_equity", ratio_text(F.col("debt_to_equity"), "x").alias("display"))


def best_fact_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.best_facts(facts(spark, sf_dir)).select("company_id", "fiscal_year", "metric", "document_id", "value", "confidence")


def derived_metrics_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("company_id", "fiscal_year", *f.SNAPSHOT, "total_liabilities")


def ratio_panel_all18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir).select("company_id", "fiscal_year", *f.RATIOS)


def ratio_missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.missing_inputs(_panel(spark, sf_dir))


def kpi_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The KPI row of the last year of every company, with display texts."""
    rows = _ratios(spark, sf_dir)
    last = rows.groupBy("company_id").agg(F.max("fiscal_year").alias("fiscal_year"))
    found = rows.join(last, ["company_id", "fiscal_year"], "left_semi")
    return found.select("company_id", "fiscal_year", *f.KPIS, number_text(F.col("eps")).alias("eps_text"), ratio_text(F.col("roe"), "%").alias("roe_text"), change_text(F.col("revenue_growth"), "%").alias("revenue_change"))


def yoy_trend_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.changes(_all_series(spark, sf_dir)).select("company_id", "key", "fiscal_year", "value", "change")


def trend_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.trends(_all_series(spark, sf_dir)).select("company_id", "key", "n_points", "years", "direction")


def trend_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.trends(_amounts(spark, sf_dir)).select("company_id", "key", F.round("cagr", 6).alias("cagr"))


def significant_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.significant(_all_series(spark, sf_dir)).select("company_id", "key", "fiscal_year", "verb", "change")


def risk_signals_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.risk_signals(_panel(spark, sf_dir))


def compare_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.compared_companies(_ratios(spark, sf_dir), COMPANIES)


def compare_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.compared_periods(_ratios(spark, sf_dir), FIRST, LAST)


def project_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f.projected_growth(f.series(_panel(spark, sf_dir), ["revenue", "ebitda"]))
    return rows.withColumn("value", F.round("value", 6))


def project_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f.projected_line(f.series(_panel(spark, sf_dir), ["revenue", "ebitda"]))
    return rows.withColumn("value", F.round("value", 4))


def statement_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by year of every company."""
    long = f.series(_panel(spark, sf_dir), f.METRICS)
    years = list(range(1995, 2002))
    return long.groupBy("company_id", "key").pivot("fiscal_year", years).agg(F.first("value")).select("company_id", "key", *[F.col(str(y)).alias(f"fy{y}") for y in years])


def ratio_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios by year of every company."""
    long = f.series(_ratios(spark, sf_dir), list(f.RATIOS))
    years = list(range(1995, 2002))
    return long.groupBy("company_id", "key").pivot("fiscal_year", years).agg(F.first("value")).select("company_id", "key", *[F.col(str(y)).alias(f"fy{y}") for y in years])


def majority_unit_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).where(~F.col("metric").isin(list(f.PER_SHARE)))
    unit = f.majority(rows.where("unit <> ''"), "company_id", "unit").withColumnRenamed("votes", "unit_votes")
    money = f.majority(rows.where("currency <> ''"), "company_id", "currency").withColumnRenamed("votes", "currency_votes")
    return unit.join(money, "company_id")


def pick_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen year of every company and the one before it, null where it is missing."""
    rows = f.with_previous(_panel(spark, sf_dir), ["revenue", "fiscal_year"])
    return rows.where(F.col("fiscal_year") == 1998).select("company_id", "fiscal_year", F.col("prev_fiscal_year").alias("previous_year"), "revenue", F.col("prev_revenue").alias("previous_revenue"))


def spotlight_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = facts(spark, sf_dir).groupBy("company_id").agg(F.countDistinct("fiscal_year").alias("n_years"), F.max("document_id").alias("last_document"))
    return each.orderBy(F.desc("n_years"), F.desc("last_document")).limit(1)


def company_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("company_id", "company").agg(
        F.countDistinct("document_id").alias("n_documents"), F.count("*").alias("n_facts"), F.array_join(F.array_sort(F.collect_set(F.col("fiscal_year").cast("string"))), ",").alias("years")
    )


def year_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of one company for which another reports earnings per share, and those for which it does not."""
    rows = facts(spark, sf_dir)
    a = rows.where(F.col("company_id") == 1).select("fiscal_year")
    b = rows.where((F.col("company_id") == 5) & (F.col("metric") == "eps")).select("fiscal_year")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


def stuck_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders older than the limit, seen from a fixed now."""
    limit = F.to_timestamp(F.lit("2001-08-01")) - F.expr("INTERVAL 30 DAYS")
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate") < limit))
    return rows.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def search_filter_in_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of several fields must match, any of each field's values will do."""
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    people = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return rows.join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"))


def company_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the number of its orders, also those with none."""
    people, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    each = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").cast("date").alias("last_date"))
    return people.join(each, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.col("last_date").cast("string").alias("last_date"))


def orphan_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    people, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return people.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


_RATIO_SQL = """
    current_assets / nullif(current_liabilities, 0) AS current_ratio, (current_assets - inventory) / nullif(current_liabilities, 0) AS quick_ratio,
    cash / nullif(current_liabilities, 0) AS cash_ratio, total_debt / nullif(equity, 0) AS debt_to_equity, total_debt / nullif(total_assets, 0) AS debt_ratio,
    ebit / nullif(finance_costs, 0) AS interest_coverage, gross_profit / nullif(revenue, 0) * 100 AS gross_margin, ebit / nullif(revenue, 0) * 100 AS operating_margin,
    net_income / nullif(revenue, 0) * 100 AS net_margin, ebitda / nullif(revenue, 0) * 100 AS ebitda_margin, net_income / nullif(total_assets, 0) * 100 AS roa,
    net_income / nullif(equity, 0) * 100 AS roe, revenue / nullif(total_assets, 0) AS asset_turnover, cogs / nullif(inventory, 0) AS inventory_turnover,
    revenue / nullif(receivables, 0) AS receivables_turnover, (revenue - p_revenue) / nullif(abs(p_revenue), 0) * 100 AS revenue_growth,
    (net_income - p_net_income) / nullif(abs(p_net_income), 0) * 100 AS profit_growth, (eps - p_eps) / nullif(abs(p_eps), 0) * 100 AS eps_growth"""

_REPORTED = "revenue depreciation finance_costs tax_expense pbt net_income eps cash inventory receivables current_assets total_assets short_term_debt long_term_debt current_liabilities equity cfo capex cogs".split()
_PREVIOUS = "revenue net_income eps total_debt equity ebit finance_costs cfo receivables inventory".split()

SQL_WITH = f"""WITH {FACTS_SQL}, best AS MATERIALIZED (
  SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY company_id, fiscal_year, metric
    ORDER BY (document_year = fiscal_year) DESC, confidence DESC, (document_type = 'annual_report') DESC, uploaded_at DESC, document_id) = 1
), wide AS (
  SELECT company_id, company, fiscal_year, {", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in _REPORTED)} FROM best GROUP BY ALL
), panel AS MATERIALIZED (
  SELECT *, CASE WHEN short_term_debt IS NOT NULL OR long_term_debt IS NOT NULL THEN coalesce(short_term_debt, 0) + coalesce(long_term_debt, 0) END AS total_debt,
    revenue - cogs AS gross_profit, pbt + abs(finance_costs) AS ebit, pbt + abs(finance_costs) + abs(depreciation) AS ebitda, cfo - abs(capex) AS free_cash_flow, total_assets - equity AS total_liabilities FROM wide
), dated AS (
  SELECT c.*, p.fiscal_year AS p_fiscal_year, {", ".join(f"p.{m} AS p_{m}" for m in _PREVIOUS)} FROM panel c LEFT JOIN panel p ON c.company_id = p.company_id AND c.fiscal_year = p.fiscal_year + 1
), rated AS MATERIALIZED (
  SELECT *, {_RATIO_SQL} FROM dated
)"""


def _series_sql(name: str, keys: list[str], source: str, unit: str = "") -> str:
    parts = [f"SELECT company_id, '{k}' AS key, '{unit}' AS unit, fiscal_year, {k} AS value FROM {source}" for k in keys]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


_AMOUNTS_SQL = _series_sql("amounts", ["revenue", "ebitda", "net_income", "eps", "free_cash_flow"], "panel")
_POINTS_SQL = f"""{_AMOUNTS_SQL}, {_series_sql("shares_of", ["operating_margin", "net_margin", "roe"], "rated", "%")}, points AS MATERIALIZED (FROM amounts UNION ALL FROM shares_of), moved AS MATERIALIZED (
  SELECT a.*, CASE WHEN a.unit = '%' THEN a.value - b.value ELSE (a.value - b.value) / nullif(abs(b.value), 0) * 100 END AS change
  FROM points a LEFT JOIN points b ON a.company_id = b.company_id AND a.key = b.key AND a.fiscal_year = b.fiscal_year + 1
)"""
_RATIO_KEYS = list(f.RATIOS)
_RATIO_INPUTS = {key: inputs for key, (inputs, _) in f.RATIOS.items()}
_FY = list(range(1995, 2002))


def _pivot_sql(years: list[int], by: str = "key") -> str:
    return f"SELECT {by}, " + ", ".join(f"max(value) FILTER (fiscal_year = {y}) AS fy{y}" for y in years) + f" FROM long2 GROUP BY {by}"


def _group(text: str, digits: int) -> str:
    return f"format('{{:,.{digits}f}}', {text})"


_PERCENTS = ("revenue_growth", "ebitda_margin", "net_margin", "roe", "roa")
_CHG = lambda c: f"((({c}) - p_{c}) / nullif(abs(p_{c}), 0) * 100)"
_DE, _DEP = "(total_debt / nullif(equity, 0))", "(p_total_debt / nullif(p_equity, 0))"
_CO, _COP = "(ebit / nullif(finance_costs, 0))", "(p_ebit / nullif(p_finance_costs, 0))"
_M = lambda c: f"({c} / nullif(revenue, 0) * 100)"
_MP = lambda c: f"(p_{c} / nullif(p_revenue, 0) * 100)"
_RISING = f"coalesce({_CHG('total_debt')} >= 10 AND {_DE} > {_DEP}, false)"
_LIQ = "(current_assets / nullif(current_liabilities, 0))"
_RULES_SQL = [
    ("rising_leverage", _RISING, f"{_DE} > 1.5 OR {_CHG('total_debt')} >= 40", _CHG("total_debt")),
    ("high_leverage", f"NOT {_RISING} AND {_DE} > 1", f"{_DE} > 2", _DE),
    ("weak_interest_coverage", f"{_CO} < 3", f"{_CO} < 1.5", _CO),
    ("declining_interest_coverage", f"NOT coalesce({_CO} < 3, false) AND {_CO} <= {_COP} * 0.75", "", _CO),
    ("negative_operating_cash_flow", "cfo < 0", "true", "cfo"),
    ("declining_operating_cash_flow", f"NOT coalesce(cfo < 0, false) AND {_CHG('cfo')} <= -10", "", _CHG("cfo")),
    ("negative_free_cash_flow", "free_cash_flow < 0", "", "free_cash_flow"),
    ("operating_margin_compression", f"{_MP('ebit')} - {_M('ebit')} >= 1", f"{_MP('ebit')} - {_M('ebit')} >= 5", f"{_M('ebit')} - {_MP('ebit')}"),
    ("net_margin_compression", f"{_MP('net_income')} - {_M('net_income')} >= 1", f"{_MP('net_income')} - {_M('net_income')} >= 5", f"{_M('net_income')} - {_MP('net_income')}"),
    ("revenue_decline", f"{_CHG('revenue')} < 0", f"{_CHG('revenue')} <= -10", _CHG("revenue")),
    ("profit_decline_despite_growth", f"{_CHG('net_income')} <= -5 AND {_CHG('revenue')} > 0", "", _CHG("net_income")),
    ("net_loss", "net_income < 0", "true", "net_income"),
    ("tight_liquidity", f"{_LIQ} < 1.2", f"{_LIQ} < 1", _LIQ),
    ("receivables_build_up", f"{_CHG('receivables')} - {_CHG('revenue')} >= 10", "low", _CHG("receivables")),
    ("inventory_build_up", f"{_CHG('inventory')} - {_CHG('revenue')} >= 10", "low", _CHG("inventory")),
]


def _risk_sql() -> str:
    parts = []
    for i, (key, fires, high, measure) in enumerate(_RULES_SQL):
        severity = "'low'" if high == "low" else f"CASE WHEN {high} THEN 'high' ELSE 'medium' END" if high else "'medium'"
        parts.append(f"SELECT company_id, fiscal_year, {i} AS rule, '{key}' AS key, {severity} AS severity, {measure} AS measure FROM dated WHERE {fires}")
    return f"""{SQL_WITH}, s AS ({" UNION ALL ".join(parts)})
SELECT company_id, fiscal_year, row_number() OVER (PARTITION BY company_id, fiscal_year ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, rule)::INT AS place, key, severity, measure FROM s"""


def _missing_sql() -> str:
    columns = {c: c if not c.startswith("prev_") else f"p_{c[5:]}" for inputs in _RATIO_INPUTS.values() for c in inputs}
    parts = [f"SELECT company_id, fiscal_year, '{k}' AS ratio, concat_ws(',', " + ", ".join(f"CASE WHEN {columns[i]} IS NULL THEN '{i}' END" for i in inputs) + ") AS missing FROM dated" for k, inputs in _RATIO_INPUTS.items()]
    return f"{SQL_WITH} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE missing <> ''"


QUERIES = {name: value for name, value in list(globals().items()) if callable(value) and getattr(value, "__module__", "") == __name__ and not name.startswith("_")}

ORACLE_SQL = {
    "flagship_debt_to_equity": f"{SQL_WITH} SELECT company_id, company, fiscal_year, total_debt, equity, debt_to_equity, coalesce({_group('debt_to_equity', 2)} || 'x', 'Not available') AS display FROM rated",
    "best_fact_argmax": f"{SQL_WITH} SELECT company_id, fiscal_year, metric, document_id, value, confidence FROM best",
    "derived_metrics_panel": f"{SQL_WITH} SELECT company_id, fiscal_year, {', '.join(f.SNAPSHOT)}, total_liabilities FROM panel",
    "ratio_panel_all18": f"{SQL_WITH} SELECT company_id, fiscal_year, {', '.join(_RATIO_KEYS)} FROM rated",
    "ratio_missing_inputs": _missing_sql(),
    "kpi_snapshot": f"""{SQL_WITH} SELECT company_id, fiscal_year, {", ".join(f.KPIS)},
      CASE WHEN eps IS NULL THEN 'Not available' WHEN abs(eps) >= 100 AND eps = floor(eps) THEN {_group("eps", 0)} ELSE {_group("eps", 2)} END AS eps_text,
      coalesce({_group("roe", 2)} || '%', 'Not available') AS roe_text,
      coalesce(CASE WHEN revenue_growth > 0 THEN '+' ELSE '' END || {_group("revenue_growth", 2)} || '%', 'Not available') AS revenue_change
      FROM rated QUALIFY fiscal_year = max(fiscal_year) OVER (PARTITION BY company_id)""",
    "yoy_trend_changes": f"{SQL_WITH}, {_POINTS_SQL} SELECT company_id, key, fiscal_year, value, change FROM moved",
    "trend_direction": f"""{SQL_WITH}, {_POINTS_SQL}, g AS (
      SELECT company_id, key, unit, count(value) AS n_points, min(fiscal_year) FILTER (value IS NOT NULL) AS y0, max(fiscal_year) FILTER (value IS NOT NULL) AS y1,
        arg_min(value, fiscal_year) AS a, arg_max(value, fiscal_year) AS b, count(change) AS n, max(abs(change)) AS most, min(change) AS low, max(change) AS high FROM moved GROUP BY ALL)
      SELECT company_id, key, n_points, CASE WHEN n_points >= 2 THEN y1 - y0 END AS years, CASE WHEN n_points < 2 THEN 'insufficient_data' WHEN n > 0 AND most < CASE unit WHEN '%' THEN 0.5 ELSE 2 END THEN 'stable'
        WHEN n > 0 AND low > 0 THEN 'increasing' WHEN n > 0 AND high < 0 THEN 'decreasing' WHEN b > a THEN 'mixed_up' WHEN b < a THEN 'mixed_down' ELSE 'mixed' END AS direction FROM g""",
    "trend_cagr": f"""{SQL_WITH}, {_AMOUNTS_SQL}, g AS (
      SELECT company_id, key, count(value) AS n, (max(fiscal_year) FILTER (value IS NOT NULL) - min(fiscal_year) FILTER (value IS NOT NULL)) AS y, arg_min(value, fiscal_year) AS a, arg_max(value, fiscal_year) AS b FROM amounts GROUP BY ALL)
      SELECT company_id, key, round(CASE WHEN n >= 2 AND a > 0 AND b > 0 AND y > 0 THEN (pow(b / a, 1.0::DOUBLE / y) - 1) * 100 END, 6) AS cagr FROM g""",
    "significant_moves": f"{SQL_WITH}, {_POINTS_SQL} SELECT company_id, key, fiscal_year, CASE WHEN change > 0 THEN 'rose' ELSE 'fell' END AS verb, change FROM moved WHERE abs(change) >= CASE unit WHEN '%' THEN 2 ELSE 15 END",
    "risk_signals_long": _risk_sql(),
    "compare_companies": f"""{SQL_WITH}, y AS (SELECT max(fiscal_year) AS y FROM (SELECT fiscal_year FROM rated WHERE company_id IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT company_id) = 3)),
      {_series_sql("long2", f.COMPARED, "rated")} SELECT key, {", ".join(f"max(value) FILTER (company_id = {c}) AS c_{c}" for c in COMPANIES)} FROM long2, y WHERE fiscal_year = y AND company_id IN (1, 2, 3) GROUP BY key""",
    "compare_periods": f"""{SQL_WITH}, {_series_sql("long2", f.COMPARED, "rated")}, p AS (
      SELECT company_id, key, max(value) FILTER (fiscal_year = {FIRST}) AS first_value, max(value) FILTER (fiscal_year = {LAST}) AS last_value FROM long2 WHERE fiscal_year IN ({FIRST}, {LAST}) GROUP BY ALL)
      SELECT *, CASE WHEN key IN {_PERCENTS} THEN last_value - first_value ELSE (last_value - first_value) / nullif(abs(first_value), 0) * 100 END AS change FROM p""",
    "project_cagr": f"""{SQL_WITH}, {_series_sql("long2", ["revenue", "ebitda"], "panel")}, g AS (
      SELECT company_id, key, arg_min(value, fiscal_year) AS a, arg_max(value, fiscal_year) AS b, min(fiscal_year) AS y0, max(fiscal_year) AS y1 FROM long2 WHERE value IS NOT NULL GROUP BY ALL)
      SELECT company_id, key, 'FY' || (y1 + i) || 'E' AS label, (y1 + i)::INT AS fiscal_year, round(b * pow(pow(b / a, 1.0::DOUBLE / (y1 - y0)), i), 6) AS value FROM g, (SELECT unnest([1, 2]) AS i) WHERE a > 0 AND b > 0 AND y1 > y0""",
    "project_linear": f"""{SQL_WITH}, {_series_sql("long2", ["revenue", "ebitda"], "panel")}
      SELECT company_id, key, (max(fiscal_year) + 1)::INT AS fiscal_year, round(regr_intercept(value, fiscal_year) + regr_slope(value, fiscal_year) * (max(fiscal_year) + 1), 4) AS value
      FROM long2 WHERE value IS NOT NULL GROUP BY company_id, key HAVING count(*) >= 3""",
    "statement_pivot": f"""{SQL_WITH}, all_metrics AS (SELECT *, {", ".join(f"NULL::DOUBLE AS {m}" for m in f.METRICS if m not in [*_REPORTED, "total_debt", "gross_profit", "ebit", "ebitda", "free_cash_flow", "total_liabilities"])} FROM panel),
      {_series_sql("long2", f.METRICS, "all_metrics")} {_pivot_sql(_FY, "company_id, key")}""",
    "ratio_pivot": f"{SQL_WITH}, {_series_sql('long2', _RATIO_KEYS, 'rated')} {_pivot_sql(_FY, 'company_id, key')}",
    "majority_unit_currency": f"""{SQL_WITH}, r AS (FROM facts WHERE metric NOT IN ('eps', 'eps_diluted')), u AS (
      SELECT company_id, unit, count(*) AS unit_votes FROM r WHERE unit <> '' GROUP BY company_id, unit QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY unit_votes DESC, unit) = 1), c AS (
      SELECT company_id, currency, count(*) AS currency_votes FROM r WHERE currency <> '' GROUP BY company_id, currency QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY currency_votes DESC, currency) = 1)
      SELECT u.company_id, unit, unit_votes, currency, currency_votes FROM u JOIN c ON u.company_id = c.company_id""",
    "pick_period": f"{SQL_WITH} SELECT company_id, fiscal_year, p_fiscal_year AS previous_year, revenue, p_revenue AS previous_revenue FROM dated WHERE fiscal_year = 1998",
    "spotlight_company": f"{SQL_WITH} SELECT company_id, count(DISTINCT fiscal_year) AS n_years, max(document_id) AS last_document FROM facts GROUP BY 1 ORDER BY 2 DESC, 3 DESC LIMIT 1",
    "company_summary": f"{SQL_WITH} SELECT company_id, company, count(DISTINCT document_id) AS n_documents, count(*) AS n_facts, string_agg(DISTINCT fiscal_year::VARCHAR, ',' ORDER BY fiscal_year::VARCHAR) AS years FROM facts GROUP BY ALL",
    "year_sets": f"""{SQL_WITH}, a AS (SELECT DISTINCT fiscal_year FROM facts WHERE company_id = 1), b AS (SELECT DISTINCT fiscal_year FROM facts WHERE company_id = 5 AND metric = 'eps')
      SELECT fiscal_year, 'both' AS side FROM (FROM a INTERSECT FROM b) UNION ALL SELECT fiscal_year, 'first' AS side FROM (FROM a EXCEPT FROM b)""",
    "status_counts": "SELECT o_orderstatus AS status, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY ALL",
    "stuck_work": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 30 DAYS GROUP BY ALL",
    "search_filter_in_and": """SELECT o_orderpriority, c_mktsegment, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey
      WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL""",
    "company_documents": "SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_orderdate)::DATE::VARCHAR AS last_date FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
    "orphan_companies": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
}
