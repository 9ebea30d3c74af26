"""From facts to ratios, trends, signals, comparisons and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.numeric import change, growth_rate, percent, ratio

#: The canonical metrics in statement order.
METRICS = (
    "revenue other_income total_income cogs materials_consumed purchases_stock_in_trade inventory_change gross_profit operating_expenses total_expenses ebitda depreciation ebit finance_costs "
    "pbt tax_expense net_income eps eps_diluted cash inventory receivables current_assets non_current_assets total_assets short_term_debt long_term_debt total_debt current_liabilities "
    "non_current_liabilities total_liabilities equity cfo cfi cff capex free_cash_flow"
).split()
PER_SHARE = ("eps", "eps_diluted")

#: Metrics and ratios of a comparison, of the KPI row and of a snapshot.
COMPARED = "revenue revenue_growth ebitda ebitda_margin net_income net_margin total_debt debt_to_equity roe roa cfo free_cash_flow eps".split()
KPIS = "revenue ebitda net_income eps roe debt_to_equity free_cash_flow".split()
SNAPSHOT = "revenue gross_profit ebitda ebit net_income eps total_assets equity total_debt cash cfo capex free_cash_flow".split()


def best_facts(facts: DataFrame) -> DataFrame:
    """One fact for each company, year and metric: a document of that year first, then the surer, the annual report, the newer, the smaller id."""
    order = Window.partitionBy("company_id", "fiscal_year", "metric").orderBy(
        (F.coalesce(F.col("document_year") == F.col("fiscal_year"), F.lit(False))).desc(), F.desc("confidence"), (F.col("document_type") == "annual_report").desc(), F.desc("uploaded_at"), "document_id"
    )
    return facts.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def panel(best: DataFrame) -> DataFrame:
    """A row for each company and year, a column for each metric; derived metrics fill what is not reported."""
    wide = best.groupBy("company_id", "company", "fiscal_year").pivot("metric", METRICS).agg(F.first("value"))
    return derived(wide)


def derived(wide: DataFrame) -> DataFrame:
    """Missing line items from reported ones, in a fixed order; reported values stay."""
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    formulas: list[tuple[str, Column]] = [
        ("total_debt", F.when(F.col("short_term_debt").isNotNull() | F.col("long_term_debt").isNotNull(), zero("short_term_debt") + zero("long_term_debt"))),
        ("cogs", F.col("materials_consumed") + zero("purchases_stock_in_trade") + zero("inventory_change")),
        ("gross_profit", F.col("revenue") - F.col("cogs")),
        ("ebit", F.coalesce(F.col("pbt") + F.abs("finance_costs"), F.col("total_income") - F.col("total_expenses") + F.abs("finance_costs"))),
        ("ebitda", F.col("ebit") + F.abs("depreciation")),
        ("free_cash_flow", F.col("cfo") - F.abs("capex")),
        ("total_liabilities", F.col("total_assets") - F.col("equity")),
    ]
    for name, formula in formulas:
        wide = wide.withColumn(name, F.coalesce(F.col(name), formula))
    return wide


def with_previous(wide: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """prev_<metric>: the value of exactly the year before, null if there is no such row."""
    by = Window.partitionBy("company_id").orderBy("fiscal_year").rangeBetween(-1, -1)
    return wide.select("*", *[F.first(c).over(by).alias(f"prev_{c}") for c in columns or METRICS])


#: The eighteen ratios: inputs, unit.
RATIOS = {
    "current_ratio": (("current_assets", "current_liabilities"), "x"),
    "quick_ratio": (("current_assets", "inventory", "current_liabilities"), "x"),
    "cash_ratio": (("cash", "current_liabilities"), "x"),
    "debt_to_equity": (("total_debt", "equity"), "x"),
    "debt_ratio": (("total_debt", "total_assets"), "x"),
    "interest_coverage": (("ebit", "finance_costs"), "x"),
    "gross_margin": (("gross_profit", "revenue"), "%"),
    "operating_margin": (("ebit", "revenue"), "%"),
    "net_margin": (("net_income", "revenue"), "%"),
    "ebitda_margin": (("ebitda", "revenue"), "%"),
    "roa": (("net_income", "total_assets"), "%"),
    "roe": (("net_income", "equity"), "%"),
    "asset_turnover": (("revenue", "total_assets"), "x"),
    "inventory_turnover": (("cogs", "inventory"), "x"),
    "receivables_turnover": (("revenue", "receivables"), "x"),
    "revenue_growth": (("revenue", "prev_revenue"), "%"),
    "profit_growth": (("net_income", "prev_net_income"), "%"),
    "eps_growth": (("eps", "prev_eps"), "%"),
}


def ratio_column(key: str) -> Column:
    """The ratio over a panel that has the inputs as columns."""
    inputs, unit = RATIOS[key]
    values = [F.col(i) for i in inputs]
    if inputs[1] == f"prev_{inputs[0]}":
        return change(*values)
    if len(inputs) == 3:  # what is left of the first without the second
        return ratio(values[0] - values[1], values[2])
    return percent(*values) if unit == "%" else ratio(*values)


def with_ratios(wide: DataFrame) -> DataFrame:
    return with_previous(wide).select("*", *[ratio_column(key).alias(key) for key in RATIOS])


def missing_inputs(wide: DataFrame) -> DataFrame:
    """(company_id, fiscal_year, ratio, missing): ratios that can't be computed, with the inputs that lack."""
    rows = [F.struct(F.lit(key).alias("ratio"), F.array_join(F.array_compact(F.array(*[F.when(F.col(i).isNull(), i) for i in inputs])), ",").alias("missing")) for key, (inputs, _) in RATIOS.items()]
    return with_previous(wide).select("company_id", "fiscal_year", F.explode(F.array(*rows)).alias("r")).select("company_id", "fiscal_year", "r.*").where("missing <> ''")


def series(wide: DataFrame, keys: list[str], unit: str = "") -> DataFrame:
    """(company_id, key, unit, fiscal_year, value) of columns of a panel; null values stay."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("s")
    return wide.select("company_id", "fiscal_year", rows).select("company_id", "s.key", F.lit(unit).alias("unit"), "fiscal_year", "s.value")


def changes(points: DataFrame) -> DataFrame:
    """Adds change: against the last present value if that is of the year before; a difference for percent series."""
    before = Window.partitionBy("company_id", "key").orderBy("fiscal_year").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("value").isNotNull(), F.struct("fiscal_year", "value")), ignorenulls=True).over(before)
    points = points.withColumn("last", last)
    step = F.when(F.col("unit") == "%", F.col("value") - F.col("last.value")).otherwise(change(F.col("value"), F.col("last.value")))
    return points.withColumn("change", F.when(F.col("fiscal_year") - F.col("last.fiscal_year") == 1, step)).drop("last")


def trends(points: DataFrame) -> DataFrame:
    """(company_id, key, unit, n_points, years, cagr, direction) of each series."""
    there = F.col("value").isNotNull()
    grouped = changes(points).groupBy("company_id", "key", "unit").agg(
        F.count("value").alias("n_points"),
        F.min_by(F.struct("fiscal_year", "value"), F.when(there, F.col("fiscal_year"))).alias("a"),
        F.max_by(F.struct("fiscal_year", "value"), F.when(there, F.col("fiscal_year"))).alias("b"),
        F.count("change").alias("n"),
        F.max(F.abs("change")).alias("most"),
        F.min("change").alias("low"),
        F.max("change").alias("high"),
    )
    some, enough = F.col("n") > 0, F.col("n_points") >= 2
    calm = F.when(F.col("unit") == "%", 0.5).otherwise(2.0)
    first, final = F.col("a.value"), F.col("b.value")
    direction = (
        F.when(~enough, "insufficient_data").when(some & (F.col("most") < calm), "stable").when(some & (F.col("low") > 0), "increasing").when(some & (F.col("high") < 0), "decreasing")
        .when(final > first, "mixed_up").when(final < first, "mixed_down").otherwise("mixed")
    )
    years = F.col("b.fiscal_year") - F.col("a.fiscal_year")
    return grouped.select("company_id", "key", "unit", "n_points", F.when(enough, years).alias("years"), F.when(enough & (F.col("unit") != "%"), growth_rate(first, final, years)).alias("cagr"), direction.alias("direction"))


def significant(points: DataFrame) -> DataFrame:
    """Changes of 15 percent or 2 points and more."""
    limit = F.when(F.col("unit") == "%", 2.0).otherwise(15.0)
    return changes(points).where(F.abs("change") >= limit).withColumn("verb", F.when(F.col("change") > 0, "rose").otherwise("fell"))


def risk_signals(wide: DataFrame) -> DataFrame:
    """(company_id, fiscal_year, place, key, severity, measure): signals of each year by severity, then by rule."""
    need = ["total_debt", "equity", "ebit", "finance_costs", "cfo", "revenue", "net_income", "receivables", "inventory"]
    rows = with_previous(wide, need)
    now, was = (lambda c: F.col(c)), (lambda c: F.col(f"prev_{c}"))
    moved = lambda c: change(now(c), was(c))
    de, de_was = ratio(now("total_debt"), now("equity")), ratio(was("total_debt"), was("equity"))
    cover, cover_was = ratio(now("ebit"), now("finance_costs")), ratio(was("ebit"), was("finance_costs"))
    rising = F.coalesce((moved("total_debt") >= 10) & (de > de_was), F.lit(False))
    weak = F.coalesce(cover < 3.0, F.lit(False))
    burning = F.coalesce(now("cfo") < 0, F.lit(False))
    liquid = ratio(now("current_assets"), now("current_liabilities"))
    fell = lambda c: percent(was(c), was("revenue")) - percent(now(c), now("revenue"))
    drop = lambda c: percent(now(c), now("revenue")) - percent(was(c), was("revenue"))
    high = lambda condition: F.when(condition, "high").otherwise("medium")
    rules: list[tuple[str, Column, Column, Column]] = [
        ("rising_leverage", rising, high((de > 1.5) | (moved("total_debt") >= 40)), moved("total_debt")),
        ("high_leverage", ~rising & (de > 1.0), high(de > 2.0), de),
        ("weak_interest_coverage", weak, high(cover < 1.5), cover),
        ("declining_interest_coverage", ~weak & (cover <= cover_was * 0.75), F.lit("medium"), cover),
        ("negative_operating_cash_flow", burning, F.lit("high"), now("cfo")),
        ("declining_operating_cash_flow", ~burning & (moved("cfo") <= -10), F.lit("medium"), moved("cfo")),
        ("negative_free_cash_flow", now("free_cash_flow") < 0, F.lit("medium"), now("free_cash_flow")),
        ("operating_margin_compression", fell("ebit") >= 1.0, high(fell("ebit") >= 5.0), drop("ebit")),
        ("net_margin_compression", fell("net_income") >= 1.0, high(fell("net_income") >= 5.0), drop("net_income")),
        ("revenue_decline", moved("revenue") < 0, high(moved("revenue") <= -10), moved("revenue")),
        ("profit_decline_despite_growth", (moved("net_income") <= -5) & (moved("revenue") > 0), F.lit("medium"), moved("net_income")),
        ("net_loss", now("net_income") < 0, F.lit("high"), now("net_income")),
        ("tight_liquidity", liquid < 1.2, high(liquid < 1.0), liquid),
        ("receivables_build_up", moved("receivables") - moved("revenue") >= 10, F.lit("low"), moved("receivables")),
        ("inventory_build_up", moved("inventory") - moved("revenue") >= 10, F.lit("low"), moved("inventory")),
    ]
    found = [F.when(fires, F.struct(F.lit(i).alias("rule"), F.lit(key).alias("key"), severity.alias("severity"), measure.alias("measure"))) for i, (key, fires, severity, measure) in enumerate(rules)]
    signals = rows.select("company_id", "fiscal_year", F.explode(F.array_compact(F.array(*found))).alias("s")).select("company_id", "fiscal_year", "s.*")
    weight = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("company_id", "fiscal_year").orderBy(weight, "rule"))
    return signals.select("company_id", "fiscal_year", place.alias("place"), "key", "severity", "measure")


def shared_year(wide: DataFrame, companies: list[int]) -> DataFrame:
    """(fiscal_year): the last year that all the companies have."""
    each = wide.where(F.col("company_id").isin(companies)).groupBy("fiscal_year").agg(F.countDistinct("company_id").alias("n"))
    return each.where(F.col("n") == len(companies)).agg(F.max("fiscal_year").alias("fiscal_year"))


def compared_companies(with_all: DataFrame, companies: list[int]) -> DataFrame:
    """(key, c_<id>...): the comparison keys of the last shared year, a column for each company."""
    year = shared_year(with_all, companies)
    rows = with_all.where(F.col("company_id").isin(companies)).join(F.broadcast(year), "fiscal_year")  # a single row
    long = series(rows, COMPARED)
    return long.groupBy("key").pivot("company_id", companies).agg(F.first("value")).select("key", *[F.col(str(c)).alias(f"c_{c}") for c in companies])


def compared_periods(with_all: DataFrame, first: int, last: int) -> DataFrame:
    """(company_id, key, first_value, last_value, change): percent keys by difference, others by percent change, whatever the gap."""
    percents = [k for k in COMPARED if k in RATIOS and RATIOS[k][1] == "%"]
    long = series(with_all.where(F.col("fiscal_year").isin(first, last)), COMPARED)
    pairs = long.groupBy("company_id", "key").agg(F.max(F.when(F.col("fiscal_year") == first, F.col("value"))).alias("first_value"), F.max(F.when(F.col("fiscal_year") == last, F.col("value"))).alias("last_value"))
    step = F.when(F.col("key").isin(percents), F.col("last_value") - F.col("first_value")).otherwise(change(F.col("last_value"), F.col("first_value")))
    return pairs.withColumn("change", step)


def projected_growth(points: DataFrame, horizon: int = 2) -> DataFrame:
    """(company_id, key, label, fiscal_year, value): the last value carried on at the series' growth rate."""
    ends = points.where("value is not null").groupBy("company_id", "key").agg(F.min_by("value", "fiscal_year").alias("a"), F.max_by("value", "fiscal_year").alias("b"), F.min("fiscal_year").alias("y0"), F.max("fiscal_year").alias("y1"))
    rated = ends.withColumn("rate", growth_rate(F.col("a"), F.col("b"), F.col("y1") - F.col("y0"))).where("rate is not null")
    ahead = rated.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("i"))
    year = F.col("y1") + F.col("i")
    return ahead.select("company_id", "key", F.concat(F.lit("FY"), year.cast("string"), F.lit("E")).alias("label"), year.alias("fiscal_year"), (F.col("b") * F.pow(1 + F.col("rate") / 100, F.col("i"))).alias("value"))


def projected_line(points: DataFrame) -> DataFrame:
    """(company_id, key, fiscal_year, value): the next year on the least-squares line of three points or more."""
    there = points.where("value is not null")
    fit = there.groupBy("company_id", "key").agg(F.regr_slope("value", F.col("fiscal_year").cast("double")).alias("slope"), F.regr_intercept("value", F.col("fiscal_year").cast("double")).alias("intercept"), F.count("*").alias("n"), F.max("fiscal_year").alias("y"))
    return fit.where("n >= 3 and slope is not null").select("company_id", "key", (F.col("y") + 1).alias("fiscal_year"), (F.col("intercept") + F.col("slope") * (F.col("y") + 1)).alias("value"))


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, votes): the commonest value of each group; ties go to the smaller one."""
    votes = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("votes"))
    return votes.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("votes"), value))).where("place = 1").drop("place")
