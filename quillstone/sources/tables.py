"""Readers of the engine's tables, and the fact table that is built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Partitions of a scan up to which it is dealt anew if there are more cores; so only some gigabytes ever are.
FEW_PARTITIONS = 16


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores if the files give fewer tasks, as a file with a single row group does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    return df.repartition(cores) if parts < cores and parts <= FEW_PARTITIONS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(amount: Column) -> Column:
    """Whole cents, so that sums don't depend on their order."""
    return F.round(amount).cast("long")


def _sum_when(amount: Column, when: Column | None = None) -> Column:
    return F.sum(amount if when is None else F.when(when, amount))


#: How sure a document of each priority is.
CONFIDENCE = {"1-URGENT": 0.95, "2-HIGH": 0.9, "3-MEDIUM": 0.85, "4-NOT SPECIFIED": 0.8, "5-LOW": 0.75}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table: a company is a supplier's nation, a document one order priority of a year.

    (company_id, company, document_id, document_type, document_year, uploaded_at,
    metric, fiscal_year, value, scale, unit, currency, confidence); value is in
    the reported unit.  Amounts are summed in whole cents.
    """
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    price, off, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    number = F.col("l_linenumber")
    rows = (
        line.join(order.select("o_orderkey", "o_orderpriority", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    sums = rows.groupBy("s_nationkey", F.year("l_shipdate").alias("fiscal_year"), "o_orderpriority").agg(
        F.max("o_orderdate").alias("uploaded_at"),
        F.sum(F.col("l_quantity").cast("long")).alias("shares"),
        _sum_when(_cents(price * (1 - off) * 100)).alias("revenue"),
        _sum_when(_cents(price * 60)).alias("cogs"),
        _sum_when(_cents(price * 4)).alias("depreciation"),
        (-_sum_when(_cents(price * off * 30))).alias("finance_costs"),
        _sum_when(_cents(price * tax * 50)).alias("tax_expense"),
        _sum_when(_cents(price * (1 - off) * 100), F.col("l_linestatus") == "O").alias("receivables"),
        _sum_when(_cents(price * 40), F.col("l_returnflag") == "R").alias("inventory"),
        _sum_when(_cents(price * 10), F.col("l_returnflag") == "A").alias("cash"),
        _sum_when(_cents(price * 55), number <= 2).alias("current_liabilities"),
        _sum_when(_cents(price * 20), number == 3).alias("short_term_debt"),
        _sum_when(_cents(price * 45), number == 4).alias("long_term_debt"),
        _sum_when(_cents(price * 80), number >= 5).alias("equity"),
        _sum_when(_cents(price * 90)).alias("fixed_assets"),
        _sum_when(_cents(price * 12), off < 0.05).alias("cfo"),
        (-_sum_when(_cents(price * 9), F.col("l_quantity") > 25)).alias("capex"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    sums = (
        sums.withColumn("pbt", F.col("revenue") - F.col("cogs") - F.col("depreciation"))
        .withColumn("net_income", F.col("pbt") - F.col("tax_expense"))
        .withColumn("current_assets", zero("receivables") + zero("inventory") + zero("cash"))
        .withColumn("total_assets", F.col("current_assets") + F.col("fixed_assets"))
        .withColumn("inventory", F.when(F.col("s_nationkey") % 5 != 0, F.col("inventory")))
    )
    amounts = [
        "revenue", "cogs", "depreciation", "finance_costs", "tax_expense", "pbt", "net_income", "receivables", "inventory", "cash", "current_assets",
        "current_liabilities", "short_term_debt", "long_term_debt", "equity", "total_assets", "cfo", "capex",
    ]
    even = F.col("s_nationkey") % 2 == 0
    scale = F.when(even, 1e7).otherwise(1e6)
    eps = F.when((F.col("fiscal_year") != 1997) & (F.col("shares") > 0), F.col("net_income").cast("double") / 100 / F.col("shares"))
    values = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m).cast("double") / 100 / scale).alias("value"), scale.alias("scale")) for m in amounts], F.struct(F.lit("eps").alias("metric"), eps.alias("value"), F.lit(1.0).alias("scale")))
    confidence = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    late = F.col("o_orderpriority") == "5-LOW"
    return (
        sums.join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("*", F.explode(values).alias("fact"))
        .where("fact.value is not null")
        .select(
            F.col("s_nationkey").alias("company_id"),
            F.col("n_name").alias("company"),
            F.concat_ws("/", F.col("s_nationkey"), F.col("fiscal_year"), "o_orderpriority").alias("document_id"),
            F.when(F.substring("o_orderpriority", 1, 1).isin("1", "3"), "annual_report").otherwise("quarterly_report").alias("document_type"),
            F.when(late, F.col("fiscal_year") - 1).otherwise(F.col("fiscal_year")).alias("document_year"),
            "uploaded_at",
            "fact.metric",
            "fiscal_year",
            "fact.value",
            "fact.scale",
            F.when(F.col("fact.scale") == 1.0, "").when(even, "crore").otherwise("million").alias("unit"),
            F.when(even, "INR").otherwise("USD").alias("currency"),
            F.coalesce(F.element_at(confidence, F.col("o_orderpriority")), F.lit(0.5)).alias("confidence"),
        )
    )


#: The same table in SQL.
FACTS_SQL = """
sums AS (
  SELECT s_nationkey, year(l_shipdate)::INT AS fiscal_year, o_orderpriority, max(o_orderdate) AS uploaded_at, sum(l_quantity::BIGINT)::BIGINT AS shares,
    sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT AS revenue, sum(round(l_extendedprice * 60)::BIGINT)::BIGINT AS cogs,
    sum(round(l_extendedprice * 4)::BIGINT)::BIGINT AS depreciation, -sum(round(l_extendedprice * l_discount * 30)::BIGINT)::BIGINT AS finance_costs,
    sum(round(l_extendedprice * l_tax * 50)::BIGINT)::BIGINT AS tax_expense,
    sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT) FILTER (l_linestatus = 'O')::BIGINT AS receivables,
    sum(round(l_extendedprice * 40)::BIGINT) FILTER (l_returnflag = 'R')::BIGINT AS inventory0, sum(round(l_extendedprice * 10)::BIGINT) FILTER (l_returnflag = 'A')::BIGINT AS cash,
    sum(round(l_extendedprice * 55)::BIGINT) FILTER (l_linenumber <= 2)::BIGINT AS current_liabilities,
    sum(round(l_extendedprice * 20)::BIGINT) FILTER (l_linenumber = 3)::BIGINT AS short_term_debt, sum(round(l_extendedprice * 45)::BIGINT) FILTER (l_linenumber = 4)::BIGINT AS long_term_debt,
    sum(round(l_extendedprice * 80)::BIGINT) FILTER (l_linenumber >= 5)::BIGINT AS equity, sum(round(l_extendedprice * 90)::BIGINT)::BIGINT AS fixed_assets,
    sum(round(l_extendedprice * 12)::BIGINT) FILTER (l_discount < 0.05)::BIGINT AS cfo, -sum(round(l_extendedprice * 9)::BIGINT) FILTER (l_quantity > 25)::BIGINT AS capex
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
), more AS (
  SELECT *, revenue - cogs - depreciation AS pbt, revenue - cogs - depreciation - tax_expense AS net_income,
    coalesce(receivables, 0) + coalesce(inventory0, 0) + coalesce(cash, 0) AS current_assets, coalesce(receivables, 0) + coalesce(inventory0, 0) + coalesce(cash, 0) + fixed_assets AS total_assets,
    CASE WHEN s_nationkey % 5 <> 0 THEN inventory0 END AS inventory, CASE WHEN s_nationkey % 2 = 0 THEN 1e7 ELSE 1e6 END AS big FROM sums
), long AS (
  SELECT s_nationkey, fiscal_year, o_orderpriority, uploaded_at, metric, cents::DOUBLE / 100 / big AS value, big AS scale FROM (UNPIVOT more ON revenue, cogs, depreciation, finance_costs, tax_expense, pbt, net_income,
    receivables, inventory, cash, current_assets, current_liabilities, short_term_debt, long_term_debt, equity, total_assets, cfo, capex INTO NAME metric VALUE cents)
  UNION ALL BY NAME
  SELECT s_nationkey, fiscal_year, o_orderpriority, uploaded_at, 'eps' AS metric, net_income::DOUBLE / 100 / shares AS value, 1.0 AS scale FROM more WHERE fiscal_year <> 1997 AND shares > 0
), facts AS MATERIALIZED (
  SELECT s_nationkey AS company_id, n_name AS company, concat_ws('/', s_nationkey, fiscal_year, o_orderpriority) AS document_id,
    CASE WHEN o_orderpriority[1] IN ('1', '3') THEN 'annual_report' ELSE 'quarterly_report' END AS document_type,
    CASE WHEN o_orderpriority = '5-LOW' THEN fiscal_year - 1 ELSE fiscal_year END AS document_year, uploaded_at, metric, fiscal_year, value, scale,
    CASE WHEN scale = 1 THEN '' WHEN s_nationkey % 2 = 0 THEN 'crore' ELSE 'million' END AS unit, CASE WHEN s_nationkey % 2 = 0 THEN 'INR' ELSE 'USD' END AS currency,
    CASE o_orderpriority WHEN '1-URGENT' THEN 0.95 WHEN '2-HIGH' THEN 0.9 WHEN '3-MEDIUM' THEN 0.85 WHEN '4-NOT SPECIFIED' THEN 0.8 WHEN '5-LOW' THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence
  FROM long JOIN nation ON s_nationkey = n_nationkey WHERE value IS NOT NULL
)"""
