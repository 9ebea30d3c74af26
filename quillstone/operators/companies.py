"""Companies that questions name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import company_key
from quillstone.operators.retrieval import small

#: A first word of so many letters stands for a company if no other begins with it.
SHORT_NAME = 4


def known_names(companies: DataFrame) -> DataFrame:
    """(company_id, key) of (company_id, name): the whole key, and the first word if it is long and no other company's."""
    keys = companies.select("company_id", company_key(F.col("name")).alias("key")).where("key <> ''")
    first = keys.select("company_id", F.split("key", " ")[0].alias("key"))
    alone = first.groupBy("key").agg(F.count("*").alias("n"), F.min("company_id").alias("company_id")).where((F.col("n") == 1) & (F.length("key") >= SHORT_NAME))
    return keys.unionByName(alone.select("company_id", "key")).distinct()


def mentioned(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(query_id, company_id, place): the companies that (query_id, text) names, in order.

    Runs of a question's words, as long as the longest name, are joined with the
    names, so questions and companies may both be many.
    """
    names = known_names(companies)
    longest = names.agg(F.coalesce(F.max(F.size(F.split("key", " "))), F.lit(1))).first()[0]
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9&]+", " ")), " ")
    starts = F.sequence(F.lit(1), F.size("words"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words") - i + 1)), lambda n: F.struct(i.alias("at"), F.array_join(F.slice("words", i, n), " ").alias("key")))))
    said = questions.select("query_id", words.alias("words")).select("query_id", F.explode(runs).alias("r")).select("query_id", "r.at", "r.key")
    first = said.join(small(names), "key").groupBy("query_id", "company_id").agg(F.min("at").alias("at"))
    return first.select("query_id", "company_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "company_id")).alias("place"))
