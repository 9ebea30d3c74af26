"""Registered queries over labels, document types and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import labels
from quillstone.operators.chunking import chunked
from quillstone.sources.tables import table


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as statement rows: a known label in several dresses."""
    known = [s for s, _ in labels.taxonomy()]
    label = F.element_at(F.array(*[F.lit(s) for s in known]), (F.col("p_partkey") % len(known) + 1).cast("int"))
    kind = F.floor(F.col("p_partkey") / len(known)) % 5
    shown = (
        F.when(kind == 0, F.initcap(label)).when(kind == 1, F.concat(F.lit("Total "), label)).when(kind == 2, F.concat(label, F.lit(" for the year"))).when(kind == 3, F.concat(label, F.lit(" growth")))
        .otherwise(F.concat(F.lit("(a) "), label, F.lit(" (Refer note 5)")))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", shown.alias("label"))
    return labels.with_metrics(rows, "label").select("p_partkey", "metric", "confidence")


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under names of several kinds."""
    names = ["annual_report_2024.pdf", "q3-earnings.call.txt", "notes.txt", "investor-day.pdf"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 4 + 1).cast("int"))
    said = F.element_at(F.array(F.lit(""), F.lit("Prepared remarks. Balance sheet, balance sheet. ")), (F.col("doc_id") % 2 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", labels.document_type(F.concat(said, "text"), name).alias("kind"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "n_tokens", F.md5("text").alias("digest"))


QUERIES = {"label_match": label_match, "classify_documents": classify_documents, "chunk_documents": chunk_documents}

_TAX_SQL = "tax(syn, metric, place) AS (VALUES " + ", ".join(f"('{s}', '{m}', {i})" for i, (s, m) in enumerate(labels.taxonomy())) + ")"
_N = len(labels.taxonomy())


def _count(text: str, phrase: str) -> str:
    return f"least(3, (length({text}) - length(replace({text}, '{phrase}', ''))) // length('{phrase}'))"


def _types_sql() -> str:
    parts = []
    for i, (kind, strong, weak) in enumerate(labels.TYPES):
        strong, weak = ([p.replace("'", "''") for p in x] for x in (strong, weak))
        points = [f"CASE WHEN contains(name, '{p}') THEN 10 ELSE 0 END + CASE WHEN contains(head, '{p}') THEN 6 ELSE 0 END + {_count('body', p)}" for p in strong] + [f"CASE WHEN contains(body, '{p}') THEN 1 ELSE 0 END" for p in weak]
        parts.append(f"SELECT doc_id, {i} AS o, '{kind}' AS kind, {' + '.join(points)} AS score FROM d")
    return f"""WITH t AS (SELECT doc_id, ['', 'Prepared remarks. Balance sheet, balance sheet. '][(doc_id % 2 + 1)::INT] || text AS text, regexp_replace(lower(['annual_report_2024.pdf', 'q3-earnings.call.txt', 'notes.txt', 'investor-day.pdf'][(doc_id % 4 + 1)::INT]), '[_\\-.]+', ' ', 'g') AS name FROM documents),
      d AS (SELECT doc_id, name, lower(text[:1500]) AS head, lower(text[:40000]) AS body FROM t), s AS ({" UNION ALL ".join(parts)})
      SELECT doc_id, CASE WHEN score < 3 THEN 'other' ELSE kind END AS kind FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) = 1"""


ORACLE_SQL = {
    "label_match": f"""WITH {_TAX_SQL}, l AS (SELECT p_partkey, (p_partkey // {_N}) % 5 AS kind, syn, CASE (p_partkey // {_N}) % 5 WHEN 1 THEN 'total ' || syn WHEN 2 THEN syn || ' for the year' WHEN 3 THEN syn || ' growth' ELSE syn END AS norm
      FROM part JOIN tax ON place = p_partkey % {_N}), near AS (
      SELECT p_partkey, tax.metric FROM l JOIN tax ON contains(tax.syn, ' ') AND ((starts_with(norm, tax.syn || ' ') AND regexp_matches(norm[length(tax.syn) + 2:], '{labels.AFTER}'))
        OR (suffix(norm, ' ' || tax.syn) AND NOT starts_with(norm, tax.syn || ' ') AND regexp_matches(norm[:length(norm) - length(tax.syn) - 1], '{labels.BEFORE}')))
      QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(tax.syn) DESC, tax.syn) = 1)
      SELECT l.p_partkey, CASE WHEN e.metric IS NOT NULL THEN e.metric WHEN starts_with(norm, 'changes in inventories') THEN 'inventory_change' WHEN regexp_matches(norm, '{labels.BLOCKED}') THEN NULL ELSE near.metric END AS metric,
        CASE WHEN e.metric IS NOT NULL THEN 1.0 WHEN starts_with(norm, 'changes in inventories') THEN 0.9 WHEN regexp_matches(norm, '{labels.BLOCKED}') OR near.metric IS NULL THEN NULL ELSE 0.85 END::DOUBLE AS confidence
      FROM l LEFT JOIN tax e ON e.syn = norm LEFT JOIN near ON near.p_partkey = l.p_partkey""",
    "classify_documents": _types_sql(),
}
