"""How well an answer is supported, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import sentences, tokens

#: Markup that says nothing, figures, lines that claim nothing, and when a statement is supported or is one.
MARKUP = r"\[[SCT]\d+(?:\s*,\s*[SCT]\d+)*\]|[*_#>`|]"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
NO_CLAIM = r"^[#|_>]"
SUPPORTED, LEAST_TERMS = 0.6, 3


def statements(answer: Column) -> Column:
    """The claims of an answer: sentences of three terms or more, without markup; headings, table rows and notes make none."""
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    claims = F.filter(lines, lambda x: (x != "") & ~x.rlike(NO_CLAIM))
    said = F.flatten(F.transform(claims, lambda x: sentences(F.regexp_replace(F.regexp_replace(x, MARKUP, " "), r"^[ \-•]+|[ \-•]+$", ""))))
    return F.filter(said, lambda x: F.size(tokens(x)) >= LEAST_TERMS)


def numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def faithfulness(answer: Column, context: Column) -> Column:
    """The share of statements most of whose terms and all of whose figures the context holds; 0 without statements."""
    said, terms, figures = statements(answer), F.array_distinct(tokens(context)), numbers(context)

    def supported(x: Column) -> Column:
        own = F.array_distinct(tokens(x))
        return (F.size(F.array_intersect(own, terms)) / F.size(own) >= SUPPORTED) & (F.size(F.array_except(numbers(x), figures)) == 0)

    return F.when(F.size(said) > 0, F.size(F.filter(said, supported)) / F.size(said)).otherwise(0.0)


def relevance(question: Column, answer: Column) -> Column:
    """The share of the question's terms that the answer takes up; 0 without terms."""
    asked = F.array_distinct(tokens(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(F.regexp_replace(answer, MARKUP, " ")))) / F.size(asked)).otherwise(0.0)


def key_fact_recall(answer: Column, facts: Column) -> Column:
    """The share of the facts that the answer states word by word, whatever the case and blanks; 0 without facts."""
    said = F.regexp_replace(F.lower(answer), r"\s+", " ")
    return F.when(F.size(facts) > 0, F.size(F.filter(facts, lambda f: said.contains(F.lower(f)))) / F.size(facts)).otherwise(0.0)


def citation_precision(citations: Column, document: Column) -> Column:
    """The share of citations (document, page, page_end) of the expected document; 0 without citations."""
    return F.when(F.size(citations) > 0, F.size(F.filter(citations, lambda c: c["document"] == document)) / F.size(citations)).otherwise(0.0)


def page_hit(citations: Column, document: Column, page: Column) -> Column:
    """1 if a citation of the expected document covers the page, else 0."""
    hit = F.exists(citations, lambda c: (c["document"] == document) & (c["page"] <= page) & (page <= F.coalesce(c["page_end"], c["page"])))
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)
