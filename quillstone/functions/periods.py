"""Reporting periods that a text names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ways in which filings write a period, the surest first; each names its groups for quarter, year and end of a span.
_MONTH = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    r"sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?"
)
FORMS: tuple[tuple[str, int | None, int, int | None], ...] = (
    (r"(?i)\bQ([1-4])\s*[-/ ]?\s*(?:FY)?\s*'?(\d{4}|\d{2})\b", 1, 2, None),
    (r"(?i)\bFY\s*'?(\d{4}|\d{2})\s*[-/ ]?\s*Q([1-4])\b", 2, 1, None),
    (r"(?i)\bFY\s*'?(\d{4})\s*[-–/]\s*(\d{4}|\d{2})\b", None, 1, 2),
    (r"(?i)\bFY\s*'?(\d{4}|\d{2})\b", None, 1, None),
    (r"(?<![\d,.])((?:19|20)\d{2})\s*[-–/]\s*(\d{2})(?![\d,.])", None, 1, 2),
    (rf"(?i)\b(?:\d{{1,2}}(?:st|nd|rd|th)?\s+)?{_MONTH}\s*(?:\d{{1,2}}(?:st|nd|rd|th)?)?,?\s*((?:19|20)\d{{2}})\b", None, 1, None),
    (r"(?<![\d,.\-/])((?:19|20)\d{2})(?![\d,%/\-]|\.\d)", None, 1, None),
)
_DATE = 5
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
FIRST_YEAR, LAST_YEAR = 1980, 2100

_NONE = "array<struct<priority:int,start:int,end:int,year:int,quarter:int,dated:boolean>>"


def _year(raw: Column) -> Column:
    """Two digits below 80 belong to this century; null outside the years that a filing can name."""
    short = raw.try_cast("int")
    full = F.when(F.length(raw) == 4, short).otherwise(F.when(short < 80, short + 2000).otherwise(short + 1900))
    return F.when(full.between(FIRST_YEAR, LAST_YEAR), full)


def _read(said: Column, form: tuple[str, int | None, int, int | None]) -> tuple[Column, Column]:
    """Fiscal year and quarter of what one form matched; a span counts only if its years follow each other, and names the later."""
    pattern, quarter, year, end = form
    part = lambda i: F.regexp_extract(said, pattern, i)
    first = _year(part(year))
    if end:
        last = F.when(F.length(part(end)) == 4, part(end).try_cast("int")).otherwise(F.floor(first / 100).cast("int") * 100 + part(end).try_cast("int"))
        first = F.when(last == first + 1, last)
    return first, part(quarter).try_cast("int") if quarter else F.lit(None).cast("int")


def _candidates(text: Column, priority: int) -> Column:
    """Every match of one form with its place, which follows from the pieces of text between the matches."""
    form = FORMS[priority]
    said, between = F.regexp_extract_all(text, F.lit(form[0]), F.lit(0)), F.split(text, form[0], -1)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["between"])
        end = (start + F.length(pair["said"])).cast("int")
        year, quarter = _read(pair["said"], form)
        found = F.struct(F.lit(priority).alias("priority"), start.cast("int").alias("start"), end.alias("end"), year.alias("year"), quarter.alias("quarter"), F.lit(priority == _DATE).alias("dated"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).cast(_NONE).alias("found"))

    pairs = F.zip_with(said, F.slice(between, 1, F.size(said)), lambda s, b: F.struct(s.alias("said"), b.alias("between")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("found"))
    found = F.aggregate(pairs, begin, step, lambda state: state["found"])
    return F.when(F.size(said) > 0, F.filter(found, lambda c: c["year"].isNotNull())).otherwise(F.array().cast(_NONE))


def _accepted(found: Column) -> Column:
    """Of overlapping matches the one of the surer form, then the earlier."""
    def take(held: Column, c: Column) -> Column:
        overlaps = F.exists(held, lambda h: (c["start"] < h["end"]) & (c["end"] > h["start"]))
        return F.when(overlaps, held).otherwise(F.concat(held, F.array(c)))

    return F.aggregate(F.array_sort(found), F.array().cast(_NONE), take)


def label(year: Column, quarter: Column) -> Column:
    plain = F.concat(F.lit("FY"), year.cast("string"))
    return F.when(quarter.isNull(), plain).otherwise(F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), plain))


def periods(text: Column) -> Column:
    """Every period of a text in reading order: (start, label, fiscal_year, quarter, dated, month); null texts have none.

    Matches of a surer form win over those that they overlap.
    """
    text = F.coalesce(text, F.lit(""))
    # Nearly all texts without digits are done at once.
    every = F.when(text.rlike(r"\d\d"), F.concat(*[_candidates(text, i) for i in range(len(FORMS))])).otherwise(F.array().cast(_NONE))
    def shaped(c: Column) -> Column:
        said = F.substr(text, c["start"] + 1, c["end"] - c["start"])
        month = F.when(c["dated"], F.initcap(F.regexp_extract(said, rf"(?i)\b({'|'.join(MONTHS)})", 1)))
        return F.struct(c["start"].alias("start"), label(c["year"], c["quarter"]).alias("label"), c["year"].alias("fiscal_year"), c["quarter"].alias("quarter"), c["dated"].alias("dated"), month.alias("month"))

    return F.array_sort(F.transform(_accepted(every), shaped))


def labels(text: Column) -> Column:
    return F.transform(periods(text), lambda p: p["label"])


def fiscal_label(text: Column) -> Column:
    """The first period of a text, as FYyyyy or Qn FYyyyy; null if none."""
    return F.get(labels(text), F.lit(0))


def without_periods(text: Column) -> Column:
    """The text with every period replaced by a blank, to tell whether a line is nothing but periods."""
    for pattern, *_ in FORMS:
        text = F.regexp_replace(text, pattern, " ")
    return text


