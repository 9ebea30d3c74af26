"""What a printed line is: a table's header, a row of figures, figures alone, a label, a heading.

Classes are Column expressions; the folds over a document's lines read them as letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import periods
from quillstone.functions import text as t

#: Words of a header besides periods, and words that make its periods interim.
HEADER_WORDS = (
    r"(?i)\b(particulars?|description|for the|year(s)? ended|quarter(s)? ended|months? ended|"
    r"as (at|of|on)|year|years|quarter|period|ended|notes?|no\.?|amounts?|audited|unaudited|"
    r"consolidated|standalone|restated|in|rs\.?|inr|usd|eur|gbp|crores?|cr|lakhs?|lacs?|"
    r"millions?|mn|billions?|bn|thousands?|except per share data|three|six|nine|twelve|half)\b"
)
INTERIM = r"(?i)\b(quarter(s)? ended|quarterly|(three|six|nine) months|half[- ]year)\b"

#: Longest label and most words of a row, of a label of its own, of a wrapped one; most figures of a line; longest part of a header; longest heading.
ROW_LABEL, ROW_WORDS, LABEL, LABEL_WORDS, WRAPPED, FIGURES, HEADER_PART, HEADING = 90, 14, 70, 8, 160, 12, 80, 120

#: Openings of list items, and titles of sections that filings share.
BULLET = r"^\s*(?:[•▪■●◦‣·*]|[-–—]\s|\(?\d{1,2}[.)]\s|\(?[a-z][.)]\s)"
KNOWN_SECTION = (
    r"(?i)^(?:\d{1,2}[.)]?\s+|item\s+\d+[a-z]?[.:]?\s+)?("
    r"risk factors?|risk management|key risks?|principal risks.*|"
    r"management'?s? discussion and analysis.*|md&a|business overview|company overview|"
    r"chairman'?s? (letter|message|statement)|(ceo|md|cfo)'?s? (letter|message|review)|"
    r"letter to shareholders|outlook|future outlook|guidance|strategy|strategic priorities|"
    r"financial (highlights|performance|review|statements|summary)|results of operations|"
    r"(consolidated |standalone )?(balance sheet|statement of (profit and loss|cash flows?|financial position|"
    r"comprehensive income|changes in equity)|income statement|cash flow statement)|"
    r"notes to (the )?(consolidated |standalone )?financial statements|"
    r"(significant|material|summary of) accounting policies|"
    r"liquidity and capital resources|capital expenditure|segment (information|performance|reporting)|"
    r"corporate governance|directors'? report|auditors?'? report|independent auditors?'? report|"
    r"question[- ]and[- ]answer( session)?|q\s*&\s*a( session)?|prepared remarks|opening remarks|"
    r"opportunities and threats|growth opportunities|revenue|profitability"
    r")\s*$"
)

#: Letters of the classes that the fold over lines reads.
HEADER, ROW, VALUES, SUBLABEL, WRAPS, OTHER = "HRVSWO"


def words(line: Column) -> Column:
    """The parts of a line between blanks; bars count as blanks."""
    return t.let(t.stripped(F.replace(line, F.lit("|"), F.lit(" "))), lambda bare: F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\s\p{Z}\x1c-\x1f\x85]+")))


def is_short_or_row(line: Column) -> Column:
    """Whether the words of a line without blanks at its ends matter: it may be a heading, a label or figures alone, or it ends like a row of figures.

    Of nearly all lines of prose only the last word is looked at.
    """
    tail = words(F.substring_index(line, " ", -1))
    ends = t.let(tail, lambda w: (F.size(w) == 0) | t.is_figure(F.get(w, F.size(w) - 1)))
    return (F.length(line) <= HEADING) | ends


def marks(parts: Column) -> Column:
    """Of every part of a line whether it is a figure."""
    return F.transform(parts, t.is_figure)


def row_of(parts: Column, figures: Column) -> Column:
    """(label, figures) of a line "Label  1,234  (567)", else null; the first part never is a figure."""
    def cut(n: Column) -> Column:
        label = F.array_join(F.slice(parts, 1, F.size(parts) - n), " ")
        fits = (F.size(parts) - n <= ROW_WORDS) & label.rlike("[A-Za-z]") & (F.length(label) <= ROW_LABEL) & ~label.rlike("[.;,]$")
        return F.when((n > 0) & fits, F.struct(label.alias("label"), F.slice(parts, F.size(parts) - n + 1, n).alias("figures")))

    tail = F.reverse(F.slice(figures, 2, F.greatest(F.size(figures) - 1, F.lit(0))))
    stop = F.array_position(tail, False)
    return F.when(F.element_at(figures, -1), t.let(F.when(stop == 0, F.size(tail)).otherwise(stop - 1).cast("int"), cut))


def values_of(parts: Column, figures: Column) -> Column:
    """The figures of a line of nothing else, null if it has other words or no number."""
    only = (F.size(parts) <= FIGURES) & F.forall(figures, lambda f: f)
    return F.when(F.element_at(figures, -1) & only & F.exists(parts, lambda p: t.parsed_number(p).isNotNull()), parts)


def row(line: Column) -> Column:
    return t.let(words(line), lambda parts: F.when(F.size(parts) > 1, row_of(parts, marks(parts))))


def values(line: Column) -> Column:
    return t.let(words(line), lambda parts: F.when(F.size(parts) > 0, values_of(parts, marks(parts))))


def residue(line: Column) -> Column:
    """Latin letters of a line besides periods, currencies and words of headers."""
    left = F.regexp_replace(F.regexp_replace(periods.without_periods(line), HEADER_WORDS, " "), t.CURRENCY_WORDS, " ")
    return F.length(F.regexp_replace(left, "[^A-Za-z]", ""))


def is_header(line: Column) -> Column:
    """Whether a line is made of periods and words of headers only."""
    return F.when(line.rlike(r"\d\d"), (residue(line) <= 3) & (F.size(periods.periods(line)) > 0)).otherwise(False)


def is_header_part(line: Column) -> Column:
    """Whether a line can be part of a header of several lines."""
    return t.let(t.stripped(line), lambda bare: (bare != "") & (F.length(bare) <= HEADER_PART) & (residue(bare) <= 3))


def period_labels(line: Column, found: Column) -> Column:
    """Labels of the periods found in a header, interim ones if it says so."""
    interim = F.coalesce(line.rlike(INTERIM), F.lit(False))
    named = lambda p: F.concat_ws(" ", F.lit("Interim"), F.coalesce(p["month"], F.lit("Period")), p["fiscal_year"].cast("string"))
    return F.transform(found, lambda p: F.when(interim & p["quarter"].isNull(), named(p)).otherwise(p["label"]))


def header_periods(line: Column) -> Column:
    return period_labels(line, periods.periods(line))


def is_label(bare: Column, n_words: Column) -> Column:
    """Whether a line without blanks at its ends can be a label without figures."""
    return (bare != "") & (F.length(bare) <= LABEL) & (n_words <= LABEL_WORDS) & ~bare.rlike("[.;,]$") & bare.rlike("[A-Za-z]{3}")


def level_of(bare: Column, parts: Column, figures: Column, is_row: Column, header_part: Column, size: Column, bold: Column, body_size: Column, forced: Column) -> Column:
    """1 or 2 for a heading, 0 for other lines, of what is known of a line; ``forced`` is the level that the source gives, 0 if none."""
    known, styled = bare.rlike(KNOWN_SECTION), (size >= body_size * 1.15) | bold
    out = (F.length(bare) < 3) | (F.length(bare) > HEADING) | (F.size(parts) > 14) | bare.rlike("[.;,:]$") | ~bare.rlike("[A-Za-z]{3}") | is_row | header_part
    out = out | (F.size(F.filter(figures, lambda f: f)) > F.size(parts) / 2)
    capital = (F.upper(bare) == bare) & (F.lower(bare) != bare)
    plain = F.when((capital & (F.size(parts) <= 8)) | known, 2).otherwise(0)
    level = F.when(size >= body_size * 1.4, 1).when(size >= body_size * 1.15, 2).when(bold & (F.size(parts) <= 10), 2).otherwise(plain)
    return F.when(forced > 0, forced).when(out | (bare.rlike(BULLET) & ~known & ~styled), 0).otherwise(level)


def with_levels(lines: DataFrame, body_size: Column, forced: Column) -> DataFrame:
    """Adds level to lines (text, size, bold)."""
    rows = lines.withColumn("_bare", t.stripped(F.col("text"))).withColumn("_parts", words(F.col("_bare"))).withColumn("_figures", marks(F.col("_parts")))
    bare = F.col("_bare")
    header_part = F.when((bare != "") & (F.length(bare) <= HEADER_PART), residue(bare) <= 3).otherwise(False)
    is_row = F.when(F.size("_parts") > 1, row_of(F.col("_parts"), F.col("_figures")).isNotNull()).otherwise(False)
    return rows.withColumn("level", level_of(bare, F.col("_parts"), F.col("_figures"), is_row, header_part, F.col("size"), F.col("bold"), body_size, forced)).drop("_bare", "_parts", "_figures")
