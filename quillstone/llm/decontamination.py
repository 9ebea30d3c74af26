"""Benchmark decontamination over canonical templates.

Numbers, names and units of a text become typed placeholders; what is left of
the wording stays as lower-case words.  Windows of eight template tokens are
hashed and joined with those of the benchmark, so a question whose numbers or
names were changed still matches.  Matches of one document and item at one
offset are gathered, and the replaced values must be consistent: one value of
the item stands for one value of the document all along, and two names or units
never for the same one.  (Two numbers may: drawn again, they can be equal.)

A window is looked for where its longest word stands: documents are exploded into
words, those that lead no window are dropped at once by a hash join, and only where
the window's second longest word is in its place too the window is cut, canonicalised
and hashed.  A window's template
follows from its words alone: a unit counts as one if its number is in the window.

An item of fewer than eight words is one window.  Windows with few literal words
say little as templates: below ``LITERALS`` they count only if every window of the
item matches, below ``LEAST`` they match only exactly.  All windows are also matched
by their exact lower-case words, so a copy is found whatever it is made of.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import let
from quillstone.llm.skew import shuffled

WINDOW = 8

#: Different words besides placeholders with which a window matches as a template by itself, and as a part of the whole item.
LITERALS = 4
LEAST = 2

#: An item is in a document if this many of its windows match at one offset (13 tokens if they follow each other), or this share of them.
RUN = 6
SHARE = 0.5

#: Words of a block, besides those around it that its windows reach.
BLOCK = 32

#: Leading words of windows (16 bytes each) up to which they are broadcast.
BROADCAST_TOKENS = 1_000_000

#: Bytes of the windows of all items with their words up to which they are broadcast.
BROADCAST_BYTES = 32 << 20

#: A unit is one of these after a number, or at the end of one.
UNITS = (
    "percent kg g mg km m cm mm mi ft feet inch inches miles meters metres kilometers litres liters l ml hours hour minutes minute seconds second s h min "
    "days day weeks week months month years year dollars dollar cents euros euro pounds usd eur gbp rupees yen degrees c f kmh mph w kw v"
).split()

#: Numbers in words; tens may be followed by ones.
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ONES = "one two three four five six seven eight nine".split()
NUMBERS = [*TENS, *ONES, *(t + o for t in TENS for o in ONES), *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion dozen".split()]

#: Words that are no names at the start of a sentence.
STARTERS = (
    "a an the this that these those there here it its he she they we you i his her their our my your in on at of to for from with by as if when while after before during until since because although though "
    "and or but so then what which who whom whose where why how is are was were be been do does did has have had can could will would should may might must not no each every all some any both one find "
    "calculate compute determine given suppose let solve show prove write state explain choose select consider assume at once now also however"
).split()

_MARK = "\x01"


def _marked(text: Column) -> Column:
    """A text without punctuation; the first word of a sentence or line bears a mark, and a unit stands apart from its number."""
    marked = F.concat(F.lit(_MARK), F.coalesce(text, F.lit("")))
    for end in (". ", "! ", "? ", ": ", "\n"):
        marked = F.replace(marked, F.lit(end), F.lit(f" {_MARK}"))
    for blank in "\t\r\f\v":
        marked = F.replace(marked, F.lit(blank), F.lit(" "))
    bare = F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}} {_MARK}]+", "")
    return F.regexp_replace(bare, rf"(?i)(\d)({'|'.join(UNITS)})(?= |$)", "$1 $2")


def _plain(word: Column) -> Column:
    return F.replace(word, F.lit(_MARK), F.lit(""))


def _words(marked: Column) -> Column:
    return F.transform(marked, _plain)


def _exact(marked: Column) -> Column:
    return F.transform(marked, lambda t: F.lower(_plain(t)))


def _template(marked: Column) -> Column:
    """Of a window's words numbers, names and units right after numbers as <n>, <p> and <u>, all else in lower case."""
    def kind(word: Column) -> Column:
        def of(plain: Column) -> Column:
            first, low = F.substring(plain, 1, 1), F.lower(plain)
            name = (F.lower(first) != first) & ~(word.startswith(_MARK) & low.isin(*STARTERS))
            return F.when(first.between("0", "9") | low.isin(*NUMBERS), "<n>").when(name, "<p>").otherwise(F.lower(word))

        return let(_plain(word), of)

    # A word that still bears its mark begins a sentence, so it is no unit.
    unit = lambda kinds: F.transform(kinds, lambda k, i: F.when((F.get(kinds, i - 1) == "<n>") & k.isin(*UNITS), "<u>").otherwise(_plain(k)))
    return let(F.transform(marked, kind), unit)


#: The two ways in which windows match; a window's hash tells them apart.
_WAYS = {"exact": 1, "template": -1}


def _window(tokens: Column, way: str, length: Column) -> Column:
    return F.xxhash64(tokens, length * _WAYS[way])


def _texts(texts: DataFrame, id_column: str, name: str) -> DataFrame:
    """(name, text_key, marked, low): the words with their marks, and in lower case without, as many of each."""
    rows = texts.select(F.col(id_column).cast("long").alias(name), F.xxhash64("text").alias("text_key"), _marked(F.col("text")).alias("bare"))
    marked = F.filter(F.split("bare", " "), lambda t: (t != "") & (t != _MARK))
    low = F.filter(F.split(_plain(F.lower("bare")), " "), lambda t: t != "")
    return rows.select(name, "text_key", marked.alias("marked"), low.alias("low"))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_windows, way, item_at, size, window, words, template, literals, lead, offset, second, second_offset) of every window of every item in both ways."""
    asked = _texts(benchmark, "item_id", "item_id").where(F.size("marked") > 0).withColumn("size", F.least(F.size("marked"), F.lit(WINDOW)))
    each = asked.select("*", (F.size("marked") - F.col("size") + 1).alias("n_windows"), F.explode(F.sequence(F.lit(0), F.size("marked") - F.col("size"))).alias("item_at"))
    each = each.select("item_id", "n_windows", "item_at", "size", F.slice("marked", F.col("item_at") + 1, F.col("size")).alias("marked"))
    each = each.select("item_id", "n_windows", "item_at", "size", _words(F.col("marked")).alias("words"), _template(F.col("marked")).alias("template"), _exact(F.col("marked")).alias("exact"))
    literals = F.size(F.array_distinct(F.filter("template", lambda t: ~t.startswith("<"))))

    def of(way: str) -> DataFrame:
        longest = F.sort_array(F.transform(way, lambda t, i: F.struct(F.when(t.startswith("<"), 0).otherwise(F.length(t)).alias("n"), t.alias("word"), (-i).alias("back"))), False)
        rows = each.select("item_id", "n_windows", F.lit(way).alias("way"), "item_at", "size", _window(F.col(way), way, F.col("size")).alias("window"), "words", "template", literals.alias("literals"), longest.alias("longest"))
        first, second = F.get("longest", F.lit(0)), F.get("longest", F.lit(1))
        return rows.select("*", first["word"].alias("lead"), (-first["back"]).alias("offset"), F.when(second["n"] > 0, second["word"]).alias("second"), (-second["back"]).alias("second_offset")).drop("longest")

    return of("exact").unionByName(of("template").where(F.col("literals") >= LEAST)).distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, share, n_slots): the items that each document holds.

    documents: doc_id and text.  benchmark: item_id and text.  n_windows of the
    item's windows stand in the document at one offset (the best one), share of
    all it has, or of those that can match as templates if that is more; n_slots
    different values were replaced there.  A window matches as a template or by its
    exact lower-case words; inconsistent slots are overruled only if all windows
    match exactly.  An item of one to seven words is one window, so an item of one
    common word is in many documents.  Null and empty texts have no windows; rows with a
    null id take part under the null id.  Repeated rows count once, and different texts of
    one id are matched each by itself.  Other columns are ignored; an empty table on
    either side gives no rows.
    """
    items = _items(benchmark)
    sizes = items.agg(F.count("*"), F.coalesce(F.sum(96 + F.octet_length(F.array_join("words", "  ")) + F.octet_length(F.array_join("template", "  "))), F.lit(0))).first()
    leads = items.select("lead", "offset", "second", "second_offset", "size", "way").distinct()
    few = sizes[0] <= BROADCAST_TOKENS
    small = sizes[1] <= BROADCAST_BYTES

    # A row of an explosion holds its whole source, so words come out of blocks, which reach as far as a window does.
    begin = lambda i: F.greatest(i - (WINDOW - 1), F.lit(0))
    cut = lambda c, i: F.slice(c, begin(i) + 1, i - begin(i) + BLOCK + WINDOW - 1).alias(c)
    starts = F.when(F.size("low") > 0, F.sequence(F.lit(0), F.size("low") - 1, F.lit(BLOCK)))
    blocks = F.transform(starts, lambda i: F.struct(begin(i).alias("begin"), (i - begin(i)).alias("own"), cut("low", i), cut("marked", i)))
    told = _texts(documents, "doc_id", "doc_id").select("doc_id", "text_key", F.explode(blocks).alias("b")).select("doc_id", "text_key", "b.*")
    told = told.select("*", F.posexplode("low").alias("place", "lead")).where(F.col("place").between(F.col("own"), F.col("own") + BLOCK - 1))
    met = told.join(F.broadcast(leads) if few else shuffled(leads), "lead").withColumn("start", F.col("place") - F.col("offset"))
    met = met.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.size("low")))
    met = met.where(F.col("second").isNull() | (F.get("low", F.col("start") + F.col("second_offset")) == F.col("second")))
    met = met.select("doc_id", "text_key", (F.col("begin") + F.col("start")).alias("start"), "way", "size", F.slice("marked", F.col("start") + 1, F.col("size")).alias("own"))
    window = F.when(F.col("way") == "exact", _window(_exact(F.col("own")), "exact", F.col("size"))).otherwise(_window(_template(F.col("own")), "template", F.col("size")))
    found = met.select("doc_id", "text_key", "start", window.alias("window"), _words(F.col("own")).alias("own"))
    named = items.drop("lead", "offset", "second", "second_offset", "size")
    found = found.join(F.broadcast(named) if small else shuffled(named), "window")

    exact = F.col("way") == "exact"
    kinds = F.zip_with("template", "words", lambda t, w: F.when(t.startswith("<"), F.struct(t.alias("kind"), w.alias("item"))))
    slots = F.filter(F.zip_with(kinds, "own", lambda k, d: F.when(k.isNotNull(), F.struct(k["kind"].alias("kind"), k["item"].alias("item"), d.alias("doc")))), lambda s: s.isNotNull())
    # Where the only window of an item stands makes no difference if it is a copy.
    shift = F.when(exact & (F.col("n_windows") == 1), 0).otherwise(F.col("start") - F.col("item_at"))
    rows = found.select("doc_id", "text_key", "item_id", "n_windows", shift.alias("shift"), "item_at", exact.alias("exact"), (exact | (F.col("literals") >= LITERALS)).alias("strong"), F.when(~exact, slots).alias("slots"))

    places = lambda when: F.size(F.collect_set(F.when(when, F.col("item_at"))))  # noqa: E731  # windows of one item at most
    counts = places(F.lit(True)).alias("n_any"), places(F.col("strong")).alias("n_strong"), places(F.col("exact")).alias("n_exact"), places(~F.col("exact") & F.col("strong")).alias("n_template")
    gathered = rows.groupBy("doc_id", "text_key", "item_id", "n_windows", "shift").agg(*counts, F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    distinct = lambda part, kept: F.size(F.array_distinct(F.transform(F.filter("slots", kept), lambda s: F.struct(s["kind"], s[part]))))
    fixed = lambda s: s["kind"] != "<n>"
    consistent = (F.size("slots") == distinct("item", lambda s: F.lit(True))) & (F.size(F.filter("slots", fixed)) == distinct("doc", fixed))
    totals = items.where((F.col("way") == "template") & (F.col("literals") >= LITERALS)).groupBy("item_id").agg(F.count_distinct("item_at").alias("n_item_template")).withColumnRenamed("item_id", "of_item")
    whole = gathered.join(totals, F.col("item_id").eqNullSafe(F.col("of_item")), "left").where(consistent | (F.col("n_exact") == F.col("n_windows")))
    n_held = F.when(F.col("n_any") == F.col("n_windows"), F.col("n_any")).otherwise(F.col("n_strong"))
    share = F.greatest(n_held / F.col("n_windows"), F.try_divide("n_template", "n_item_template"))
    judged = whole.select("doc_id", "item_id", n_held.cast("long").alias("n_windows"), share.alias("share"), F.when(consistent, F.size("slots")).otherwise(0).cast("long").alias("n_slots"))
    held = judged.where((F.col("n_windows") >= RUN) | (F.col("share") >= SHARE))
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "share", "n_slots")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_windows", "best.share", "best.n_slots")


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item; rows with a null doc_id stay."""
    hit = contaminated(documents, benchmark).select(F.col("doc_id").alias("hit")).distinct()
    return documents.join(hit, documents["doc_id"].cast("long") == hit["hit"], "left_anti")
