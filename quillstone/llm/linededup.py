"""Line dedup with a suffix array over line ids and its longest common prefixes.

A document is the sequence of its lines that hold a word; blank lines belong to
no sequence.  Only lines that occur more than once take part: a repeated run of
lines holds no other, so a document falls into stretches of such lines and a
suffix ends where its stretch ends.

Array.  A round doubles the named prefix twice: it names each suffix by the order
of its first 4**k lines, from the names of the four quarters; names are handed out
over the globally sorted distinct quadruples, so they order the suffixes.  The
rounds end when no class splits any more: the names are then the suffix array,
equal suffixes sharing one.

Longest common prefixes.  Two neighbours of the array are followed back through
the rounds: quarters of the same class are common, and the first ones that differ
are compared next, a round earlier.

Intervals.  Between places where the common prefix is shorter than m lines lie
the intervals of the array whose suffixes share m lines.  Every member but the
first in document order starts m lines that occur earlier.  As every m-line part
of a longer repeated run occurs earlier too, these parts together cover exactly
the later copies of the maximal repeated runs, which are deleted.

Line texts never move: ids are two 64-bit hashes.  The documents are shuffled
once, to delete the lines.  A class of very many suffixes is split where rows
meet it (``skew.attached``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.lineage import dropped, written
from quillstone.llm.skew import attached, shuffled

#: A run needs this many lines with a word, or a line of this many words.
MIN_LINES = 2
MIN_WORDS = 20

#: Neighbouring classes of the array that one task holds when intervals are named.
BLOCK = 1 << 20

_PLACE = ["doc", "text_hash", "pos"]
_QUARTERS = ["name", "second", "third", "fourth"]
_BLANKS = " \t\n\v\f\r"
_WORD = r"[^\x20\x09-\x0D]+"


def _keyed(documents: DataFrame) -> DataFrame:
    """Equal rows of one doc_id are one document; different texts of one doc_id are ordered by their hash."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, text_hash, pos, no, id_a, id_b, long) of every line with a word: its number among those (pos) and among all lines (no), and whether it has min_words."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    inked = F.filter(numbered, lambda s: F.btrim(s["line"], F.lit(_BLANKS)) != "")
    rows = _keyed(documents).select("doc", "text_hash", F.posexplode(inked).alias("pos", "s"))
    line = F.col("s.line")
    ids = F.xxhash64(line).alias("id_a"), F.xxhash64(F.lit(1), line).alias("id_b")
    # Only a line of so many characters can have that many words.
    long = F.when(F.length(line) < 2 * min_words - 1, False).otherwise(F.regexp_count(line, F.lit(_WORD)) >= min_words)
    return rows.select(*_PLACE, "s.no", *ids, long.alias("long"))


def _ahead(column: str, steps: int) -> Column:
    """The value ``steps`` lines further on in the stretch, null beyond its end."""
    stretch = Window.partitionBy("doc", "text_hash", "stretch").orderBy("pos")
    return F.max(column).over(stretch.rangeBetween(steps, steps))


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """The inner join on the place, null-safe for rows without doc_id."""
    named = b.select(*[F.col(c).alias(f"b_{c}") if c in _PLACE else F.col(c) for c in b.columns])
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in _PLACE]
    return a.join(shuffled(named), same).drop(*[f"b_{c}" for c in _PLACE])


def _repeated(found: DataFrame, min_lines: int) -> DataFrame:
    """The lines that occur more than once, with the name of their class, their stretch, the lines left in it, and the number of the line that ends a run of min_lines."""
    own = written(found, "lines")
    ids = own.groupBy("id_a", "id_b").agg(F.count("*").alias("members")).where("members > 1")
    named = written(ids.orderBy("id_a", "id_b").withColumn("name", F.monotonically_increasing_id()), "ids")
    rows = attached(own, named, ["id_a", "id_b"], _PLACE, own.count()).select(*_PLACE, "no", "long", "name").distinct()
    in_order = Window.partitionBy("doc", "text_hash").orderBy("pos")
    rows = rows.withColumn("stretch", F.col("pos") - F.row_number().over(in_order))
    rest = Window.partitionBy("doc", "text_hash", "stretch").orderBy(F.desc("pos"))
    rows = rows.withColumn("left", F.row_number().over(rest)).withColumn("end_no", _ahead("no", min_lines - 1))
    base = written(rows, "base")
    dropped(own)
    dropped(named)
    return base


def suffix_array(base: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The array, its classes and the classes of every round.

    base: as from _repeated().  The array is (doc, text_hash, pos, name), ordered
    by name.  Its classes are (name, rank), ranks from 0 without gaps.  A round's
    classes are (name, second, third, fourth, new): the quarters of each new
    class, -1 beyond the end.
    """
    n_rows = base.count()
    key = [*_PLACE, "stretch"]
    ahead = lambda width: [F.coalesce(_ahead("name", i * width), F.lit(-1)).alias(c) for i, c in enumerate(_QUARTERS) if i]
    parted = written(base.select(*key, "name", *ahead(1)), "parted")
    known, rounds = parted.select("name").distinct().count(), []
    while True:
        whole = parted.groupBy(*_QUARTERS).agg(F.count("*").alias("members")).orderBy(*_QUARTERS)
        classes = written(whole.withColumn("new", F.monotonically_increasing_id()), "classes")
        count = classes.count()
        if count == known:
            return parted.select(*_PLACE, "name"), written(_ranked(classes), "ranks"), rounds
        rounds.append(classes)
        longer = attached(parted, classes, _QUARTERS, _PLACE, n_rows).select(*key, F.col("new").alias("name"))
        following = written(longer.select(*key, "name", *ahead(4 ** len(rounds))), "parted")
        dropped(parted)
        parted, known = following, count


def _ranked(classes: DataFrame) -> DataFrame:
    """(name, rank): the order number of each class; new counts within the partitions of the sort."""
    part, row = F.shiftright("new", 33), F.col("new").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = classes.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    # A row for each partition of the sort, whatever the input.
    return classes.select("name", part.alias("part"), row.alias("row")).join(F.broadcast(before), "part").select("name", (F.col("before") + F.col("row")).alias("rank"))


def common_prefixes(ranks: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(rank, lcp): the lines that the suffixes of each class but the first share with those of the class before it."""
    before = ranks.select((F.col("rank") + 1).alias("rank"), F.col("name").alias("s"))
    pairs = written(ranks.withColumnRenamed("name", "t").join(shuffled(before), "rank").withColumn("lcp", F.lit(0)), "pairs")
    for k in reversed(range(len(rounds))):
        met = pairs
        for side in ("s", "t"):
            quarters = [F.col(c).alias(f"{side}{i}") for i, c in enumerate(_QUARTERS)]
            met = met.join(shuffled(rounds[k].select(F.col("new").alias(side), *quarters)), side, "left")
        differ = [F.coalesce(F.col(f"s{i}") != F.col(f"t{i}"), F.lit(True)) for i in range(3)]
        first = lambda values: F.when(differ[0], values[0]).when(differ[1], values[1]).when(differ[2], values[2]).otherwise(values[3])
        s, t = (first([F.col(f"{x}{i}") for i in range(4)]).alias(x) for x in "st")
        # Written, as the driver plans all that is left anew whenever a stage ends.
        closer = written(met.select("rank", s, t, (F.col("lcp") + first([F.lit(i * 4**k) for i in range(4)])).alias("lcp")), "pairs")
        dropped(pairs)
        pairs = closer
    return pairs.select("rank", "lcp")


def _intervals(classes: DataFrame, depth: int) -> DataFrame:
    """Adds the rank of the first class of the interval that shares ``depth`` lines, and the least place of its suffixes."""
    blocked = classes.withColumn("block", F.floor(F.col("rank") / BLOCK)).withColumn("head", F.when(F.col("lcp") < depth, F.col("rank")))
    last = blocked.groupBy("block").agg(F.max("head").alias("last"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("block", F.max("last").over(earlier).alias("carried"))  # a row for each BLOCK classes
    inside = F.max("head").over(Window.partitionBy("block").orderBy("rank"))
    named = blocked.withColumn("inside", inside).join(F.broadcast(carried), "block").withColumn("interval", F.coalesce("inside", "carried"))
    named = named.drop("block", "head", "inside", "carried")
    first = named.groupBy("interval").agg(F.min("first").alias(f"first_{depth}"), F.count("*").alias("members"))
    return attached(named, first, ["interval"], ["rank"], classes.count()).drop("interval")


def repeats(documents: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, text_hash, pos, no, end_no, long, left, longest, first_1, first_m) of every line that occurs more than once.

    longest: the lines of the longest run that starts here and occurs elsewhere
    too; first_d: the least place that starts the same d lines, for d = 1 and
    min_lines.
    """
    base = _repeated(lines(documents, min_words), min_lines)
    array, ranks, rounds = suffix_array(base)
    lcp = common_prefixes(ranks, rounds)
    sizes = array.groupBy("name").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("members"))
    # A class shares its prefix with both neighbours.
    near = lcp.select(F.explode(F.array("rank", F.col("rank") - 1)).alias("rank"), "lcp").groupBy("rank").agg(F.max("lcp").alias("near"))
    classes = ranks.join(shuffled(sizes), "name").join(shuffled(lcp), "rank", "left").join(shuffled(near), "rank", "left").na.fill(0, ["lcp", "near"])
    classes = written(classes.select("rank", "name", "first", "members", "lcp", F.when(F.col("members") == 1, F.col("near")).alias("near")), "array")
    for depth in sorted({1, min_lines}):
        firsts = _intervals(classes.select("rank", "lcp", "first"), depth).select("rank", f"first_{depth}")
        classes = classes.join(shuffled(firsts), "rank")
    classes = written(classes.select("name", "members", "near", "first_1", F.col(f"first_{min_lines}").alias("first_m")), "intervals")
    for table in rounds:
        dropped(table)
    met = attached(array, classes, ["name"], _PLACE, base.count()).drop("name")
    # Equal suffixes share all of themselves.
    return _met(base.drop("name", "stretch"), met).withColumn("longest", F.coalesce("near", "left")).drop("near")


def removals(documents: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, text_hash, gone, longest): the sorted numbers of the lines that each document loses, and its longest run that occurs elsewhere too."""
    place = F.struct(*_PLACE)
    run = F.when((F.col("first_m") < place) & (F.col("left") >= min_lines), F.sequence("no", "end_no"))
    line = F.when((F.col("first_1") < place) & F.col("long"), F.array("no"))
    late = repeats(documents, min_lines, min_words).select("doc", "text_hash", "longest", F.explode_outer(F.coalesce(run, line)).alias("gone"))
    return late.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("gone")).alias("gone"), F.max("longest").alias("longest"))


def _cut(documents: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(row, parts, gone, longest, text): every row with its lines, the numbers of those that go, and what is left."""
    found = removals(documents, min_lines, min_words)
    row = F.struct(*[documents[f"`{c}`"] for c in documents.columns])
    keyed = documents.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    own = F.col("k.doc").eqNullSafe(F.col("g.doc")) & (F.col("k.text_hash") == F.col("g.text_hash"))
    met = keyed.alias("k").join(shuffled(found).alias("g"), own, "left").select("k.row", "g.longest", F.when(F.size("g.gone") > 0, F.col("g.gone")).alias("gone"))
    met = met.withColumn("parts", F.split("row.text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col("parts"), i)), "\n")
    return met.withColumn("text", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(text))


def _columns(documents: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    return [(F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in documents.columns if c not in without]


def without_repeated_lines(documents: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated line runs; the columns of documents and no others, as in deduplicated()."""
    return _cut(documents, min_lines, min_words).select(*_columns(documents))


def deduplicated(documents: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated line runs; lines are split at \\n.

    A run of ``min_lines`` (two at least) lines with a word or more (blank lines between them go
    with it), or a line of ``min_words`` words or more, loses every copy but the
    first, by doc_id (null first) and then by place.  Other blank lines stay.
    All columns stay, with text replaced and ``n_lines``, ``n_removed``,
    ``n_runs`` and ``longest_run`` (of removed lines) and ``longest_repeat``
    (lines with a word of the longest run that occurs elsewhere in the table)
    added; input columns of these names are replaced, see
    without_repeated_lines() for a result that keeps them.  Null texts stay null
    and have no lines removed; a text may become empty; a very long text is one
    row of many lines.  Equal rows of one doc_id are one document and get the
    same result.  An empty table gives an empty result.
    """
    added = ("n_lines", "n_removed", "n_runs", "longest_run", "longest_repeat")
    # A run starts at a removed line whose predecessor is not removed.
    starts = F.array_except("gone", F.transform("gone", lambda i: i + 1))
    ends = F.array_except("gone", F.transform("gone", lambda i: i - 1))
    longest = F.array_max(F.zip_with(ends, starts, lambda e, s: e - s + 1))
    count = lambda c: F.when(F.col("gone").isNull(), 0).otherwise(c).cast("long")
    return _cut(documents, min_lines, min_words).select(
        *_columns(documents, added),
        F.coalesce(F.size("parts").cast("long"), F.lit(1).cast("long")).alias("n_lines"),
        count(F.size("gone")).alias("n_removed"),
        count(F.size(starts)).alias("n_runs"),
        count(longest).alias("longest_run"),
        F.coalesce(F.col("longest").cast("long"), F.lit(0).cast("long")).alias("longest_repeat"),
    )


SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), x AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER w AS i, lead(p) OVER w AS p2, lead(line) OVER w AS line2
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) > 1 AS late,
    line2 IS NOT NULL AND row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, p) > 1 AS late2 FROM x
), gone AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN late2 THEN range(p, p2 + 1) ELSE [p] END) AS p FROM f WHERE late2 OR (late AND n >= 20)
), r AS (
  SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM gone
), i AS (
  SELECT doc_id, island, count(*) AS size FROM r GROUP BY ALL
), s AS (
  SELECT doc_id, count(*) AS runs, max(size) AS longest FROM i GROUP BY doc_id
), h AS (
  SELECT doc_id, i, md5(line) AS h FROM x
), again AS (
  SELECT doc_id, i, 1 AS n, h AS g FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1
  UNION ALL
  SELECT doc_id, i, n, g FROM (SELECT a.doc_id, a.i, a.n + 1 AS n, md5(a.g || h.h) AS g, count(*) OVER (PARTITION BY md5(a.g || h.h)) AS c
    FROM again a JOIN h ON h.doc_id = a.doc_id AND h.i = a.i + a.n) WHERE c > 1
), m AS (
  SELECT doc_id, max(n) AS repeat FROM again GROUP BY doc_id
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(gone.p)::BIGINT AS n_removed, coalesce(max(runs), 0)::BIGINT AS n_runs, coalesce(max(longest), 0)::BIGINT AS longest_run,
  coalesce(max(repeat), 0)::BIGINT AS longest_repeat, sha256(coalesce(string_agg(line, chr(10) ORDER BY l.p) FILTER (gone.p IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.p = l.p LEFT JOIN s ON s.doc_id = l.doc_id LEFT JOIN m ON m.doc_id = l.doc_id GROUP BY l.doc_id
"""
