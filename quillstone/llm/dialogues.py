"""Repair of conversation structure with a suffix-shared automaton.

A conversation's rows stand by turn (nulls first; equal turns by role and a
digest of the text).  Its signature has one letter for each row: the role's initial
and the row's first fault.  What a repair costs and which edits it takes follow
from the signature alone, so texts are not read for that.

1. Rows with equal turn, role and text are counted; the first turn of each role and
   text is joined back, which tells duplicates.  Rows are sorted by ranges, so a long
   conversation lies in several tasks; its pieces are put together as one string with
   one byte for each row, as long as the audit that is asked for.
2. Different signatures are sorted by their ends.  A node of the automaton is a suffix;
   neighbours share the nodes of their common end, so each node is met once in a range.
   For every state of the grammar it has the least cost to go and the first edit of the
   least audit.  Suffixes of which the costs differ by a constant are one node of the
   minimal automaton: its costs and edits are worked out once.
3. Audits go before the rows of their conversations, and one sorted pass edits and hashes
   the lines.  A SHA-256 is sequential, so a very long conversation is one task's stream
   here; it is never held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quillstone.llm.lineage import written
from quillstone.llm.skew import attached

#: Fixed values of the contract: costs of edits and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3

#: What counts as blank.
BLANKS = " \t\n\x0b\x0c\r"

#: Faults of a row; letters of a signature are A + 4 * role + fault, with roles s, u, a, other.
SOUND, BLANK, REPEATED, CUT = range(4)

#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)

#: The state that a row with the role that the state calls for leads to, and that role.
CALLED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}

#: Symbols of a piece of a signature.
PIECE = 1 << 20

ORDER = ["key", "known", "turn", "role", "digest"]
NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
FINAL = pa.schema([pa.field(c, pa.int64()) for c in ("conv_id", *NUMBERS)] + [pa.field(c, pa.string()) for c in ("audit", "repaired_sha256")])


def _key(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by crc32("conv_id:turn") mod 20.

    0 drops a row, 1 empties its text, 2 removes . ! and ?, 3 repeats it, 4 makes it the
    user's.  Null roles and texts, and null ids and turns in the key, are one space.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")


def _lines(rows: DataFrame) -> DataFrame:
    """(key, known, turn, role, digest, text): rows in the columns that they are sorted by."""
    return rows.select(
        _key().alias("key"), F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def signatures(rows: DataFrame) -> DataFrame:
    """(key, signature): a letter for each row of a conversation, in order."""
    inner = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(inner == "", BLANK).when(F.substring(inner, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT)
    runs = _lines(rows).withColumn("fault", fault).groupBy(*ORDER, "fault").count()
    told = ["key", "role", "digest"]
    first = runs.groupBy(*told).agg(F.min(F.struct("known", "turn")).alias("first"))
    initial = F.substring("role", 1, 1)
    role = 4 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + 65
    own = F.when((F.col("fault") == BLANK) | (F.col("first") == F.struct("known", "turn")), F.col("fault")).otherwise(REPEATED)
    rest = F.when(F.col("fault") == BLANK, BLANK).otherwise(REPEATED)
    marked = runs.join(first, told).select(*ORDER, F.concat(F.char(role + own), F.repeat(F.char(role + rest), (F.col("count") - 1).cast("int"))).alias("piece"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, held, size = None, [], 0
        for batch in batches:
            out, pieces = [], batch.column(len(ORDER)).to_pylist()
            for i, key in enumerate(batch.column(0).to_pylist()):
                if lead is None or key != lead[0] or size >= PIECE:
                    if lead is not None:
                        out.append((*lead, "".join(held)))
                    lead, held, size = tuple(batch.column(k)[i].as_py() for k in range(len(ORDER))), [], 0
                held.append(pieces[i])
                size += len(pieces[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 6, batch.schema, strict=True)], schema=batch.schema)
        if lead is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*lead, "".join(held)), batch.schema, strict=True)], schema=batch.schema)

    pieces = marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(put, marked.schema)
    every = F.sort_array(F.collect_list(F.struct(*ORDER[1:], "piece")))  # a byte for each row, besides some 100 for each piece
    return pieces.groupBy("key").agg(F.array_join(F.transform(every, lambda x: x["piece"]), "").alias("signature"))


def _kept(role: int, state: int) -> int | None:
    """The state after a row that keeps its role, or None."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return None if state == USER else USER
    return ASSISTANT if role == 2 and state == USER else None


class Automaton:
    """The minimal automaton of the suffixes met so far: least costs to go and first edits, by grammar state."""

    #: The end: costs of what is still to be inserted, first edits.
    END = (0, (0, 2 * INSERT, INSERT, 0), ("", "I", "I", ""))

    def __init__(self) -> None:
        self.nodes: dict[tuple[str, tuple[int, ...]], tuple[int, tuple[int, ...], tuple[str, ...]]] = {}

    def before(self, letter: str, node: tuple) -> tuple[int, tuple[int, ...], tuple[str, ...]]:
        """The node of the suffix with one more letter in front: (constant, costs above it, first edits)."""
        constant, costs, _ = node
        known = self.nodes.get((letter, costs))
        if known is None:
            known = self.nodes[letter, costs] = self._worked(letter, costs)
        return constant + known[0], known[1], known[2]

    def _worked(self, letter: str, costs: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[str, ...]]:
        role, fault = divmod(ord(letter) - 65, 4)
        plain = []
        for state in range(4):
            ways = [(DELETE + costs[state], "D")]
            if fault in (SOUND, CUT):
                more = TRUNCATED if fault == CUT else 0
                to = _kept(role, state)
                ways += [(more + costs[to], "K")] if to is not None else []
                ways.append((REROLE + more + costs[CALLED[state]], "R"))
            plain.append(min(ways))
        # A third insertion at one place would lead back to a state passed before.
        best = [min(plain[s], (min(INSERT + plain[CALLED[s]][0], 2 * INSERT + plain[CALLED[CALLED[s]]][0]), "I")) for s in range(4)]
        least = min(cost for cost, _ in best)
        return least, tuple(cost - least for cost, _ in best), tuple(edit for _, edit in best)


def _audit(signature: str, nodes: list[tuple]) -> str:
    """The edits along the nodes of the suffixes, the whole signature's first."""
    out, state = [], START
    for letter, (_, _, edits) in zip([*signature, ""], nodes, strict=True):
        while edits[state] == "I":
            out.append("I")
            state = CALLED[state]
        if letter:
            edit = edits[state]
            out.append(edit)
            state = state if edit == "D" else CALLED[state] if edit == "R" else _kept((ord(letter) - 65) // 4, state)
    return "".join(out)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton, nodes, before = Automaton(), [Automaton.END], ""
    for batch in batches:
        rows = []
        for signature in batch.column(0).to_pylist():
            ended = signature[::-1]
            shared = len(commonprefix((before, ended)))
            del nodes[shared + 1 :]
            for letter in ended[shared:]:
                nodes.append(automaton.before(letter, nodes[-1]))
            before = ended
            faults = [sum(signature.count(chr(65 + 4 * role + fault)) for role in range(4)) for fault in (BLANK, REPEATED, CUT)]
            roles = signature.translate(_ROLES)
            legal = roles.count("su") + roles.count("ua") + roles.count("au")
            rows.append((*faults, max(0, len(roles) - 1) - legal, nodes[-1][0] + nodes[-1][1][START], _audit(signature, nodes[::-1])))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        arrays = [pa.array(x, pa.int64()) for x in columns[:5]] + [pa.array(columns[5], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["signature", "members", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


#: Letters of signatures to initials of roles.
_ROLES = {65 + 4 * role + fault: "sua-"[role] for role in range(4) for fault in range(4)}


def solved(signed: DataFrame) -> DataFrame:
    """(signature, members, blank, duplicate, truncated, illegal, cost, audit) of the different signatures."""
    classes = signed.groupBy("signature").agg(F.count("*").alias("members"))
    by_end = F.reverse("signature")
    return classes.repartitionByRange(by_end).sortWithinPartitions(by_end).mapInArrow(_solved, "signature string, members long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class _Edited:
    """The lines of one conversation as its audit edits them, hashed as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sum, self.empty = audit, 0, START, hashlib.sha256(), True

    def _line(self, role: str, text: str) -> None:
        if not self.empty:
            self.sum.update(b"\n")
        self.empty = False
        self.sum.update(f"{role}:{text}".encode())

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = CALLED[self.state]
            self._line(NAMES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "R":
            self.state = CALLED[self.state]
            role = NAMES[self.state]
        else:
            self.state = _kept("sua".find(role[:1]), self.state)
        self._line(role, text)

    def digest(self) -> str:
        self.inserted()
        return self.sum.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, edited = None, None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(FINAL), FINAL, strict=True)], schema=FINAL)

    for batch in batches:
        out = []
        heads, roles, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("head", "role", "text"))
        for i in range(batch.num_rows):
            if heads[i].is_valid:
                if head is not None:
                    out.append((*head.values(), edited.digest()))
                head = heads[i].as_py()
                edited = _Edited(head["audit"])
            else:
                edited.row(roles[i].as_py(), texts[i].as_py())
        yield packed(out)
    if head is not None:
        yield packed([(*head.values(), edited.digest())])


def repaired(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conv_id of every (rows, if not given) and of rows.

    rows: (conv_id, turn, role, text); other columns are ignored.  A null role or text is
    one space, null ids are one conversation, null turns come first and are no gap.
    Equal rows are duplicates of the first.  Rows of one turn stand by role and digest.
    The audit has an edit for each row in order: Keep, Rerole, Delete, and Insert
    between them; of the cheapest it is the least.  A conversation without rows has
    zeros, an empty audit and the hash of an empty string; an empty table gives none.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    known = rows.select("conv_id") if every is None else rows.select("conv_id").unionByName(every.select("conv_id"))
    turn = F.col("turn").cast("long")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long")
    signed = written(signatures(rows), "signatures")
    told = attached(signed, solved(signed), ["signature"], ["key"], signed.count()).drop("signature")
    heads = known.groupBy("conv_id").agg(F.count("*")).select(F.col("conv_id").cast("long").alias("conv_id"), _key().alias("key"))
    heads = heads.join(rows.groupBy(_key().alias("key")).agg(gaps.alias("gaps")), "key", "left").join(told, "key", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in NUMBERS]
    head = F.struct("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"))
    lines = heads.select("key", head.alias("head")).unionByName(_lines(rows), allowMissingColumns=True)
    place = ["key", F.col("head").isNull(), *ORDER[1:]]
    return lines.repartition("key").sortWithinPartitions(*place).select("head", "role", "text").mapInArrow(_hashed, from_arrow_schema(FINAL))


SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, i: xor(x // 2, (x % 2) * 3988292384::BIGINT))), 4294967295::BIGINT) % 20 AS f
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE f <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS n, count(*) OVER (PARTITION BY conv_id) AS size, left(role, 1) AS r
  FROM damaged
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN n > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS r0
  FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (r0 IS NOT NULL AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), best AS (  -- for states nothing yet, after s, after u, after a: (cost, audit, lines) of what follows row i
  SELECT conv_id, max(size) AS i, {'c': 0, 'x': '', 't': ''} AS e, {'c': 6, 'x': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s,
    {'c': 3, 'x': 'I', 't': chr(10) || 'assistant:'} AS u, {'c': 0, 'x': '', 't': ''} AS a
  FROM marked GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_sort([e0, {'c': u0.c + 3, 'x': 'I' || u0.x, 't': iu || u0.t}, {'c': a0.c + 6, 'x': 'II' || a0.x, 't': iu || ia || a0.t}])[1],
    list_sort([s0, {'c': u0.c + 3, 'x': 'I' || u0.x, 't': iu || u0.t}, {'c': a0.c + 6, 'x': 'II' || a0.x, 't': iu || ia || a0.t}])[1],
    list_sort([u0, {'c': a0.c + 3, 'x': 'I' || a0.x, 't': ia || a0.t}])[1], list_sort([a0, {'c': u0.c + 3, 'x': 'I' || u0.x, 't': iu || u0.t}])[1]
  FROM (
    SELECT conv_id, i - 1 AS i, chr(10) || 'user:' AS iu, chr(10) || 'assistant:' AS ia,
      list_sort([{'c': e.c + 4, 'x': 'D' || e.x, 't': e.t}, {'c': CASE WHEN r = 's' THEN s.c + k WHEN r = 'u' THEN u.c + k ELSE 1000000 END, 'x': 'K' || CASE WHEN r = 's' THEN s.x ELSE u.x END, 't': own || CASE WHEN r = 's' THEN s.t ELSE u.t END},
        {'c': u.c + k + 3, 'x': 'R' || u.x, 't': ru || u.t}])[1] AS e0,
      list_sort([{'c': s.c + 4, 'x': 'D' || s.x, 't': s.t}, {'c': CASE WHEN r = 'u' THEN u.c + k ELSE 1000000 END, 'x': 'K' || u.x, 't': own || u.t}, {'c': u.c + k + 3, 'x': 'R' || u.x, 't': ru || u.t}])[1] AS s0,
      list_sort([{'c': u.c + 4, 'x': 'D' || u.x, 't': u.t}, {'c': CASE WHEN r = 'a' THEN a.c + k ELSE 1000000 END, 'x': 'K' || a.x, 't': own || a.t}, {'c': a.c + k + 3, 'x': 'R' || a.x, 't': ra || a.t}])[1] AS u0,
      list_sort([{'c': a.c + 4, 'x': 'D' || a.x, 't': a.t}, {'c': CASE WHEN r = 'u' THEN u.c + k ELSE 1000000 END, 'x': 'K' || u.x, 't': own || u.t}, {'c': u.c + k + 3, 'x': 'R' || u.x, 't': ru || u.t}])[1] AS a0
    FROM (
      SELECT b.*, m.r, CASE m.fault WHEN 'blank' THEN 500000 WHEN 'duplicate' THEN 500000 WHEN 'truncated' THEN 3 ELSE 0 END AS k, chr(10) || m.role || ':' || m.text AS own,
        chr(10) || 'user:' || m.text AS ru, chr(10) || 'assistant:' || m.text AS ra
      FROM best b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i
    )
  )
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.e.c, 0)::BIGINT AS cost, coalesce(b.e.x, '') AS audit, sha256(coalesce(substr(b.e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM best WHERE i = 0) b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
