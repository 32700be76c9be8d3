"""Conversation structure repair (operator 13) by lazy weighted determinisation.

Rows of a conversation are edited at least cost until their roles' initials read (s?(ua)+)?: a system turn may open it,
then user and assistant alternate and an assistant ends it. Keeping a row costs 0, giving it the role user or assistant
3, deleting it 4, inserting an empty turn 3; blank and duplicate rows must go, and a truncated row that stays costs 3
more.

Each row is reduced to a symbol (initial and fault). Read from the last row to the first, the costs from every place of
the grammar to the end, less their least, are a state of a deterministic automaton; states and their transitions are
made when they are first met and kept in a table, so a scan is a table look-up a row. The least costs add up to the
conversation's cost. The trace then runs against the scan, from the first row on, along arcs without slack, the
ASCII-least letter first, which gives the least audit among the cheapest.

What moves between tasks: rows once to number them in order, digests to find repeats (pre-aggregated, so a text that
holds a third of all rows is no hot group), symbols to trace, and rows once more to meet their audit. The last two
stream in order; a task keeps a byte for each row of one conversation, no more than the audit itself.

Edge cases: null roles and texts are one space; rows come by turn, nulls first, then role and text, and rows equal in
all of them stay side by side, the first being the one kept; null conv_id is a conversation of its own; any role whose
first character is not s, u or a fits nowhere until it is replaced; extra columns are left out; a conversation of which
all rows go is empty; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import bound_batches, materialise

#: Costs of the edits, and what a truncated row that stays costs more.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Faults of a row, the first that holds; initials of roles, the last stands for any other.
SOUND, CUT, BLANK, REPEAT = range(4)
INITIALS = "sua?"
#: Places of the grammar: before anything, after s, after u, after a (where it may end); the turn that each initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
ENDS = (START, ASSISTANT)
FAR = 10**9
LEGAL = ("su", "ua", "au")


def _roles(place: int) -> list[tuple[str, int]]:
    """Roles that may be written at a place, and where they lead."""
    return [(name, NEXT[place][name[0]]) for name in ("user", "assistant") if name[0] in NEXT[place]]


class Automaton:
    """Deterministic states of costs to the end, made when first met. A symbol is initial * 4 + fault."""

    def __init__(self):
        self.costs: list[tuple[int, ...]] = []
        self.states: dict[tuple[int, ...], int] = {}
        self.table: dict[int, tuple[int, int]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.last, self.base = self._state([0 if p in ENDS else FAR for p in range(4)])

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The state of costs before a row, turns inserted where that is cheaper, and the least cost taken off."""
        for _ in range(4):
            costs = [min([costs[p], *(INSERT + costs[q] for _, q in _roles(p))]) for p in range(4)]
        least = min(costs)
        key = tuple(c - least for c in costs)
        if key not in self.states:
            self.states[key] = len(self.costs)
            self.costs.append(key)
        return self.states[key], least

    @staticmethod
    def edits(symbol: int, place: int) -> list[tuple[str, int, int]]:
        """(letter, cost, place) of what may be done with a row at a place."""
        initial, fault = INITIALS[symbol >> 2], symbol & 3
        found = [("D", DELETE, place)]
        if fault in (SOUND, CUT):
            more = TRUNCATED if fault == CUT else 0
            if initial in NEXT[place]:
                found.append(("K", more, NEXT[place][initial]))
            found += [("R", RELABEL + more, q) for _, q in _roles(place)]
        return found

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state before a row of this symbol, from the one behind it, and the cost that it adds."""
        after = self.costs[state]
        found = self.table[state << 4 | symbol] = self._state([min(c + after[q] for _, c, q in self.edits(symbol, p)) for p in range(4)])
        return found

    def scan(self, symbols: bytes) -> tuple[int, list[int]]:
        """Cost of a conversation and the states behind each of its rows, from the last to the first, and before the first."""
        table, state, cost = self.table, self.last, self.base
        states = [state]
        for symbol in reversed(symbols):
            found = table.get(state << 4 | symbol)
            state, more = found if found is not None else self.step(state, symbol)
            cost += more
            states.append(state)
        return cost + self.costs[state][START], states

    def _arc(self, place: int, before: int, after: int, symbol: int) -> tuple[str, int]:
        """The least tight letters that pass a row: inserts, then what is done with the row; and the place behind it."""
        letters, here, behind = "", self.costs[before], self.costs[after]
        added = self.table[after << 4 | symbol][1]
        while True:
            tight = [(letter, q) for letter, cost, q in self.edits(symbol, place) if cost + behind[q] == here[place] + added]
            tight += [("I", q) for _, q in _roles(place) if INSERT + here[q] == here[place]]
            letter, place = min(tight)
            letters += letter
            if letter != "I":
                return letters, place

    def audit(self, symbols: bytes, states: list[int]) -> str:
        """Letters of the least cheapest edits, from the first row on."""
        place, out, arcs = START, [], self.arcs
        for n, symbol in enumerate(symbols, 1):
            before, after = states[-n], states[-n - 1]
            key = (place, before, after << 4 | symbol)
            found = arcs.get(key)
            if found is None:
                found = arcs[key] = self._arc(place, before, after, symbol)
            out.append(found[0])
            place = found[1]
        here = self.costs[self.last]
        while here[place] + self.base:  # what is left to the end
            out.append("I")
            place = _roles(place)[0][1]
        return "".join(out)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with pos, a conversation's running number in its order, what they hold by themselves, and a digest of role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    said = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(said == "", BLANK).when(~F.substring(said, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return rows.select("*", (F.row_number().over(order) - 1).cast("long").alias("pos"), fault.alias("fault"), initial.alias("initial"), digest.alias("digest"))


def _symbols(numbered: DataFrame) -> DataFrame:
    """conv_id, turn, pos, symbol: repeats are rows whose role and text stand further up."""
    repeated = numbered.groupBy("conv_id", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    a, b = numbered.select("conv_id", "turn", "pos", "fault", "initial", "digest").alias("a"), repeated.alias("b")
    joined = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), REPEAT).otherwise(F.col("fault"))
    return joined.select("a.conv_id", "turn", "pos", (F.col("initial") * 4 + fault).cast("int").alias("symbol"))


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _plans(symbols: DataFrame) -> DataFrame:
    """PLAN for each conversation, its symbols streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        legal = [INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in LEGAL]
        types = [pa.int64()] * 7 + [pa.string()]
        names = [f.split()[0] for f in PLAN.split(", ")]
        now, held, low, high, turns = (), [], None, None, 0

        def plan() -> tuple:
            flat = np.concatenate(held)
            fault, initial = np.bincount(flat & 3, minlength=4).tolist(), (flat >> 2).astype(np.int64)
            pairs = initial[:-1] * 4 + initial[1:]
            raw = flat.tobytes()
            cost, states = automaton.scan(raw)
            gaps = high - low + 1 - turns if turns else 0
            return now[0], gaps, fault[BLANK], fault[REPEAT], fault[CUT], int(len(pairs) - np.isin(pairs, legal).sum()), cost, automaton.audit(raw, states)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate(types)], names=names)

        for batch in batches:
            found = []
            ids, all_turns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            symbols = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), np.uint8)
            starts = [0, *(n for n in range(1, len(ids)) if ids[n] != ids[n - 1]), len(ids)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                if now != (ids[a],):
                    if now:
                        found.append(plan())
                    now, held, low, high, turns = (ids[a],), [], None, None, 0
                held.append(symbols[a:b])
                for t in all_turns[a:b]:
                    if t is not None and t != high:
                        low, high, turns = t if low is None else low, t, turns + 1
            yield rows(found)
        if now:
            yield rows([plan()])

    ordered = symbols.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "turn", "symbol")
    return ordered.mapInArrow(run, PLAN)


def plan_repairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, numbered rows): for each conv_id its gaps, faults, illegal neighbours, cost and audit; and the rows in order, written to the shared folder. conversations: conv_id, turn, role, text."""
    bound_batches(conversations.sparkSession)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")}
    rows = conversations.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")], *text.values())
    numbered = materialise(_numbered(rows))
    return materialise(_plans(_symbols(numbered))), numbered


REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"


def repaired_rows(plans: DataFrame, numbered: DataFrame) -> DataFrame:
    """REPAIRED: the turns that stay or come in, a conversation's in order within one partition; edit is K, R or I. A conversation's audit comes ahead of its rows in the sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, grammar, conv = "", 0, 0, START, None
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [f.split()[0] for f in REPAIRED.split(", ")]
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, place, grammar
            while at < len(audit) and audit[at] == "I":
                role, grammar = _roles(grammar)[0]
                out.append((conv, place, "I", None, role, ""))
                place += 1
                at += 1

        for batch in batches:
            for conv_id, pos, letters, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pos < 0:  # a conversation begins
                    insert()
                    audit, at, place, grammar, conv = letters, 0, 0, START, conv_id
                    continue
                insert()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role, grammar = _roles(grammar)[0]
                else:
                    grammar = NEXT[grammar][role[0]]
                out.append((conv, place, edit, turn, role, text))
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=names)
            out.clear()
        insert()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=names)

    heads = plans.select("conv_id", F.lit(-1).cast("long").alias("pos"), "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    rows = numbered.select("conv_id", "pos", F.lit("").alias("audit"), "turn", "role", "text")
    return heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of role:text lines. repaired: as repaired_rows leaves it, so no further shuffle is needed; conversations without a turn have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = (), hashlib.sha256()

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate((pa.int64(), pa.string()))], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            found = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if now != (conv_id,):
                    if now:
                        found.append((now[0], digest.hexdigest()))
                    now, digest = (conv_id,), hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            yield rows(found)
        if now:
            yield rows([(now[0], digest.hexdigest())])

    return repaired.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the damage that their conv_id and turn call for: dropped, emptied, without .!?, twice, or from the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """PLAN and repaired_sha256 of each conversation after its damage; a conversation that lost all its rows has zeros."""
    plans, numbered = plan_repairs(damaged(conversations))
    shas = digests(repaired_rows(plans, numbered)).withColumnRenamed("conv_id", "sha_id")
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    joined = ids.join(plans, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(shas, F.col("id").eqNullSafe(F.col("sha_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: The same repair in DuckDB: a recursion over the rows that keeps the cheapest, then least, audit of each place.
SQL = """
WITH RECURSIVE
fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS fate
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) FROM fated WHERE fate <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
rows AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault
  FROM placed),
arcs(place, initial, role, next) AS (VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
inserts(place, letters, next, said) AS (
  VALUES (0, '', 0, ''), (1, '', 1, ''), (2, '', 2, ''), (3, '', 3, ''),
    (0, 'I', 2, E'user:\\n'), (1, 'I', 2, E'user:\\n'), (2, 'I', 3, E'assistant:\\n'), (3, 'I', 2, E'user:\\n'),
    (0, 'II', 3, E'user:\\nassistant:\\n'), (1, 'II', 3, E'user:\\nassistant:\\n'), (2, 'II', 2, E'assistant:\\nuser:\\n'), (3, 'II', 3, E'user:\\nassistant:\\n')),
paths AS (
  SELECT conv_id, 0 AS pos, 0 AS place, 0 AS cost, '' AS audit, '' AS said FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL
  SELECT conv_id, pos, place, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, place ORDER BY cost, audit) AS best FROM (
      SELECT p.conv_id, p.pos + 1 AS pos, e.next AS place, p.cost + 3 * length(i.letters) + e.cost AS cost, p.audit || i.letters || e.letter AS audit, p.said || i.said || e.said AS said
      FROM paths p JOIN rows r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = p.pos + 1 JOIN inserts i ON i.place = p.place,
      LATERAL (
        SELECT i.next AS next, 4 AS cost, 'D' AS letter, '' AS said
        UNION ALL SELECT a.next, CASE r.fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', r.role || ':' || r.text || chr(10) FROM arcs a WHERE a.place = i.next AND a.initial = r.initial AND r.fault IN ('sound', 'truncated')
        UNION ALL SELECT a.next, CASE r.fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', a.role || ':' || r.text || chr(10) FROM arcs a WHERE a.place = i.next AND a.role IS NOT NULL AND r.fault IN ('sound', 'truncated')) e))
  WHERE best = 1),
ended AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS best FROM (
    SELECT p.conv_id, p.cost + 3 * length(i.letters) AS cost, p.audit || i.letters AS audit, p.said || i.said AS said
    FROM paths p JOIN inserts i ON i.place = p.place JOIN (SELECT conv_id, max(pos) AS pos FROM rows GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.pos = p.pos
    WHERE i.next IN (0, 3))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(CASE WHEN said <> '' THEN left(said, length(said) - 1) ELSE '' END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND e.best = 1
"""
