"""Operator 13 against an exhaustive search over edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import repair

SPACE = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            new = (conv, turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            out += [new, new] if fate == 3 else [new]
    return out


def cheapest(rows):
    """Every way to edit a conversation's rows (role, text, fault): (cost, audit, texts) of the least."""
    best = None
    ways = [(0, "", "", [])]  # cost, audit, initials, lines
    for role, text, fault in rows:
        ways = with_inserts(ways)
        more = []
        for cost, audit, initials, lines in ways:
            more.append((cost + 4, audit + "D", initials, lines))
            if fault in ("sound", "truncated"):
                extra = 3 if fault == "truncated" else 0
                more.append((cost + extra, audit + "K", initials + role[:1] if role else initials + "?", [*lines, f"{role}:{text}"]))
                more += [(cost + 3 + extra, audit + "R", initials + r[0], [*lines, f"{r}:{text}"]) for r in ("user", "assistant")]
        ways = viable(more)
    for cost, audit, initials, lines in with_inserts(ways):
        if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
    return best


def viable(ways):
    """Prefixes of the grammar, the least of each end."""
    out = {}
    for way in ways:
        if re.fullmatch("s?(ua)*u?", way[2]):
            end = (way[2][-1:], len(way[2]) == 0)
            if end not in out or way[:2] < out[end][:2]:
                out[end] = way
    return list(out.values())


def with_inserts(ways):
    out = list(ways)
    for _ in range(3):
        ways = [(c + 3, a + "I", i + r[0], [*x, f"{r}:"]) for c, a, i, x in ways for r in ("user", "assistant") if re.fullmatch("s?(ua)*u?", i + r[0])]
        out += ways
    return out


def plain(rows):
    """Report of damaged rows by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        seen, faults = set(), []
        for _, _, role, text in own:
            said = text.strip(SPACE)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "sound")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest([(r[2], r[3], f) for r, f in zip(own, faults)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)
    return out


def drawn(seed, conversations=60):
    draw = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(draw.randint(0, 9)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ugly"]) if draw.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = draw.choice(["Yes.", "no", "Why? ", " \n", "", None, "a. ", "x!\n\x0b", "é"])
            rows.append((conv, draw.choice([turn, turn, turn + 3, 1, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_report_equals_exhaustive_search(spark, seed):
    rows = drawn(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS + ", audit string, pos int").repartition(3)
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in repair.repair_report(df).collect()}
    want = plain(harmed(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {conv: want.get(conv, empty) for conv in {r[0] for r in rows}}


def test_repaired_rows_read_as_the_grammar(spark):
    rows = drawn(9)
    plans, numbered = repair.plan_repairs(spark.createDataFrame(rows, ROWS))
    turns = repair.repaired_rows(plans, numbered)
    assert turns.columns == ["conv_id", "place", "edit", "turn", "role", "text"]
    for r in turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role"))), lambda x: F.substring(x["role"], 1, 1)), "").alias("i")).collect():
        assert re.fullmatch("(s?(ua)+)?", r["i"])
    inserted = turns.where("edit = 'I'")
    assert inserted.where("turn is not null or text <> ''").count() == 0 and inserted.count() > 0


def test_hot_conversation_of_copies_and_long_text(spark):
    rows = [(7, 0, "user", "same.")] * 3000 + [(7, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(1, 4000)] + [(8, 0, "user", "x" * 200_000 + " " * 100_000), (8, 1, "assistant", "y.")]
    plans, numbered = repair.plan_repairs(spark.createDataFrame(rows, ROWS))
    got = {r["conv_id"]: r for r in plans.collect()}
    assert (got[7]["duplicate"], got[7]["cost"], got[7]["audit"]) == (2999, 4 * 2999, "K" + "D" * 2999 + "K" * 3999)
    assert (got[8]["truncated"], got[8]["cost"], got[8]["audit"]) == (1, 3, "KK")
    assert repair.repaired_rows(plans, numbered).where("conv_id = 7").count() == 4000


def test_empty_table(spark):
    rows = spark.createDataFrame([], ROWS)
    assert repair.repair_report(rows).count() == 0


def test_states_are_few_and_made_once():
    automaton = repair.Automaton()
    draw = random.Random(2)
    for _ in range(300):
        symbols = bytes(draw.randrange(16) for _ in range(draw.randint(0, 60)))
        cost, states = automaton.scan(symbols)
        audit = automaton.audit(symbols, states)
        assert sum(audit.count(x) for x in "DKR") == len(symbols)
        assert cost == sum({"D": 4, "I": 3, "R": 3, "K": 0}[x] for x in audit) + 3 * sum(s & 3 == repair.CUT and x != "D" for s, x in zip(symbols, audit.replace("I", "")))
    assert len(automaton.costs) < 100
