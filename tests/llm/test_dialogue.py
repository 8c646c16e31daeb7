"""Conversation repair against a search over all edits and a row-by-row dynamic programme."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from mlframes.llm import dialogue

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        kept = BLANK.findall(text)
        out.append("b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Least (cost, edits) over the turns from each state, written out without runs, powers or blocks."""
    keep = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(maxsize=None)
    def best(i, last):
        made = "a" if last == "u" else "u"
        options = []
        if i == len(rows):
            if last in ("", "a"):
                return 0, ""
            cost, edits = best(i, made)
            return cost + 2, "I" + edits
        ways = [(3, "D", last)]
        if marks[i] not in ("b", "d"):
            more = marks[i] == "t"
            ways.append((2 + more, "R", made))
            if (last, rows[i][0][:1]) in keep:
                ways.append((0 + more, "K", keep[last, rows[i][0][:1]]))
        for inserts in range(3):
            state, spent = last, 2 * inserts
            for _ in range(inserts):
                state = "a" if state == "u" else "u"
            made = "a" if state == "u" else "u"
            for cost, edit, then in ([(3, "D", state)] + ([] if marks[i] in ("b", "d") else
                    [(2 + (marks[i] == "t"), "R", made)] + ([((marks[i] == "t") + 0, "K", keep[state, rows[i][0][:1]])]
                                                            if (state, rows[i][0][:1]) in keep else []))):
                after, edits = best(i + 1, then)
                options.append((spent + cost + after, "I" * inserts + edit + edits))
        return min(options)

    return best(0, "")


def repaired(rows, edits):
    out, state, i = [], "", 0
    for e in edits:
        made = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[made]
        if e == "I":
            out.append(f"{name}:")
            state = made
            continue
        role, text = rows[i]
        i += 1
        if e == "R":
            out.append(f"{name}:{text}")
            state = made
        elif e == "K":
            out.append(f"{role}:{text}")
            state = role[0]
    return "\n".join(out)


def expected(conv, rows):
    """The contract's row of one conversation from its (turn, role, text), damage included."""
    hurt = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        hurt += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    pairs = [r[1:] for r in hurt]
    marks = faults(pairs)
    cost, edits = cheapest(tuple(pairs), tuple(marks))
    known = [r[0] for r in hurt if r[0] is not None]
    gaps = min(max(known) - min(known) + 1 - len(set(known)), 2**63 - 1) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    return (conv, gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, edits,
            hashlib.sha256(repaired(pairs, edits).encode()).hexdigest())


def conversations(seed, count, longest):
    draw, rows = random.Random(seed), []
    for conv in range(count):
        for turn in range(draw.randint(1, longest)):
            rows.append((conv, draw.choice([turn, turn, turn, None, draw.randint(0, 5)]),
                         draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         draw.choice(["Yes.", "No", "  ", "", "Ça va? ", "wait...\n", "hm", None, f"t{turn}!", f"u{turn}.", f"v{turn}"])))
    return rows


def compare(spark, rows, most_rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(parts)
    got = {r[0]: tuple(r) for r in dialogue.repair_report(df, most_rows).collect()}
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(row)
    want = {conv: expected(conv, of) for conv, of in by_conv.items()}
    assert got == want


@pytest.mark.parametrize("most_rows", [65_536, 3, 1])
def test_every_row_of_the_contract(spark, most_rows):
    compare(spark, conversations(most_rows, 60, 14) + [(None, None, "user", "null conversation"), (None, 2, None, None)], most_rows)


def test_one_conversation_over_many_tasks_and_blocks(spark):
    draw = random.Random(5)
    rows = [(7, t, draw.choice(["user", "user", "assistant", "system"]), draw.choice(["Go on", f"Part {t}.", "", f"x{t}"])) for t in range(400)]
    compare(spark, rows + conversations(9, 20, 5), 16, parts=8)


def test_long_runs_and_very_long_texts(spark):
    rows = [(1, t, "user", f"same role {t}.") for t in range(300)] + [(1, 300 + t, "assistant", f"cut {t}") for t in range(257)]
    rows += [(2, 0, "user", "a" * 1_000_000 + "."), (2, 1, "assistant", "é" * 700_000), (2, 2, "user", " " * 100_000)]
    compare(spark, rows, 100)


def test_repeated_rows_and_null_turns(spark):
    rows = [(5, -2**62, "user", "Far."), (5, 2**62, "assistant", "Apart."), (6, -2**63, "user", "Too far."), (6, 2**63 - 1, "assistant", "Apart.")]
    rows += [(3, None, "user", "Hi.")] * 40 + [(3, 5, "user", "Hi.")] * 3 + [(4, 1, "assistant", "Only.")] * 2
    compare(spark, rows, 7)


def test_empty_table_and_extra_columns(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, fault string, edge int, part int, digest binary"
    assert dialogue.repair_report(spark.createDataFrame([], schema)).collect() == []
    one = spark.createDataFrame([(1, 0, "user", "Hello?", "x", 1, 2, b"3"), (1, 1, "assistant", "Yes!", "x", 1, 2, b"3")], schema)
    assert dialogue.report(one).collect()[0]["audit"] == "KK"


def test_turns_are_the_repaired_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "A?"), (1, 1, "user", "B?"), (1, 2, "assistant", "C.")],
                               "conv_id bigint, turn bigint, role string, text string")
    rows = dialogue.turns(dialogue.repair(df)).orderBy("part", "block", "place").collect()
    assert [(r.role, r.text) for r in rows] == [("user", "A?"), ("assistant", ""), ("user", "B?"), ("assistant", "C.")]
    assert dialogue.repair(df).first()["edits"] == "KIKK"


def test_matrices_agree_with_single_steps():
    draw = random.Random(1)
    for _ in range(30):
        symbols = bytes(draw.choice([0, 1, 2, 2, 3, 5, 6, 8]) for _ in range(draw.randint(1, 40)))
        costs = dialogue.matrix(symbols)
        for state in range(4):
            after = dialogue.END
            for symbol in reversed(symbols):
                after = dialogue.to_go(symbol, 1, after)
            assert (costs[state] + list(dialogue.END)).min() == after[state]
