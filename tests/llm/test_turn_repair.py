"""Conversation repair against a plain forward search, turn by turn, and against all edits of short conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vexel.llm import turn_repair as R

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COST = {"K": 0, "R": 2, "D": 3, "I": 2}


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults_of(turns):
    """(has to go, truncated) of each turn, and the counts."""
    seen, out = set(), []
    for _, _, role, text in turns:
        end = text.rstrip(WHITE)
        kind = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def repaired_by_hand(turns):
    """Forward over turns: of each role seen last the least (cost, letters, lines)."""
    kinds = faults_of(turns)

    def more(ways):  # inserted turns
        for _ in range(4):
            for last, (cost, letters, lines) in list(ways.items()):
                role = "assistant" if last == "u" else "user"
                new = (cost + 2, letters + "I", lines + [role + ":"])
                if role[0] not in ways or new[:2] < ways[role[0]][:2]:
                    ways[role[0]] = new
        return ways

    ways = more({"": (0, "", [])})
    for (_, _, role, text), kind in zip(turns, kinds):
        new = {}

        def put(last, way):
            if last not in new or way[:2] < new[last][:2]:
                new[last] = way

        for last, (cost, letters, lines) in ways.items():
            put(last, (cost + 3, letters + "D", lines))
            if kind not in ("blank", "duplicate"):
                extra = 1 if kind == "truncated" else 0
                after = ["s", "u"] if last == "" else ["a"] if last == "u" else ["u"]
                if role[:1] in after:
                    put(role[0], (cost + extra, letters + "K", lines + [f"{role}:{text}"]))
                own = "assistant" if last == "u" else "user"
                put(own[0], (cost + 2 + extra, letters + "R", lines + [f"{own}:{text}"]))
        ways = more(new)
    cost, letters, lines = min((ways[k] for k in ("", "a") if k in ways), key=lambda w: w[:2])
    return cost, letters, lines


def by_hand(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = damaged_by_hand([r for r in rows if r[0] == conv])
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        kinds, numbers = faults_of(turns), {t[1] for t in turns} - {None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(turns, turns[1:])]
        cost, letters, lines = repaired_by_hand(turns)
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("row"), F.lit(1).alias("part"), F.lit(2).alias("codes"))


def invented(rng, n, longest):
    texts = ["Yes.", "No", "why?", "", " \n", "Stop! ", "a.b", "ünï.", None]
    return [
        (None if conv == 0 else conv, None if rng.random() < 0.05 else rng.randrange(longest), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}{rng.choice('.!?x')}")
        for conv in range(n) for _ in range(rng.randrange(longest))
    ]


@pytest.mark.parametrize("per_task, fan, longest", [(200_000, 32, 9), (40, 2, 9), (15, 3, 120), (7, 2, 40)])
def test_same_as_a_forward_search_in_any_partitioning(spark, per_task, fan, longest):
    rng = random.Random(longest + fan)
    rows = invented(rng, 30, longest)
    if longest == 120:
        rows += [(7, None, "user", "again and again.")] * 60 + [(8, 5, "assistant", "")] * 50  # one row in a third of the table
    rng.shuffle(rows)
    got = R.conversation_repair(table_of(spark, rows), per_task, fan).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == by_hand(rows)


def test_all_edits_of_short_conversations():
    for codes in itertools.chain.from_iterable(itertools.product("suaoSUAOx", repeat=n) for n in range(3)):
        best = None
        for picked in itertools.product(*(["D"] if c == "x" else ["K", "R", "D"] for c in codes)):
            for gaps in itertools.product(range(3), repeat=len(codes) + 1):
                letters = "".join("I" * g + e for g, e in zip(gaps, picked)) + "I" * gaps[-1]
                made, at = [""], 0
                for letter in letters:
                    if letter != "I":
                        code, at = codes[at], at + 1
                    made = made if letter == "D" else [m + code.lower() for m in made] if letter == "K" else [m + r for m in made for r in "ua"]
                if any(re.fullmatch("(s?(ua)+)?", m) for m in made):
                    way = (sum(COST[x] for x in letters) + sum(e != "D" and c.isupper() for e, c in zip(picked, codes)), letters)
                    best = way if best is None else min(best, way)
        matrix = R.product("".join(codes))
        assert matrix[R.best_end(matrix)] == best, codes


def test_product_is_associative_and_routes_join(spark):
    rng = random.Random(3)
    for _ in range(200):
        codes = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(1, 40)))
        cuts = sorted(rng.sample(range(len(codes) + 1), min(3, len(codes))))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        matrices, whole = [R.product(p) for p in parts], R.product(codes)
        left = R.EMPTY
        for m in matrices:
            left = R.times(left, m)
        assert left == whole
        end = R.best_end(whole)
        ways = R.route(matrices, R.START, end)
        assert "".join(m[4 * i + j][1] for m, (i, j) in zip(matrices, ways)) == whole[end][1]


def test_very_long_conversation_lies_in_many_partitions(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(6000)] + [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "y.")]
    got = {r["conv_id"]: tuple(r)[1:] for r in R.conversation_repair(table_of(spark, rows), per_task=300, fan=4).collect()}
    assert got == by_hand(rows)


def test_repaired_turns_and_empty_table(spark):
    empty = R.repair_conversations(table_of(spark, []))
    assert empty.report.count() == empty.turns.count() == 0
    assert R.conversation_repair(table_of(spark, [])).count() == 0
    got = R.repair_conversations(table_of(spark, [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "b."), (1, 3, "assistant", "b.")])).turns.orderBy("position").collect()
    assert [(r["position"], r["edit"], r["role"], r["text"]) for r in got] == [(0, "K", "system", "s."), (1, "R", "user", "a."), (2, "K", "assistant", "b.")]
    got = R.repair_conversations(table_of(spark, [(1, 0, "user", "u."), (1, 1, "assistant", "a."), (1, 2, "user", "v.")])).turns.orderBy("position").collect()
    assert [tuple(r)[1:] for r in got] == [(0, "K", "user", "u."), (1, "K", "assistant", "a."), (2, "K", "user", "v."), (3, "I", "assistant", "")]


def test_conversation_whose_rows_are_all_dropped(spark):
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = R.conversation_repair(table_of(spark, [(gone, 0, "user", "lost.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
