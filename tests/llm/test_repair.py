"""Conversation repair against dynamic programming over whole conversations."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from forklore.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, pos long, fault string, ahead string, step int"
MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        bare = re.findall(r"[^\x20\x09-\x0D]", text)
        if not bare:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append(None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """Least (cost, edits) and the repaired lines, row by row and state by state."""

    def inserted(best):
        for _ in range(2):
            for state, (cost, path, lines) in list(best.items()):
                for letter, name in NAMES.items():
                    if letter in MOVES[state]:
                        put(best, MOVES[state][letter], cost + 5, path + "I", [*lines, name + ":"])
        return best

    def put(best, state, *value):
        if state not in best or value[:2] < best[state][:2]:
            best[state] = value

    best = {0: (0, "", [])}
    for (_, role, text), wrong in zip(rows, found):
        after = {}
        for state, (cost, path, lines) in inserted(best).items():
            put(after, state, cost + 2, path + "D", lines)
            if wrong in (None, "truncated"):
                extra = 5 if wrong else 0
                if role[:1] in MOVES[state]:
                    put(after, MOVES[state][role[:1]], cost + extra, path + "K", [*lines, f"{role}:{text}"])
                for letter, name in NAMES.items():
                    if letter in MOVES[state]:
                        put(after, MOVES[state][letter], cost + extra + 1, path + "R", [*lines, f"{name}:{text}"])
        best = after
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def brute(rows, damaged):
    def first(v):
        return (v is not None, v or 0)

    found = []
    for conv, group in groupby(sorted(rows, key=lambda r: first(r[0])), key=lambda r: r[0]):
        kept = []
        for _, turn, role, text in group:
            role, text = (" " if v is None else v for v in (role, text))
            key = ":".join(" " if v is None else str(v) for v in (conv, turn))
            kind = zlib.crc32(key.encode()) % 20 if damaged else 9
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (first(r[0]), r[1].encode(), r[2].encode()))
        wrong = faults(kept)
        cost, path, lines = cheapest(kept, wrong)
        turns = {t for t, _, _ in kept if t is not None}
        near = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        found.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[wrong.count(w) for w in ("blank", "duplicate", "truncated")], sum(n not in ("su", "ua", "au") for n in near),
            cost, path, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(map(repr, found))


def conversations(rng, sizes):
    rows = []
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", "User", "umpire", None]
    for conv, n in enumerate(sizes):
        conv = None if conv == 3 else conv
        for turn in range(n):
            turn = rng.choice([turn] * 12 + [None, 2, turn + 9])
            text = rng.choice(["Hm.", "ok!\n", "é?", None, "", " \t\n", "cut of", "Ja. \x0b", f"t{rng.random()}.", f"t{rng.random()}."])
            rows.append((conv, turn, rng.choice(roles), text))
    return rows + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", "a", 2) for r in rows], SCHEMA)


def test_damaged_conversations_equal_dynamic_programming(spark):
    rows = conversations(random.Random(1), [1, 2, 3, 30, *[random.Random(2).randint(1, 12) for _ in range(150)]])
    rows += [(c, t, "user", "x.") for c, t in ((1000 + c, t) for c in range(40) for t in range(1))]  # some lose their only row
    got = repair.repaired_after_damage(frame(spark, rows))
    assert got.columns == ["conv_id", *repair.NUMBERS, "audit", "repaired_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, True)


@pytest.mark.parametrize("block", [1, 4, 64])
def test_long_conversations_in_blocks(spark, block):
    rows = conversations(random.Random(block), [5, 150, 9, 40, 64, 65, 4, 8])
    rows += [(900, t, "assistant", "twice.") for t in (None, 1)] * 40  # copies across the edges of blocks
    got = repair.digests(repair.repair(frame(spark, rows), block))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, False)


def test_edits_of_a_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "user", "Hello?"), (1, 3, "assistant", " ")]
    got = repair.repair(frame(spark, rows)).orderBy("step").collect()
    assert [(r.edit, r.was, r.role, r.text, r.fault, r.cost) for r in got] == [
        ("K", "system", "system", "Be kind.", None, 0), ("K", "user", "user", "Hi!", None, 0),
        ("R", "user", "assistant", "Hello?", None, 1), ("D", "assistant", "assistant", " ", "blank", 2),
    ]


def test_empty_table(spark):
    assert repair.repaired_after_damage(frame(spark, [(1, 1, "user", "x")]).limit(0)).collect() == []
