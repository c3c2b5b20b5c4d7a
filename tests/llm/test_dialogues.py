"""Conversation repair against an exhaustive search, and odd conversations."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from aislecast.llm import dialogues

COLUMNS = "conv_id long, turn long, role string, text string, cost string, rows string"


def frame(spark, rows):
    """Conversation rows, and columns whose names the operator uses too."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], COLUMNS)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        named = ":".join(" " if v is None else str(v) for v in (conv, turn))
        draw = zlib.crc32(named.encode()) % 20
        if draw == 1:
            text = ""
        if draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        if draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return out


def digest_order(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0), role, hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def plain_repair(rows):
    """Faults and the best (cost, audit, lines) of all edit sequences, row by row."""
    rows = sorted(rows, key=digest_order)
    seen, marked = set(), []
    for _, _, role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))

    @lru_cache(None)
    def best(at, state, inserts):
        found = [(0, "", ())] if at == len(marked) and state in ("", "a") else []
        write = "assistant" if state == "u" else "user"
        if inserts < 3:
            found.append(edit("I", 2, best(at, write[0], inserts + 1), (f"{write}:",)))
        if at < len(marked):
            role, text, fault = marked[at]
            found.append(edit("D", 3, best(at + 1, state, 0), ()))
            if fault in ("", "truncated"):
                more = int(fault == "truncated")
                if role and state + role[:1] in ("s", "u", "su", "ua", "au"):
                    found.append(edit("K", more, best(at + 1, role[:1], 0), (f"{role}:{text}",)))
                found.append(edit("R", 2 + more, best(at + 1, write[0], 0), (f"{write}:{text}",)))
        return min(found, default=(1 << 30, "", ()))

    def edit(letter, cost, rest, lines):
        return rest[0] + cost, letter + rest[1], lines + rest[2]

    cost, audit, lines = best(0, "", 0)
    counts = [sum(m[2] == k for m in marked) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "ends. \n", "a", "b?", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("segment_rows", [1, 3, 64])
def test_repair_equals_exhaustive_search(spark, segment_rows):
    rows = random_rows(segment_rows, 60, 14) + [(None, 2, "user", "Hi."), (None, None, None, None), (None, 1, "x", "y")]
    damaged = plain_damage(rows)
    found = dialogues.repair(frame(spark, damaged), segment_rows).collect()
    ids = {r[0] for r in damaged}
    assert len(found) == len(ids) and {r[0] for r in found} == ids
    for row in found:
        assert tuple(row)[1:] == plain_repair([r for r in damaged if r[0] == row[0]]), row


def test_damage_equals_plain_damage(spark):
    rows = random_rows(9, 40, 8) + [(None, None, None, None), (7, None, "user", "a.b!c?"), (None, 3, None, "z")]
    found = dialogues.damaged(frame(spark, rows)).collect()
    key = str
    assert sorted(map(tuple, found), key=key) == sorted(plain_damage(rows), key=key)


def test_every_conversation_stays(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (gone, 0, "user", "Hello.")]
    found = [tuple(r) for r in dialogues.damage_and_repair(frame(spark, rows)).collect()]
    assert found == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert dialogues.damage_and_repair(frame(spark, [])).count() == 0


def test_one_long_conversation_over_many_tasks(spark):
    rng = random.Random(4)
    rows = [
        (5, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"row {t}.", f"row {t}", "Again.", ""]))
        for t in range(900)
    ]
    # Very long texts and repeated rows.
    rows += [(5, 900, "user", "word " * 100_000 + "end."), (5, 901, "assistant", "x" * 300_000)] + [(5, 902, "user", "Same.")] * 3
    (row,) = dialogues.repair(frame(spark, rows).repartition(5)).collect()
    table = {"": (0, "")}
    ordered, seen = sorted(rows, key=digest_order), set()
    for _, _, role, text in ordered:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        gone, more = not last or (role, text) in seen, int(last not in ".!?")
        seen.add((role, text))
        reached = {}
        for state, (cost, audit) in table.items():
            for n, now in enumerate([state, "a" if state == "u" else "u", "u" if state == "u" else "a"]):
                write = "a" if now == "u" else "u"
                steps = [("D", now, 3)]
                if not gone:
                    steps.append(("R", write, 2 + more))
                    if now + role[0] in ("s", "u", "su", "ua", "au"):
                        steps.append(("K", role[0], more))
                for edit, to, paid in steps:
                    candidate = (cost + 2 * n + paid, audit + "I" * n + edit)
                    reached[to] = min(reached.get(to, (1 << 30, "")), candidate)
        table = reached
    ends = {"": 0, "s": 2, "u": 1, "a": 0}
    assert (row["cost"], row["audit"]) == min((c + 2 * ends[s], a + "I" * ends[s]) for s, (c, a) in table.items())
