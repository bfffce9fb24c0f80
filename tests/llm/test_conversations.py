import random
import re
import sys
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pytest

from foliant.llm import conversation_repair as c

sys.setrecursionlimit(20_000)  # of the brute force
DATA = "/root/testdata/sf0.01"


def cheapest(letters):
    """All edits by a table from the end: least cost, then least initials."""

    @lru_cache(None)
    def best(i, state, inserts):
        out = []
        if i == len(letters) and state in c.DONE:
            out.append((0, ""))
        if inserts < 3:
            for role in "ua":
                if (state, role) in c.NEXT and (r := best(i, c.NEXT[state, role], inserts + 1)):
                    out.append((r[0] + 2, "I" + r[1]))
        if i < len(letters):
            initial, fault = c.ROW[letters[i]]
            if r := best(i + 1, state, 0):
                out.append((r[0] + 3, "D" + r[1]))
            for role in [initial, "u", "a"] if fault != "gone" else []:
                if (state, role) in c.NEXT and (r := best(i + 1, c.NEXT[state, role], 0)):
                    out.append((r[0] + (fault == "cut") + 2 * (role != initial), ("K" if role == initial else "R") + r[1]))
        return min(out, default=None)

    return best(0, c.START, 0)


@pytest.mark.parametrize("block", [1, 2, 3, 5, 256])
def test_cheapest_edits(block):
    rng = random.Random(block)
    for _ in range(400):
        letters = "".join(rng.choice("sssuuuaaaxSUAX0123") for _ in range(rng.randint(0, 11)))
        assert c.repair(letters, block) == cheapest(letters), letters


def test_blocks_join_to_the_same():
    rng = random.Random(9)
    for _ in range(20):
        letters = "".join(rng.choice("suauauaxU12") for _ in range(120))
        assert c.repair(letters, 256) == c.repair(letters, 7) == cheapest(letters)
    cost, audit = c.repair("ua" * 20_000)
    assert cost == 0 and audit == "K" * 40_000


def plainly(rows):
    """The contract, written out for the rows of one conversation, given in order after damage."""
    seen, letters, count = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for turn, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        i = "sua".find(role[0]) if role and role[0] in "sua" else 3
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        letters += (c.SOUND if not fault else c.SHORT if fault == "truncated" else c.DOOMED)[i]
        if fault:
            count[fault] += 1
    cost, audit = cheapest(letters)
    out, state, at = [], c.START, iter(rows)
    for e in audit:
        role, text = ("", "") if e == "I" else next(at)[1:]
        if e == "D":
            continue
        role = role if e == "K" else "assistant" if state == c.USER else "user"
        out.append((role, "" if e == "I" else text))
        state = c.NEXT[state, role[0]]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0][0] for r in out))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count.values(), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).hexdigest()))


def damaged(conv, turn, role, text):
    shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
    case, (_, _, role, text) = crc32(f"{shown[0]}:{shown[1]}".encode()) % 20, shown
    return [] if case == 0 else [(turn, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)] * (2 if case == 3 else 1)


def brute_force(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).extend(damaged(conv, turn, role, text))
    return sorted(((conv, *plainly(ordered(own))) for conv, own in by.items()), key=str)


def made(rng, n):
    texts = ["Yes.", "No!", "cut", "", " \t", "same.", "Über? ", None, "ok.\n"]
    return [(rng.choice([None, *range(25), 7, 7, 7, 7]), rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for _ in range(n)]


def test_same_as_plain_python(spark):
    rows = made(random.Random(3), 400)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, c.audited(c.damaged(df)).collect()), key=str)
    assert got == brute_force(rows)


def test_hot_conversation_over_many_ranges(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("hot", t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"Text {t}.", "cut"])) for t in range(600)] + [(f"c{i % 9}", i // 9, "user", "Hi.") for i in range(90)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(7)
    monkeypatch.setattr(c, "HOT", 50)
    assert sorted(map(tuple, c.audited(c.damaged(df)).collect()), key=str) == brute_force(rows)


def test_repaired_rows_and_clashing_names(spark):
    rows = [(1, 0, "user", "Hi.", "x"), (1, 1, "user", "You?", "x"), (1, 1, "user", "You?", "x"), (2, None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")
    got = sorted(map(tuple, c.repaired(df).collect()))
    assert got == [(1, 0, "user", "Hi."), (1, 1, "assistant", "You?")]
    assert {r["conv_id"]: r["audit"] for r in c.audited(df).collect()}[2] == "D"
    assert c.audited(df.limit(0)).count() == 0 and c.repaired(df.limit(0)).count() == 0


def test_given_conversations(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert sorted(map(tuple, c.audited(c.damaged(df)).collect()), key=str) == brute_force(rows)
