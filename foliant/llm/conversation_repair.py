"""Repair of the structure of conversations: the cheapest edits, found by A* on the edit lattice.

A repaired conversation has roles whose initials read `(s?(ua)+)?`. Its rows are taken by turn (nulls first), rows of
one turn by role and digest of the text. A row's first fault counts: blank (no visible character), duplicate (role and
text seen before in the conversation), truncated (the last visible character is not `.`, `!` or `?`). Edits: Keep costs
0; Rerole, to user or assistant, 2; Delete 3, required for blank and duplicate rows; Insert of an empty user or
assistant row anywhere 2; a truncated row that stays adds 1. Of the cheapest edits those whose initials are ASCII-least
are taken.

A node of the lattice is the number of rows dealt with and the state of the pattern. The heuristic is a suffix sum of
what the rows left must cost: 3 for each that must go, 1 for each truncated one. No edit costs less than it takes off
that sum, so the first path to reach a node is cheapest; paths of equal cost leave the queue by their initials. Two
such paths to one node cannot be prefixes of each other, since the longer would hold one Insert more, so the order of
initials carries over to whole edits. Conversations of more than BLOCK rows are searched block by block from each
state; paths are joined at the borders by cost and rank of their initials, Inserts at a border count to the block
after it, and the result is the same.

Rows are first reduced to a letter each (role initial and fault). A conversation's rows may lie in many tasks, which
are ranges of (conversation, turn); equal rows are counted before that. What meets in one task is a letter a row, as
the result's `audit` has it too. Texts are only shuffled for the repaired rows, which stream through sorted tasks; no
conversation's texts are held together.

Null roles and texts count as one space, so they are blank or need another role; null turns come first, and a null
conv_id is a conversation of its own. Repeated rows are duplicates. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import HOT, hot_join, written

#: Rows that are searched in one go.
BLOCK = 256
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a; and what follows a state and an initial.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
DONE = {START, ASSISTANT}
#: A row's letter: its role's initial (x: any other), in capitals if it must go, as a digit if it is truncated.
SOUND, DOOMED, SHORT = "suax", "SUAX", "0123"
ROW = {letter: (initial, fault) for letters, fault in ((SOUND, ""), (DOOMED, "gone"), (SHORT, "cut")) for letter, initial in zip(letters, SOUND, strict=True)}
LEGAL = {"su", "ua", "au"}
VISIBLE = r"[^\x20\x09-\x0D]"


# The search


def search(letters: str, start: int = START, last: bool = True) -> dict[int, tuple[int, str]]:
    """The cheapest edits of the rows, from a state on, as (cost, initials). last: to the end of a conversation, under the state they end in; else under each state that they can end in right after a row."""
    rest = [0]
    for x in reversed(letters):
        rest.append(rest[-1] + {"": 0, "gone": DELETE, "cut": CUT}[ROW[x][1]])
    rest.reverse()
    queue, closed, found = [(rest[0], "", 0, start)], set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        spent, moves = f - rest[i], []
        if i == len(letters):
            if not last:
                found[state] = (spent, audit)
                continue
            if state in DONE:
                return {state: (spent, audit)}
        else:
            initial, fault = ROW[letters[i]]
            moves.append(("D", DELETE, 1, state))
            if fault != "gone":
                extra = CUT if fault else 0
                moves += [("K" if role == initial else "R", extra + (0 if role == initial else REROLE), 1, NEXT[state, role]) for role in {initial, "u", "a"} if (state, role) in NEXT]
        moves += [("I", INSERT, 0, NEXT[state, role]) for role in "ua" if (state, role) in NEXT]
        for edit, cost, step, to in moves:
            if (i + step, to) not in closed:
                heapq.heappush(queue, (spent + cost + rest[i + step], audit + edit, i + step, to))
    return found


def repair(letters: str, block: int = BLOCK) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of a whole conversation."""
    paths = {START: (0, 0)}  # state: cost, rank of the initials
    steps: list[dict[int, tuple[int, str]]] = []  # state: the state before, and the block's initials
    blocks = [letters[i : i + block] for i in range(0, len(letters), block)] or [""]
    for k, part in enumerate(blocks):
        ways = []
        for state, (cost, rank) in paths.items():
            for to, (more, audit) in search(part, state, k == len(blocks) - 1).items():
                ways.append((cost + more, (rank, audit), to, state))
        ranks = {key: r for r, key in enumerate(sorted({w[1] for w in ways}))}
        best: dict[int, tuple] = {}
        for w in sorted(ways):
            best.setdefault(w[2], w)
        paths = {to: (w[0], ranks[w[1]]) for to, w in best.items()}
        steps.append({to: (w[3], w[1][1]) for to, w in best.items()})
    cost, _, state = min((cost, rank, state) for state, (cost, rank) in paths.items())
    audit = []
    for step in reversed(steps):
        state, part = step[state]
        audit.append(part)
    return cost, "".join(reversed(audit))


known = lru_cache(maxsize=20_000)(repair)


# Conversations as letters


def conversation() -> Column:
    """A key of the conversation that is never null."""
    return F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))


def prepared(rows: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text (no nulls in the last two), digest of the text, and copies, 1 where rows have no such column."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    kept = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(conversation().alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), *kept, copies.alias("copies")).withColumn("digest", F.sha2("text", 256))


def order(*first: str) -> list[Column]:
    return [*map(F.asc, first), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def lettered(rows: DataFrame) -> DataFrame:
    """One row for equal rows of `prepared`: how many are blank, duplicate and truncated, and a letter for each."""
    blank, cut = ~F.col("text").rlike(VISIBLE), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    same = written(rows.groupBy("key", "conv_id", "turn", "role", "digest", blank.alias("none"), cut.alias("cut")).agg(F.sum("copies").alias("n")), "conversation-rows")
    seen = same.filter("n > 0 and not none").groupBy("key", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).filter("turns > 1").drop("turns")
    known_first = hot_join(same, seen, ["key", "role", "digest"], same.count(), hot=HOT)
    again = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    initial = F.substring("role", 1, 1)
    sound = F.when(initial.isin(*SOUND[:3]), initial).otherwise(SOUND[3])
    doomed = F.upper(sound)
    one = F.when(F.col("cut"), F.translate(sound, SOUND, SHORT)).otherwise(sound)
    n, gone = F.col("n"), F.col("none") | again
    return known_first.select(
        "key", "conv_id", "turn", "role", "digest", "n",
        F.when(F.col("none"), n).otherwise(0).alias("blank"),
        F.when(F.col("none") | (n == 0), 0).otherwise(F.when(again, n).otherwise(n - 1)).alias("duplicate"),
        (F.col("cut") & ~gone & (n > 0)).cast("long").alias("truncated"),
        F.when(n == 0, "").when(gone, F.repeat(doomed, n.cast("int"))).otherwise(F.concat(one, F.repeat(doomed, (n - 1).cast("int")))).alias("letters"),
    )


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each stretch of a conversation's sorted rows, and where it begins."""
    names = ["key", "turn", "role", "digest", "letters"]
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    out: list[tuple] = []
    for _, own in groupby(rows, lambda r: r[0]):
        first = next(own)
        out.append((*first[:-1], first[-1] + "".join(r[-1] for r in own)))
        if len(out) == 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], STRETCH)
            out = []
    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], STRETCH)


STRETCH = pa.schema([(c, pa.int64() if c == "turn" else pa.string()) for c in ("key", "turn", "role", "digest", "letters")])


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """illegal, cost and audit of each row's letters, beside its key."""
    for batch in batches:
        rows = batch.column(1).to_pylist()
        initials = [[ROW[x][0] for x in letters] for letters in rows]
        illegal = [sum(a + b not in LEGAL for a, b in zip(x, x[1:], strict=False)) for x in initials]
        edits = [known(x) if len(x) <= BLOCK else repair(x) for x in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(illegal, pa.int64()), pa.array([x[0] for x in edits], pa.int64()), pa.array([x[1] for x in edits], pa.string())], names=["key", "illegal", "cost", "audit"])


def plans(rows: DataFrame) -> DataFrame:
    """key, conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of `prepared` rows; those with no copies count only as conversations."""
    letters = written(lettered(rows), "conversation-letters")
    here = F.when(F.col("n") > 0, F.col("turn"))
    facts = letters.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.coalesce(F.max(here) - F.min(here) + 1 - F.countDistinct(here), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    cut = letters.select("key", "turn", "role", "digest", "letters").repartitionByRange(*order("key")).sortWithinPartitions(*order("key")).mapInArrow(stretches, "key string, turn long, role string, digest string, letters string")
    whole = cut.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "letters"))), lambda x: x["letters"]), "").alias("letters"))
    return facts.join(whole.mapInArrow(searched, "key string, illegal long, cost long, audit string"), "key")


# Repaired rows


class Script:
    """Applies a conversation's edits to its rows as they come: gives the rows that stand in the end, as role and text."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def put(self, role: str, text: str) -> tuple[str, str]:
        self.state = NEXT[self.state, role[:1]]
        return role, text

    def needed(self) -> str:
        return "assistant" if self.state == USER else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.put(self.needed(), "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            yield self.put(role if edit == "K" else self.needed(), text)


def applied(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, object, Iterator[tuple[str, str]]]]:
    """key, conv_id and repaired rows of each conversation, from sorted rows of key, conv_id, whether it is a row, role, text (the edits, where it is none) and copies."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))

    def repaired_rows(own) -> Iterator[tuple[str, str]]:
        for _, _, _, role, text, copies in own:
            for _ in range(copies):
                yield from script.row(role, text)
        yield from script.inserted()

    for key, own in groupby(rows, lambda r: r[0]):
        _, conv_id, _, _, audit, _ = next(own)
        script = Script(audit)
        yield key, conv_id, repaired_rows(own)


def streamed(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's edits, then its rows in order."""
    none = F.lit(None)
    head = planned.select("key", "conv_id", F.lit(False).alias("row"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("digest"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("copies"))
    both = head.unionByName(rows.filter("copies > 0").withColumn("row", F.lit(True)))
    return both.repartition("key").sortWithinPartitions(*order("key", "row")).select("key", "conv_id", "row", "role", "text", "copies")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role and text of what stands after the cheapest edits of the conversations in rows (conv_id, turn, role, text)."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, conv_id, own in applied(batches):
            for place, (role, text) in enumerate(own):
                out.append((conv_id, place, role, text))
                if len(out) == 1_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["conv_id", "place", "role", "text"])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["conv_id", "place", "role", "text"])

    ready = prepared(rows)
    return streamed(ready, plans(ready)).mapInArrow(run, f"conv_id {kind.simpleString()}, place long, role string, text string")


def audited(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of role:text of the repaired rows, joined by newlines) of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes = [], []
        for key, _, own in applied(batches):
            digest, mark = sha256(), ""
            for role, text in own:
                digest.update(f"{mark}{role}:{text}".encode())
                mark = "\n"
            keys.append(key)
            hashes.append(digest.hexdigest())
            if len(keys) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(hashes)], names=["key", "repaired_sha256"])
                keys, hashes = [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(hashes)], names=["key", "repaired_sha256"])

    ready = prepared(rows)
    planned = written(plans(ready), "conversation-edits")
    return planned.join(streamed(ready, planned).mapInArrow(run, "key string, repaired_sha256 string"), "key").drop("key")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults, as a crc32 of conversation and turn has it: of twenty rows one goes (no copies), one is emptied, one loses its stops, one is repeated and one gets the role user. Nulls become one space."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    case = F.crc32(F.concat_ws(":", shown["conv_id"], shown["turn"])) % 20
    return conversations.select(
        "conv_id", "turn",
        F.when(case == 4, "user").otherwise(shown["role"]).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(shown["text"], "[.!?]", "")).otherwise(shown["text"]).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )
