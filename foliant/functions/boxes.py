"""A question's raw blocks read: where its box ends, texts split into blocks, columns of choices.

A box begins with a mark and runs on to a place that only what follows can tell. Each block is looked at once, for the
few things that matter; the rules then read those, not the texts.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import fragments as fr
from foliant.functions.splitting import parted
from foliant.sources.readers import BLOCK

#: A box's mark at a text's start; labels of items: alone, at a start, after a bullet, after a bullet or a full stop; how a sentence and a question end; bullets.
MARK = re.compile(r"\s*(?:<\s*상자\s*>|(?:<\s*(?:조건|보기|증명)\s*>|\[\s*(?:조건|보기)\s*\])(?![가-힣])(?!\s+(?:중에서|에서|중)(?=[\s,.?]|$)))")
LABEL = r"(?:[ㄱ-ㅎ]\s*\.|[（(]\s*[가-힣]\s*[)）])"
BARE = re.compile(r"(?:[ㄱ-ㅎ]\s*\.?|[（(]\s*[가-힣]\s*[)）]|\d+\s*[.)])\s*")
AHEAD = re.compile(LABEL)
NEXT = re.compile(rf"\s*(?:[•·▪◦○ㅇ]\s*)?{LABEL}")
AFTER_BULLET = re.compile(rf"[•·▪◦○〇ㅇ]\s*{LABEL}")
INSIDE = re.compile(rf"(?:[•·▪◦○〇ㅇ]\s*|(?<=[.．])\s+){LABEL}")
BULLET, BULLET_INSIDE = re.compile("[•·▪◦○〇]"), re.compile(r"[•·▪◦○〇]\s")
ENDED = re.compile(r"[.?!。．？！]\s*\Z")
ASKED = re.compile(r"(?:값은|개수는|합은|최[솟댓]값은|것은|무엇)\s*[?？]|[?？]\s*\Z|구하(?:시오|여라|라)|쓰시오|서술하(?:시오|여라)|기술하(?:시오|여라)")
RELATIONS = re.compile(r"\\(?:leq?|geq?|neq?|fallingdotseq)(?![A-Za-z])")
#: Signs that stand for one bullet; heads of columns of choices; delimiters of formulas.
CIRCLE = re.compile(r"(?:(?<=\s)|^)[ㅇ●〇◦∙](?=\s)")
HEAD = re.compile(r"\(\s*[가-하]\s*\)|[㉠-㉻]")
DELIMITERS = re.compile(r"\\[()\[\]]")
KINDS = {"text", "equation", "equation_block", "image", "table"}


class Seen(NamedTuple):
    """What matters of a block: its kind, whether a sentence or a question ends it, an item begins it, bullets and labels stand in it, and whether it is an equation with a relation of its own."""

    kind: str
    ended: bool
    asked: bool
    item: bool
    bullet: bool
    labelled: bool
    #: what follows the last label in it; None without one
    after: str | None
    relation: bool


def own_relation(s: str) -> bool:
    """A relation outside all brackets."""
    depth = 0
    for i, c in enumerate(s):
        depth = depth + 1 if c in "([{" else max(0, depth - 1) if c in ")]}" else depth
        if not depth and (c in "=<>≤≥≠" or c == "\\" and RELATIONS.match(s, i)):
            return True
    return False


def seen(b: dict) -> Seen:
    v = b["value"] or ""
    if b["type"] != "text":
        return Seen(b["type"] or "", False, False, False, False, False, None, b["type"] in ("equation", "equation_block") and own_relation(v))
    labels = list(INSIDE.finditer(v))
    return Seen("text", bool(ENDED.search(v.strip())), bool(ASKED.search(v)), bool(NEXT.match(v)), bool(BULLET_INSIDE.search(v)), bool(AFTER_BULLET.search(v)), v[labels[-1].end() :].strip() if labels else None, False)


def question_start(rest: str, i: int, all_: list[Seen]) -> int | None:
    """Where the question after a box of conditions starts: the last text that asks, with equations before it that state no relation. Between the last label and it there must be something. A box without labels leaves only a last text that asks."""
    n = len(all_)
    labels = [j for j in range(i + 1, n) if all_[j].labelled] or ([i] if AHEAD.match(rest) else [])
    if not labels:
        return n - 1 if n - 1 > i + 1 and all_[-1].asked else None
    start = next((j for j in range(n - 1, labels[-1], -1) if all_[j].asked), None)
    if start is None:
        return None
    while start - 1 > labels[-1] and all_[start - 1].kind in ("equation", "equation_block") and not all_[start - 1].relation:
        start -= 1
    return start if start > labels[-1] + 1 else None


def box_end(blocks: list[dict]) -> int | None:
    """The place of the first block behind the first box; None where there is no box, or it runs to the end.

    A box whose mark is followed by text in the same block ends with that block, unless what follows shows that it goes
    on: an item as next block; an equation next, after an item's label (then it ends where the text after the last label
    does, or not at all), after a bullet with further bullets behind, after a comma, or in a sentence that no text ends.
    Otherwise only a question behind the conditions ends it.
    """
    i = next((k for k, b in enumerate(blocks) if b["type"] == "text" and MARK.match(b["value"] or "")), None)
    if i is None:
        return None
    all_, n = [seen(b) for b in blocks], len(blocks)
    rest = (blocks[i]["value"] or "")[MARK.match(blocks[i]["value"] or "").end() :].strip()
    if not rest or BARE.fullmatch(rest) or i + 1 == n:
        return question_start(rest, i, all_)
    follower = all_[i + 1]
    if follower.item:
        return None
    if follower.kind == "equation":
        labels = [j for j in range(i + 2, n) if all_[j].after is not None]
        if AHEAD.match(rest) and labels:
            last = labels[-1]
            return last + 1 if all_[last].after.endswith((".", "．")) and last + 1 < n else None
        if BULLET.match(rest) and any(x.bullet for x in all_[i + 2 :]):
            return None
        if rest.endswith((",", "，")):
            return None
        if not ENDED.search(rest) and not any(x.ended for x in all_[i : n - 1]):
            return None
    return i + 1


# Blocks


def rows_of(b: dict) -> list[list[str]] | None:
    """A table's rows: its own, or those that its value spells."""
    if b["rows"]:
        return b["rows"]
    try:
        spelled = json.loads(b["value"] or "")
    except ValueError:
        return None
    cell = lambda c: " ".join(x for x in map(cell, c) if x) if isinstance(c, list) else str(c.get("value") or "") if isinstance(c, dict) else "" if c is None else str(c)
    return [[cell(c) for c in row] if isinstance(row, list) else [cell(row)] for row in spelled] if isinstance(spelled, list) and spelled else None


def read(b: dict) -> list[dict]:
    """The blocks that a raw block stands for: none for figures and what is empty; tables with rows; texts, bullets alike, split into prose, underlined phrases and equations; equations of cases stand in the line. An unknown kind is text."""
    kind, v = b["type"], b["value"] or ""
    if kind == "figure":
        return []
    if kind == "table":
        rows = rows_of(b)
        return [b | {"rows": rows, "value": "" if rows and not b["rows"] else v}] if rows or v.strip() else []
    if not v and kind != "image":
        return []
    if kind == "equation_block" and r"\begin{cases}" in v:
        return [b | {"type": "equation"}]
    if kind in KINDS - {"text"}:
        return [b]
    v = DELIMITERS.sub("$", CIRCLE.sub("○", v))
    if b["underline"]:
        return [b | {"type": "text", "value": v}]
    return [fr.block("equation" if s.type == "equation" else "text", s.value, b, **({"underline": True} if s.type == "underline" else {})) for s in parted(v) if s.value]


def contents(blocks: list[dict]) -> list[dict]:
    """A question's blocks: read, fragments merged, before and behind its box apart; blocks of the box are marked."""
    end = box_end(blocks)
    head = fr.merged([x for b in blocks[:end] for x in read(b)])
    if end is None:
        return head
    start = next((k for k, b in enumerate(head) if fr.is_text(b) and MARK.match(fr.value(b))), len(head))
    return [b | {"box_member": True} if k >= start else b for k, b in enumerate(head)] + fr.merged([x for b in blocks[end:] for x in read(b)])


def question_blocks(blocks: Column) -> Column:
    """An array of raw `sources.readers.BLOCK` as a question's blocks; a null array stays, null entries go."""

    @F.arrow_udf(f"array<{BLOCK}>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if r is None else contents([b for b in r if b is not None]) for r in fr.received(x)], pa.list_(fr.TYPE))

    return run(F.to_json(blocks))


def box_bounds(blocks: Column) -> Column:
    """The place of the first block behind the box of an array of raw blocks; null where it has none or it runs to the end."""

    @F.arrow_udf("int")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([box_end([b for b in r or [] if b is not None]) for r in fr.received(x)], pa.int32())

    return run(F.to_json(blocks))


# Choices


def columns_of(choice: list[dict]) -> list[tuple[str, list[dict]]] | None:
    """A choice's blocks by the heads of columns in its texts; None where something stands before the first head, or a column is empty."""
    out: list[tuple[str, list[dict]]] = []
    for b in choice:
        v = fr.value(b)
        cuts = [*HEAD.finditer(v)] if fr.is_text(b) else []
        pieces = [(None, b)] if not fr.is_text(b) else [(None, b | {"value": v[: cuts[0].start()] if cuts else v})] + [(m[0], b | {"value": v[m.end() : (cuts[k + 1].start() if k + 1 < len(cuts) else None)]}) for k, m in enumerate(cuts)]
        for head, piece in pieces:
            if head:
                out.append((re.sub(r"\s+", "", head), []))
            if not fr.is_text(piece) or fr.value(piece).strip(" ,·\t"):
                if not out:
                    return None
                out[-1][1].append(piece)
    trimmed = []
    for head, blocks in out:
        if blocks and fr.is_text(blocks[0]):
            blocks[0] = blocks[0] | {"value": fr.value(blocks[0]).lstrip(" ,·\t:：")}
        if blocks and fr.is_text(blocks[-1]):
            blocks[-1] = blocks[-1] | {"value": fr.value(blocks[-1]).rstrip(" ,·\t")}
        elif blocks and blocks[-1]["type"] == "equation":
            blocks[-1] = blocks[-1] | {"value": re.sub(r"(?:\s|\\,|,)+\Z", "", fr.value(blocks[-1]))}
        blocks = [x for x in blocks if not fr.is_text(x) or fr.value(x).strip()]
        if not blocks:
            return None
        trimmed.append((head, blocks))
    return trimmed if len(trimmed) > 1 else None


def choice_columns(choices: list[list[dict]]) -> tuple[list[str], list[list[dict]]]:
    """The heads that all choices have in the same order, and the choices with tabs between their columns; no heads and the choices as they are otherwise."""
    parsed = [columns_of(c) for c in choices]
    if len(choices) < 2 or any(p is None or [h for h, _ in p] != [h for h, _ in parsed[0]] for p in parsed):
        return [], choices
    return [h for h, _ in parsed[0]], [[x for k, (_, blocks) in enumerate(p) for x in ([fr.block("text", "\t")] if k else []) + blocks] for p in parsed]


def without_number(number: int, blocks: list[dict]) -> list[dict]:
    """A choice's raw blocks without its own circled number at the start, unless that is all there is."""
    if blocks and 1 <= number <= 20 and fr.is_text(blocks[0]):
        v = fr.value(blocks[0]).lstrip()
        if v[:1] == chr(0x2460 + number - 1) and (len(blocks) > 1 or v[1:].strip()):
            return [blocks[0] | {"value": v[1:].lstrip()}, *blocks[1:]]
    return blocks


CHOICES = pa.struct([("heads", pa.list_(pa.string())), ("choices", pa.list_(pa.struct([("number", pa.int32()), ("contents", pa.list_(fr.TYPE))])))])
#: The passes for choices.
FOR_CHOICES = ("domains", "commas", "signs", "relations", "degrees")


def read_choices(raw: list[dict]) -> dict:
    """Choices with a number, their blocks read and merged, and the heads of their columns, if they have any in common."""
    numbered = [c for c in raw if c and c.get("number")]
    own = [fr.merged([x for b in without_number(c["number"], [fr.whole(b) for b in c.get("contents") or [] if b is not None]) for x in read(b)], *FOR_CHOICES) for c in numbered]
    heads, own = choice_columns(own)
    return {"heads": heads, "choices": [{"number": c["number"], "contents": blocks} for c, blocks in zip(numbered, own, strict=True)]}


def choices_read(choices: Column) -> Column:
    """(heads, choices) of an array of raw choices (number, contents); a null array has none."""

    @F.arrow_udf(f"struct<heads:array<string>,choices:array<struct<number:int,contents:array<{BLOCK}>>>>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([read_choices(json.loads(r) if r else []) for r in x.to_numpy(zero_copy_only=False)], CHOICES)

    return run(F.to_json(choices))
