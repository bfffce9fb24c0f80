"""Texts cut into prose and formulas, by one lexer that knows how deep in brackets it is.

Every splitter gives spans of its text, which joined give the text again: nothing is lost or made up. A span is prose,
a formula or underlined; its value is what is left of it without delimiters and outer spaces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Span(NamedTuple):
    """type: text, equation or underline; value; raw: the stretch of the text that it stands for."""

    type: str
    value: str
    raw: str


#: Hangul, bullets, numbers of parts in brackets, labels in brackets; relations at the top of an equation; how long letters without a sign may be and count as a formula.
HANGUL = re.compile("[가-힣ㄱ-ㆎ]")
BULLET = re.compile("[•·▪◦○〇]")
PART = re.compile(r"(?<![A-Za-z0-9])\(\s*(?:i{1,3}|iv|v)\s*\)")
LABEL = re.compile(r"[(（]\s*[가-힣]\s*[)）]")
RELATIONS = re.compile(r"=|<|>|\\(?:leq?|geq?|neq?|in|to|mapsto|parallel|perp|equiv|sim|cong)(?![A-Za-z])|[→:≤≥≠∥⊥∽≡⫽]")
WORD = 20
#: Signs between atoms of a formula in a text; signs that a command is joined to from the left.
SIGN = set("=><+-×÷≤≥≠^_")
LEADING = set("=<>≤≥≠≈≡≅∼+-±×÷·∘*/^∓→↔⇒⇔")
COMMAND = re.compile(r"\\(?:[A-Za-z]+|[!,;: {}])")
ENVIRONMENT = re.compile(r"\\begin\s*\{(\w+)\}.*?\\end\s*\{\1\}", re.S)
INLINE = re.compile(r"(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)")
UNDERLINE = re.compile(r"(?<!_)__(?!_)(.+?)(?<!_)__(?!_)")
NUMBER, SCRIPT = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)?"), re.compile("[A-Za-z0-9]+")
BETWEEN, BEFORE_BRACKET = re.compile(r"\s*[=><+\-×÷≤≥≠]\s*"), re.compile(r"\s*(?=\()")
LEFT_SCRIPT = re.compile(r"\{\}\s*[_^]\s*\{[^{}]*\}\s*\Z")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


def depths(s: str) -> list[int]:
    """How many brackets are open before each character, and at the end; a closing one without its pair counts for nothing."""
    out, depth = [], 0
    for c in s:
        out.append(depth)
        depth = depth + 1 if c in OPEN else max(0, depth - 1) if c in CLOSE else depth
    return [*out, depth]


def partners(s: str) -> dict[int, int]:
    """The place of the closing bracket of each opening one that has one of its kind."""
    out, open_ = {}, []
    for i, c in enumerate(s):
        if c in OPEN:
            open_.append(i)
        elif c in CLOSE and open_ and s[open_[-1]] == CLOSE[c]:
            out[open_.pop()] = i
    return out


def top_level_parts(s: str) -> list[str]:
    """The parts between commas outside all brackets; the comma of a spacing command is none."""
    deep, parts, at = depths(s), [], 0
    for i, c in enumerate(s):
        if c == "," and not deep[i] and s[i - 1 : i] != "\\":
            parts.append(s[at:i])
            at = i + 1
    return [*parts, s[at:]]


def is_wrapped(s: str) -> bool:
    """One pair of brackets goes around all."""
    return s[:1] == "(" and s[-1:] == ")" and partners("".join(c if c in "()" else "." for c in s)).get(0) == len(s) - 1


def has_relation(s: str) -> bool:
    """A relation stands outside all brackets."""
    deep = depths(s)
    return any(not deep[m.start()] for m in RELATIONS.finditer(s))


def joined(spans: list[Span]) -> list[Span]:
    """Without empty spans, neighbouring prose in one."""
    out: list[Span] = []
    for s in spans:
        if out and s.type == out[-1].type == "text":
            out[-1] = Span("text", out[-1].raw + s.raw, out[-1].raw + s.raw)
        elif s.raw:
            out.append(s)
    return out


def text(raw: str) -> Span:
    return Span("text", raw, raw)


def formula(raw: str) -> list[Span]:
    """A formula, the spaces around it as prose."""
    bare = raw.strip()
    at = raw.find(bare) if bare else len(raw)
    return [text(raw[:at]), *([Span("equation", bare, bare)] if bare else []), text(raw[at + len(bare) :])]


def by_pattern(s: str, pattern: re.Pattern, kind: Callable[[str], str], rest: Callable[[str], list[Span]]) -> list[Span]:
    out, at = [], 0
    for m in pattern.finditer(s):
        out += [*rest(s[at : m.start()]), Span(kind(m[1]), m[1].strip() if kind(m[1]) == "equation" else m[1], m[0])]
        at = m.end()
    return joined([*out, *rest(s[at:])])


def inline(s: str) -> list[Span]:
    """Formulas between single dollar signs."""
    return by_pattern(s, INLINE, lambda x: "equation", lambda x: [text(x)])


def underlined(s: str) -> list[Span]:
    """Phrases between double underscores; one of Latin letters or numbers without Hangul is a formula."""
    return by_pattern(s, UNDERLINE, lambda x: "underline" if HANGUL.search(x) or not re.search("[A-Za-z0-9]", x) else "equation", lambda x: [text(x)])


# Formulas without commands


def scripts_end(s: str, at: int, pairs: dict[int, int]) -> int:
    """The end of the scripts that follow a place."""
    while at < len(s) and s[at] in "_^":
        if s[at + 1 : at + 2] == "{" and at + 1 in pairs:
            at = pairs[at + 1] + 1
        elif m := SCRIPT.match(s, at + 1):
            at = m.end()
        else:
            break
    return at


def atom_end(s: str, at: int, pairs: dict[int, int], hangul: list[int]) -> int:
    """The end of the atom that begins at a place, the place itself if none does: numbers, letters and brackets without Hangul, with their scripts, in a row."""
    start = at
    while at < len(s):
        if m := NUMBER.match(s, at):
            at = scripts_end(s, m.end(), pairs)
        elif s[at] == "(" and at in pairs and hangul[at] == hangul[pairs[at]]:
            at = scripts_end(s, pairs[at] + 1, pairs)
        else:
            break
    if at > start and (m := BEFORE_BRACKET.match(s, at)) and m.end() in pairs and hangul[m.end()] == hangul[pairs[m.end()]]:
        at = pairs[m.end()] + 1
    return at


def formulas(s: str) -> list[tuple[int, int]]:
    """Where formulas stand in a text: atoms joined by signs. Letters alone count up to a length; an opening bracket alone is none."""
    pairs, out, at = partners(s), [], 0
    hangul = [0]
    for c in s:
        hangul.append(hangul[-1] + ("가" <= c <= "힣"))
    while at < len(s):
        inside = at and s[at - 1].isascii() and s[at - 1].isalpha()
        end = at if inside else atom_end(s, at, pairs, hangul)
        if end == at:
            at += 1
            continue
        while m := BETWEEN.match(s, end):
            after = atom_end(s, m.end(), pairs, hangul)
            if after == m.end():
                break
            end = after
        if end < len(s) and s[end].isascii() and s[end].isalpha():
            at = end
            continue
        if not (end - at > WORD and not (SIGN | set("()")) & set(s[at:end])):
            out.append((at, end))
        at = end
    return out


def mixed(s: str) -> list[Span]:
    """Formulas among prose: with Hangul, bullets or scripts in it, line by line; other texts are prose. A sign before a formula that begins after a label, a bracket or Hangul is its own; numbers of parts in brackets are formulas."""
    if "\n" in s:
        return joined([x for k, line in enumerate(s.split("\n")) for x in ([text("\n")] if k else []) + mixed(line)])
    if m := PART.search(s):
        return joined([*mixed(s[: m.start()]), Span("equation", re.sub(r"\s+", "", m[0]), m[0]), *mixed(s[m.end() :])])
    if not (BULLET.search(s) or HANGUL.search(s) or re.search("[A-Za-z0-9][_^]", s)):
        return joined([text(s)])
    out, at = [], 0
    for lo, hi in formulas(s):
        before = s[at:lo]
        if m := re.search(r"[+\-](\s*)\Z", before):
            ahead = before[: m.start()].rstrip()
            if (ahead and re.search(r"[.•·:,;(\[{가-힣ㄱ-ㆎ]\Z", ahead)) or (not ahead and not (out and out[-1].type == "equation")):
                sign = m.start()
                out += [text(before[:sign]), Span("equation", before[sign] + s[lo:hi], before[sign:] + s[lo:hi])]
                at = hi
                continue
        out += [text(before), Span("equation", s[lo:hi].strip(), s[lo:hi])]
        at = hi
    return joined([*out, text(s[at:])])


# Formulas with commands


def lead(s: str, at: int) -> int:
    """Where the formula begins whose first command stands at a place: letters, numbers and scripts right before it, signs and what they join, and a bracket that is still open before it."""

    def letters(i: int) -> int:
        while i and (s[i - 1].isascii() and s[i - 1].isalnum() or s[i - 1] in "^_" and i > 1 and (s[i - 2].isalnum() or s[i - 2] in "})") or s[i - 1] == "{" and i > 1 and s[i - 2] in "^_" or s[i - 1] == "." and i > 1 and s[i - 2].isdigit() and s[i : i + 1].isdigit()):
            i -= 1
        return i

    at = letters(at)
    i = at
    while i and (s[i - 1] in LEADING or s[i - 1] in " \t"):
        i -= 1
    if set(s[i:at]) & LEADING:
        at = letters(i + len(s[i:at]) - len(s[i:at].lstrip()))
    closed = partners(s[:at])
    last = next((k for k in range(at - 1, -1, -1) if s[k] == "(" and k not in closed), None)
    if last is not None and not HANGUL.match(s, last + 1):
        at = letters(last)
    if m := LEFT_SCRIPT.search(s[:at]):
        at = m.start()
    return at


def ending(s: str, at: int) -> int:
    """Where a formula with commands ends: at Hangul outside groups, with a bracket that opens before it; at a bullet or a label in brackets; at two spaces."""
    depth = 0
    for i in range(at, len(s)):
        c = s[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth = max(0, depth - 1)
        elif not depth:
            if HANGUL.match(c):
                j = len(s[at:i].rstrip()) + at
                return j - 1 if j > at and s[j - 1] in "(（" else j
            if BULLET.match(c) or s[i : i + 2] == "  " and s[at:i].strip() and s[i:].strip() or c in "(（" and LABEL.match(s, i):
                return len(s[at:i].rstrip()) + at
    return len(s)


def commands(s: str) -> list[Span]:
    """Formulas with commands among prose, line by line; environments are whole. What stands between them is read as by `mixed`."""
    if m := ENVIRONMENT.search(s):
        start = lead(s[: m.start()], m.start()) if m.start() else 0
        return joined([*commands(s[:start]), *formula(s[start : m.end()]), *commands(s[m.end() :])])
    if "\n" in s:
        return joined([x for k, line in enumerate(s.split("\n")) for x in ([text("\n")] if k else []) + commands(line)])
    out, at = [], 0
    while m := COMMAND.search(s, at):
        start = at + lead(s[at:], m.start() - at)
        end = max(ending(s, start), m.end())
        out += [*mixed(s[at:start]), *formula(s[start:end])]
        at = end
    return joined([*out, *mixed(s[at:])])


def parted(s: str) -> list[Span]:
    """A text by underlines, then dollar signs, then commands and signs."""
    out = underlined(s)
    for by in (inline, commands):
        out = [x for a in out for x in (by(a.raw) if a.type == "text" else [a])]
    return joined(out)


SPLITTERS = {"inline": inline, "underline": underlined, "mixed": mixed, "commands": commands, "all": parted}
#: Texts whose spans are in Python at once.
FEW = 64
TYPE = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string()), ("raw", pa.string())]))


def split(x: Column, by: str = "all") -> Column:
    """The spans of a text, an array of (type, value, raw) whose raw parts joined are the text; a null counts as empty. In Arrow batches, a few texts at a time, of which each different one is split once."""

    @F.arrow_udf("array<struct<type:string,value:string,raw:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for k in range(0, len(texts), FEW):
                coded = texts.slice(k, FEW).fill_null("").dictionary_encode()
                spans = pa.array([[s._asdict() for s in SPLITTERS[by](t)] for t in coded.dictionary.to_pylist()], TYPE)
                yield spans.take(coded.indices)

    return run(x)


def comma_parts(x: Column) -> Column:
    """The parts of a text between commas outside all brackets."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else top_level_parts(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(x)
