"""Fragments of a question's blocks put together again: vision cuts an equation or an underlined phrase at odd places.

Each pass is a left fold: a block is added to those before it, of which the last is the open fragment; what it
completes merges into it, and may merge again with what follows. A chain of passes runs in Arrow batches, over the rows'
arrays of blocks; a null array stays, blocks that are neither text nor equation are left alone, and nothing is
ever dropped but blocks that became empty by giving their text away.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.splitting import has_relation, is_wrapped, top_level_parts
from foliant.sources.readers import BLOCK

Block = dict
Pass = Callable[[list[Block]], list[Block]]
Step = Callable[[list[Block], Block], None]

#: Signs that join two equations; relations, and what may stand beside one in a text; signs and their commands.
JOINING = set("=<>≤≥≠≈≡≅∼+-±×÷·∘*/^∓→↔⇒⇔")
RELATION = r"(?:=|<|>|≤|≥|≠|\\leq?(?![A-Za-z])|\\geq?(?![A-Za-z])|\\neq?(?![A-Za-z]))"
ATOM = r"[-+]?[0-9A-Za-z][0-9A-Za-z._^{}]*"
TAIL = re.compile(rf"(?<![가-힣A-Za-z0-9])((?:{ATOM}\s*)?{RELATION}\s*)\Z")
HEAD = re.compile(rf"\A\s*{RELATION}\s*{ATOM}(?![0-9A-Za-z])")
COMMANDS = {"≤": r" \leq ", "≥": r" \geq ", "≠": r" \neq "}
#: A call at a text's end, and what an equation that goes on with it begins with.
CALL = r"[A-Za-z](?:_\{?\w+\}?)?'*(?:\^\{?-?\d\}?)?\([^()가-힣ㄱ-ㆎ]*\)"
CALLS = re.compile(rf"(?:(?<=[\s,])|\A)((?:{CALL}\s*[-+]\s*)*{CALL})\s*\Z")
GOES_ON = re.compile(r"\s*(?:=|<|>|\+|-|\\(?:le|ge|ne|leq|geq|neq|lt|gt|times|cdot)(?![A-Za-z]))")
#: A list of values behind an equation, in brackets and set off; dots in a list; spacing commands at an end.
DOMAIN = re.compile(r"(?:\\quad|\\qquad|\\[,;:! ]|~|\s)+\(\s*(?P<body>[^()]*(?:,[^()]*)+)\)\s*\Z")
DOTS = re.compile(r"\\c?dots|\\ldots|\.\.\.|⋯")
EDGE = re.compile(r"\A(?:\\(?:qquad|quad|[,;:! ])\s*)+|(?:\\(?:qquad|quad|[,;:! ])\s*)+\Z")
#: Items of a list: a letter with a script; numbers, Greek letters, accents, sets, roots, dots; products and powers without commands.
LETTER = re.compile(r"[A-Za-z](?:[_^]\{?[A-Za-z0-9]+\}?)?")
SIMPLE = [
    r"[-+]?\d+(?:\.\d+)?", r"(?=.*\d)[0-9+\-.\si]+", r"\\[A-Za-z]+(?:[_^]\{?[A-Za-z0-9]+\}?)?", r"\\(?:overline|overarc|vec|hat|bar|widehat|dot|ddot|tilde)\{[A-Za-z0-9']+\}",
    r"\\\{.+\\\}", r"[-+]?\\sqrt(?:\[[^\]]*\])?\{[^{}]*\}", r"\\c?dots|\\ldots|⋯|\.\.\.", r"(?=.*[A-Za-z0-9])[A-Za-z0-9_^{}+\-*/.\s]+",
]
ITEM = re.compile("|".join(f"(?:{LETTER.pattern if p is None else p})" for p in [None, *SIMPLE]))
#: A particle after a formula inside a sentence; what ends one; how many signs a short formula has.
PARTICLE = re.compile(r"\s*(?:의|이|가|을|를|은|는|와|과|로|에|도)(?![a-zA-Z])")
ENDED = re.compile(r"[.?!。？]\s*\Z|(?:다|오|시오|것은|값은|때)\s*,?\s*\Z")
SHORT = 18
MARK = re.compile(r"(?<!_)__(?!_)")


def is_text(b: Block | None) -> bool:
    return b is not None and b["type"] == "text"


def is_equation(b: Block | None) -> bool:
    return b is not None and b["type"] in ("equation", "equation_block")


def value(b: Block) -> str:
    return b["value"] or ""


def block(kind: str, text: str, like: Block | None = None, **marks) -> Block:
    """A block of a kind; place and page as of another."""
    return BLANK | ({k: like[k] for k in ("bbox", "page", "box_member")} if like else {}) | {"type": kind, "value": text} | marks


def folded(step: Step) -> Pass:
    def run(blocks: list[Block]) -> list[Block]:
        out: list[Block] = []
        for b in blocks:
            step(out, b)
        return out

    return run


# Merging


def joined_by_signs(out: list[Block], b: Block) -> None:
    """An equation after signs alone after an equation goes on with it."""
    if b["type"] == "equation" and len(out) > 1 and out[-2]["type"] == "equation" and is_text(out[-1]):
        sign = re.sub(r"\s+", "", value(out[-1]))
        if sign and set(sign) <= JOINING:
            parts = [value(out[-2]).strip(), value(out.pop()).strip(), value(b).strip()]
            out[-1] = block("equation", " ".join(p for p in parts if p), out[-1])
            return
    out.append(b)


def with_commands(x: str) -> str:
    for sign, command in COMMANDS.items():
        x = x.replace(sign, command)
    return " ".join(x.split())


def joined_by_relations(out: list[Block], b: Block) -> None:
    """An unfinished relation at a text's end belongs to the equation after it, one that a text begins with to the equation before it."""
    last = out[-1] if out else None
    if b["type"] == "equation" and is_text(last) and (m := TAIL.search(value(last))):
        b = block("equation", with_commands(f"{m[1]} {value(b)}"), b)
        out[-1] = last | {"value": value(last)[: m.start(1)]}
        if not value(out[-1]).strip():
            out.pop()
    elif is_text(b) and last is not None and last["type"] == "equation" and (m := HEAD.match(value(b))):
        out[-1] = block("equation", with_commands(f"{value(last)} {m[0]}"), last)
        b = b | {"value": value(b)[m.end() :]}
    out.append(b)


def lead_calls(out: list[Block], b: Block) -> None:
    """A call f(x) at a text's end goes into the equation after it that goes on with a sign."""
    last = out[-1] if out else None
    if is_equation(b) and is_text(last) and not last["underline"] and GOES_ON.match(value(b)) and (m := CALLS.search(value(last))):
        b = b | {"value": m[1] + value(b)}
        out[-1] = last | {"value": value(last)[: m.start(1)]}
        if not value(out[-1]):
            out.pop()
    out.append(b)


def empty_groups(out: list[Block], b: Block) -> None:
    """An empty group at a text's end is the base of the script that the equation after it begins with."""
    last = out[-1] if out else None
    if is_equation(b) and is_text(last) and value(last).rstrip().endswith("{}") and value(b).lstrip()[:1] in ("_", "^"):
        b = b | {"value": "{}" + value(b)}
        out[-1] = last | {"value": value(last).rstrip()[:-2]}
        if not value(out[-1]).strip():
            out.pop()
    out.append(b)


def degrees(out: list[Block], b: Block) -> None:
    """An equation, a degree sign and C or F are a temperature."""
    if is_equation(b) and value(b).strip() in ("C", "F") and len(out) > 1 and is_text(out[-1]) and value(out[-1]).strip() == "°" and is_equation(out[-2]):
        out.pop()
        out[-1] = block("equation", value(out[-1]).rstrip() + r"°\mathrm{" + value(b).strip() + "}", out[-1])
        return
    out.append(b)


def ranges(out: list[Block], b: Block) -> None:
    """A range of values in brackets goes behind the equation before it, past blank texts."""
    v = value(b).strip()
    if b["type"] == "equation" and v.startswith("(") and v.endswith(")") and "=" in v and ("," in v or DOTS.search(v)):
        at = len(out) - 1
        if at >= 0 and is_text(out[at]) and not value(out[at]).strip():
            at -= 1
        if at >= 0 and is_equation(out[at]):
            out[at] = out[at] | {"value": f"{value(out[at]).rstrip()} ~ {v}"}
            del out[at + 1 :]
            return
    out.append(b)


def underlines_linked(blocks: list[Block]) -> list[Block]:
    """Texts between an opening mark and the closing one in a later text are underlined; a mark without its pair stays."""
    marks = sum(len(MARK.findall(value(b))) for b in blocks if is_text(b))
    out, left, inside = [], marks - marks % 2, False
    for b in blocks:
        if not is_text(b):
            out.append(b)
            continue
        text, at = value(b), 0
        pieces = []
        for m in MARK.finditer(text):
            if not left:
                break
            pieces.append((text[at : m.start()], inside))
            at, inside, left = m.end(), not inside, left - 1
        if not pieces:
            out.append(b | {"underline": True} if inside else b)
            continue
        out += [b | {"value": t} | ({"underline": True} if under else {}) for t, under in [*pieces, (text[at:], inside)] if t]
    return out


def short_displays_inline(blocks: list[Block]) -> list[Block]:
    """A short displayed list without a relation, between an unfinished text and a particle, stands in the line."""

    def inline(k: int, b: Block) -> bool:
        v = value(b)
        if b["type"] != "equation_block" or "," not in v or re.search(r"[=<>]|\\(?:leq|geq|neq|le|ge|ne)(?![a-zA-Z])", v) or len(re.sub(r"\\[a-zA-Z]+|[{}^_\s]", "", v)) > SHORT:
            return False
        before, after = blocks[k - 1] if k else None, blocks[k + 1] if k + 1 < len(blocks) else None
        return is_text(before) and bool(value(before).strip()) and not ENDED.search(value(before)) and is_text(after) and bool(PARTICLE.match(value(after)))

    return [b | {"type": "equation"} if inline(k, b) else b for k, b in enumerate(blocks)]


# Cutting lists


def listed(items: list[str], like: Block) -> list[Block]:
    """Equations with commas between them in the text."""
    return [x for k, item in enumerate(items) for x in ([block("text", ", ", like)] if k else []) + [block("equation", item, like)]]


def domains_cut(blocks: list[Block]) -> list[Block]:
    """A list of values in brackets, set off behind an equation, in equations of its own."""
    out: list[Block] = []
    for b in blocks:
        v = value(b).rstrip()
        m = DOMAIN.search(v) if b["type"] == "equation" else None
        items = [x for p in top_level_parts(m["body"]) if (x := re.sub(r"\A(?:\\[,;:!\s]|\\quad|~|\s)+", "", p).strip())] if m and (DOTS.search(m["body"]) or "=" in m["body"]) else []
        main = v[: m.start()].rstrip() if m else ""
        out += [block("equation", main, b), block("text", " (", b), *listed(items, b), block("text", ")", b)] if main and len(items) > 1 else [b]
    return out


def commas_cut(blocks: list[Block]) -> list[Block]:
    """Lists in one equation: letters, and items without brackets around all, each by itself; other lists in brackets keep together, with spaces that hold; a comma that parts no list goes."""
    out: list[Block] = []
    for b in blocks:
        v = value(b).strip()
        around = is_wrapped(v)
        parts = [x for p in top_level_parts(v[1:-1] if around else v) if (x := EDGE.sub("", p.strip()).strip())] if b["type"] == "equation" else []
        if len(parts) < 2:
            out.append(b)
        elif all(LETTER.fullmatch(p) for p in parts):
            out += [*([block("text", "(", b)] if around else []), *listed(parts, b), *([block("text", ")", b)] if around else [])]
        elif around:
            out.append(block("equation", re.sub(r",\s*", ",~", v), b))
        elif any(has_relation(p) for p in parts) and any(not has_relation(p) and not ITEM.fullmatch(re.sub(r"\A(?:\\[\s,;:])+\s*", "", p).strip()) for p in parts):
            out.append(block("equation", " ".join(parts), b))
        else:
            out += listed(parts, b)
    return out


#: All passes, in order.
PASSES: dict[str, Pass] = {
    "underlines": underlines_linked, "displays": short_displays_inline, "domains": domains_cut, "commas": commas_cut, "signs": folded(joined_by_signs), "relations": folded(joined_by_relations),
    "calls": folded(lead_calls), "groups": folded(empty_groups), "degrees": folded(degrees), "ranges": folded(ranges),
}

TYPE = pa.struct([
    ("type", pa.string()), ("value", pa.string()), ("rows", pa.list_(pa.list_(pa.string()))), ("bbox", pa.list_(pa.float64())), ("page", pa.int32()), ("bold", pa.bool_()), ("underline", pa.bool_()), ("box_member", pa.bool_()),
])
FIELDS = [TYPE.field(k).name for k in range(TYPE.num_fields)]
BLANK = dict.fromkeys(FIELDS)


def whole(b: dict | None) -> Block | None:
    """A block as read from JSON, which leaves out what is null and writes numbers that are none as texts."""
    if b is None:
        return None
    b = BLANK | b
    if b["bbox"]:
        b["bbox"] = [None if v is None else float(v) for v in b["bbox"]]
    return b


def received(x: pa.Array) -> list[list[Block | None] | None]:
    """Arrays of blocks as `F.to_json` sends them: Spark writes a text in a fraction of the time that it takes to fill eight columns, some nested, for each block."""
    return [None if r is None else [whole(b) for b in json.loads(r)] for r in x.to_numpy(zero_copy_only=False)]


def merged(blocks: list[Block], *names: str) -> list[Block]:
    """What passes make of blocks, all of them where none is named."""
    for name in names or PASSES:
        blocks = PASSES[name](blocks)
    return blocks


def fragments_merged(blocks: Column, *names: str) -> Column:
    """An array of `sources.readers.BLOCK` after the passes named, in that order; all without a name. Null entries go."""

    @F.arrow_udf(f"array<{BLOCK}>")
    def run(x: pa.Array) -> pa.Array:
        rows = (None if r is None else merged([b for b in r if b is not None], *names) for r in received(x))
        return pa.array(rows, pa.list_(TYPE))

    return run(F.to_json(blocks))
