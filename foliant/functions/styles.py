"""Upright and slanted letters in a question's equations, and scores printed in its texts.

What a capital is depends on the question: a point in geometry, a matrix, a quantity that a text names, a random
variable elsewhere. That is found out once for a question; then each equation is looked at by itself, but for names
that a noun before them announces.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import fragments as fr
from foliant.functions.boxes import MARK
from foliant.functions.text import SCORE
from foliant.sources.readers import BLOCK

#: Words of geometry; words that only look like them.
GEOMETRY = ["점", "꼭짓점", "교점", "원점", "중점", "무게중심", "삼각형", "사각형", "정사각형", "직사각형", "마름모", "평행사변형", "사다리꼴", "선분", "직선", "반직선", "호", "부채꼴", "반원", "지름", "반지름", "△", "∠", "∆", "올려본 각", "내려본 각"]
ELSEWHERE = ["점수", "관점", "장점", "단점", "요점", "배점", "채점", "만점", "평점", "득점", "감점", "지점", "기호", "괄호", "번호", "신호", "부호", "보호", "호선", "호출", "구호", "칭호", "호수"]
SEGMENT = re.compile(r"\\overline\s*\{\s*(?:\\math(?:rm|it)\s*\{\s*)?[A-Z]'*[A-Z]")
CIRCLE = re.compile(r"(?:원|중심)\s*(?:\\math(?:rm|it)\{)?[A-Z]'?(?![a-zA-Z])")
#: Names of points and figures, alone, in a row, before coordinates; runs of capitals; one number in brackets.
NAME = r"[A-Z]'*(?:_\{?[A-Za-z0-9+\-]+\}?)?'*"
CAPITALS = re.compile(r"([A-Z]{1,4})'*(?:_\{?[A-Za-z0-9]+\}?)?'*")
ROW = re.compile(rf"(?:{NAME}\s*){{2,}}")
PLACED = re.compile(rf"({NAME})\s*((?:\\left)?\(.*)", re.S)
NUMBER = re.compile(r"(?:\\left)?\(\s*[+\-]?\d+(?:\.\d+)?\s*(?:\\right)?\)")
FIGURE = re.compile(r"\\mathrm\s*\{\s*([A-Z]'?(?:_\{?[0-9a-z]+\}?)?)\s*\}|([A-Z]'?(?:_\{?[0-9a-z]+\}?)?)")
RUN = re.compile(r"(?<![A-Za-z\\])[A-Z]{2,4}(?![A-Za-z])")
#: What a text ends with before a figure's name, between such names, before a quantity's name, before a unit.
FIGURES = re.compile(r"(?:^|[\s(,·])(?:원|반원|곡선|포물선|타원|쌍곡선|구|평면|도형|각)\s*\Z")
AND = re.compile(r"\s*(?:,|와|과|및)\s*")
QUANTITY = re.compile(r"(?:넓이|겉넓이|부피|둘레의 길이|둘레|길이의 합|집합|합|거리)\s*[를을는은가이]\s*\Z")
UNIT = re.compile(r"단위[가는은를로이]*\s*\Z")
UNITS = {"g", "kg", "mg", "cm", "mm", "km", "m", "L", "mL", "dL", "kL", "min", "s", "h", "t", "℃"}
#: Upright letters that are variables where nothing is drawn; angles.
VARIABLES, SINGLES = re.compile(r"\\mathrm\{([XYPEVNZ])\}(?!\s*_)"), re.compile(r"\\mathrm\{([A-BD-Z])\}(?!\s*_)")
TRIGONOMETRIC = re.compile(r"(\\(?:cos|sin|tan|cot|sec|csc))\s*\\mathrm\s*\{\s*([A-Z])\s*\}")
DEGREES = re.compile(r"(?<!\\angle)(?<!\\angle )\\mathrm\s*\{\s*([A-Z])\s*\}(\s*=\s*\d+(?:\.\d+)?\s*(?:\^\s*\{?\s*\\circ|°))")
ANGLE = re.compile(r"(\\angle\s+)([A-Z])(?![A-Za-z])")
#: A score cut in two by an equation.
OPENED, CLOSED = re.compile(r"[\[(]\s*(?:총\s*)?\Z"), re.compile(r"\s*점\s*(?:,[^\])]*)?[\])]")
PRINTED = re.compile(SCORE)


class Setting(NamedTuple):
    """Whether a question is of geometry or of matrices, and names of quantities in it."""

    geometry: bool
    matrices: bool
    quantities: set[str]


def bare_name(x: str) -> str:
    return re.sub(r"[{}\s]", "", x)


def setting(blocks: list[dict], geometry: bool = False) -> Setting:
    said = " ".join(fr.value(b) for b in blocks)
    for word in ELSEWHERE:
        said = said.replace(word, "")
    drawn = geometry or any(k in said for k in GEOMETRY) or bool("\\overline" in said and SEGMENT.search(said) or CIRCLE.search(said))
    named = {bare_name(fr.value(b)) for a, b in zip(blocks, blocks[1:], strict=False) if b["type"] == "equation" and fr.is_text(a) and QUANTITY.search(fr.value(a)) and (m := CAPITALS.fullmatch(fr.value(b).strip())) and len(m[1]) == 1}
    return Setting(drawn, any("행렬" in fr.value(b) for b in blocks if fr.is_text(b)), named if drawn else set())


def upright(x: str) -> str:
    return f"\\mathrm{{{x}}}"


def point(v: str, at: Setting) -> str:
    """An equation that is a point's or figure's name, upright; its coordinates slanted."""
    if not v or "\\math" in v:
        return v
    if m := CAPITALS.fullmatch(v):
        return upright(v) if len(m[1]) > 1 or at.geometry and bare_name(v) not in at.quantities else v
    if at.geometry and ROW.fullmatch(v):
        return upright(v)
    if at.geometry and (m := PLACED.fullmatch(v)) and ("," in m[2] or NUMBER.fullmatch(m[2].strip())):
        return f"{upright(m[1])}\\mathit{{{m[2]}}}"
    return v


def points_upright(blocks: list[dict], at: Setting) -> list[dict]:
    """Names of points upright; of matrices, and of figures after their noun, slanted."""
    if at.matrices:
        return [b | {"value": RUN.sub(lambda m: f"\\mathit{{{m[0]}}}", fr.value(b))} if b["type"] == "equation" and b["value"] and "\\math" not in b["value"] else b for b in blocks]
    out, announced = [], False
    for b in blocks:
        v = fr.value(b)
        if fr.is_text(b):
            announced = bool(FIGURES.search(v)) or announced and bool(AND.fullmatch(v))
        elif b["type"] == "equation":
            if announced and (m := FIGURE.fullmatch(v.strip())):
                out.append(b | {"value": m[1] or m[2]} if (m[1] or m[2]) != v.strip() else b)
                continue
            announced = False
            styled = point(v.strip(), at)
            b = b | {"value": styled} if styled != v.strip() else b
        out.append(b)
    return out


def angles(v: str) -> str:
    """Slanted where an angle is an argument or has a size, upright where its sign is written."""
    if "\\" not in v:
        return v
    return ANGLE.sub(lambda m: m[1] + upright(m[2]), DEGREES.sub(r"\1\2", TRIGONOMETRIC.sub(r"\1 \2", v)))


def units_upright(blocks: list[dict]) -> list[dict]:
    """A unit that the last text before it announces."""
    out, said = [], ""
    for b in blocks:
        v = fr.value(b)
        bare = v.strip()
        if bare and fr.is_text(b):
            said = v.rstrip()
        out.append(b | {"value": upright(bare)} if bare in UNITS and fr.is_equation(b) and UNIT.search(said) else b)
    return out


def without_scores(blocks: list[dict]) -> list[dict]:
    """Texts before the first box without printed scores, cut in two by an equation or not; what is left blank goes."""
    end = next((k for k, b in enumerate(blocks) if fr.is_text(b) and MARK.match(fr.value(b))), len(blocks))
    out: list[dict] = []
    for b in blocks[:end]:
        if fr.is_text(b) and len(out) > 1 and fr.is_equation(out[-1]) and fr.is_text(out[-2]) and re.fullmatch(r"\d+(?:\.\d+)?", fr.value(out[-1]).strip()) and OPENED.search(fr.value(out[-2])) and CLOSED.match(fr.value(b)):
            out.pop()
            before = out.pop()
            out.append(before | {"value": OPENED.sub("", fr.value(before)).rstrip()})
            b = b | {"value": CLOSED.sub("", fr.value(b), count=1).lstrip()}
        out.append(b)
    plain = [b | {"value": PRINTED.sub("", fr.value(b))} if fr.is_text(b) and "점" in fr.value(b) else b for b in out]
    return [b for b in plain if not fr.is_text(b) or fr.value(b).strip()] + blocks[end:]


def styled(blocks: list[dict], geometry: bool = False) -> list[dict]:
    """All passes, in order. geometry: what the blocks belong to is of geometry, as choices are with their question."""
    blocks = without_scores(blocks)
    at = setting(blocks, geometry)
    each = lambda f, bs: [b | {"value": new} if fr.is_equation(b) and b["value"] and (new := f(b["value"])) != b["value"] else b for b in bs]
    if not at.geometry:
        blocks = each(lambda v: VARIABLES.sub(r"\1", v) if "\\mathrm{" in v else v, blocks)
    blocks = points_upright(blocks, at)
    if not at.geometry:
        blocks = each(lambda v: SINGLES.sub(r"\1", v) if "\\mathrm{" in v else v, blocks)
    return units_upright(each(angles, blocks))


def letters_styled(blocks: Column) -> Column:
    """An array of `sources.readers.BLOCK` without printed scores, its equations' letters upright or slanted; a null array stays, null entries go."""

    @F.arrow_udf(f"array<{BLOCK}>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if r is None else styled([b for b in r if b is not None]) for r in fr.received(x)], pa.list_(fr.TYPE))

    return run(F.to_json(blocks))
