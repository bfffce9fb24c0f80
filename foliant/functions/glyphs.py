"""Equations read from where their glyphs stand: fraction bars divide them, sizes and lines make scripts.

A run's glyphs are divided by their widest bar that has glyphs above and below: numerator, denominator, what stands
left and right of it; each part is divided further, and so on, to any depth. In a part without bars small glyphs off
the middle line are scripts, which are parts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import median

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.formulas import worked_out

GLYPH = "struct<c:string,x0:double,x1:double,y0:double,y1:double,size:double>"
#: The glyph of a fraction bar; how much smaller a script is than its line, and how far off its middle; how far a glyph may stand out beyond a bar.
BAR = chr(0xE06D)
SMALLER, OFF, OVER = 0.86, 0.12, 0.5
ESCAPED = {"{": r"\{", "}": r"\}"}
#: In Python a glyph is its sign, x0, x1, the middle of y0 and y1, and its size: a dictionary each costs more than all the reading.
Glyph = tuple[str, float, float, float, float]


def glyph(c: str, x0: float, x1: float, y0: float, y1: float, size: float) -> Glyph:
    return c, x0, x1, (y0 + y1) / 2, size


def divided(run: list[Glyph]) -> tuple[list[Glyph], list[Glyph], list[Glyph], list[Glyph]] | None:
    """Left, above, below and right of the widest bar that has both above and below. A bar's box is as high as a glyph; its line is in the middle."""
    for bar in sorted((g for g in run if g[0] == BAR), key=lambda g: g[1] - g[2]):
        lo, hi, line, parts = bar[1] - OVER, bar[2] + OVER, bar[3], ([], [], [], [])
        for g in run:
            if g is bar:
                continue
            _, x0, x1, middle, _ = g
            if lo <= x0 <= hi or lo <= x1 <= hi:
                parts[1 if middle < line else 2].append(g)
            else:
                parts[0 if x0 + x1 < lo + hi else 3].append(g)
        if parts[1] and parts[2]:
            return parts
    return None


def lines(run: list[Glyph]) -> list[tuple[str, list[Glyph]]]:
    """The run's glyphs without bars in stretches of the line itself, of superscripts and of subscripts."""
    body = [g for g in run if g[0] != BAR]
    out: list[tuple[str, list[Glyph]]] = []
    if body:
        sizes = [g[4] for g in body]
        if min(sizes) >= max(sizes) * SMALLER:  # none can be smaller than the median
            return [("", body)]
        size, line = median(sizes), median(g[3] for g in body)
        for g in body:
            off = (g[3] - line) / size if size and g[4] < size * SMALLER else 0
            mode = "^" if off < -OFF else "_" if off > OFF else ""
            if not out or out[-1][0] != mode:
                out.append((mode, []))
            out[-1][1].append(g)
    return out


def text(run: list[Glyph]) -> str:
    return "".join([ESCAPED.get(g[0], g[0]) for g in run])


def program(run: list[Glyph]) -> list:
    """The steps that spell a run: texts, and how many of them make a row, a fraction or a script."""
    steps: list = []
    todo: list = [run]
    while todo:  # a part is a list of glyphs; other entries are steps that wait for the parts before them
        part = todo.pop()
        if not isinstance(part, list):
            steps.append(part)
        elif got := divided(part):
            todo += [("row", 3), got[3], ("frac", 2), got[2], got[1], got[0]]
        else:
            stretches = lines(part)
            todo.append(("row", len(stretches)))
            for mode, glyphs in reversed(stretches):
                if not mode:
                    todo.append(text(glyphs))
                else:
                    todo += [(mode, 1), glyphs if len(glyphs) < sum(g[0] != BAR for g in part) else text(glyphs)]
    return steps


def spelled(name: str, args: list[str]) -> str:
    if name == "row":
        return "".join(args)
    return f"\\frac{{{args[0].strip()}}}{{{args[1].strip()}}}" if name == "frac" else f"{name}{{{args[0].strip()}}}"


def read(run: list[Glyph]) -> str:
    return worked_out(program(run), spelled).strip() if run else ""


def equation_of(run: list[dict]) -> str:
    """The LaTeX of glyphs given as dictionaries of c, x0, x1, y0, y1, size."""
    return read([glyph(**g) for g in run])


def runs(x: pa.ListArray) -> Iterator[list[Glyph]]:
    """The glyphs of each list, without those that lack something; made from whole columns at once."""
    flat = x.flatten()
    c, *places = flat.flatten()
    whole = reduce(pc.and_, [f.is_valid() for f in (c, *places)]).to_numpy(zero_copy_only=False)
    x0, x1, y0, y1, size = (f.to_numpy(zero_copy_only=False) for f in places)
    all_of = list(zip(c.to_pylist(), x0.tolist(), x1.tolist(), ((y0 + y1) / 2).tolist(), size.tolist(), strict=True))
    keep, at = None if whole.all() else whole.tolist(), 0
    for n in pc.fill_null(pc.list_value_length(x), 0).to_pylist():
        yield all_of[at : at + n] if keep is None else [g for g, k in zip(all_of[at : at + n], keep[at : at + n], strict=True) if k]
        at += n


def equation(glyphs: Column) -> Column:
    """The LaTeX of an array of glyphs (c, x0, x1, y0, y1, size) in reading order; y grows downward. A null array is empty; glyphs without a place or size go."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(map(read, runs(x)), pa.string())

    return run(glyphs.cast(f"array<{GLYPH}>"))


def equations(glyphs: DataFrame, run: str, order: str) -> DataFrame:
    """run, latex of each run of glyph rows (run, order, c, x0, x1, y0, y1, size)."""
    parts = ["c", "x0", "x1", "y0", "y1", "size"]
    rows = glyphs.groupBy(run).agg(F.sort_array(F.collect_list(F.struct(order, *parts))).alias("g"))
    return rows.select(run, equation(F.transform("g", lambda g: F.struct(*[g[c].alias(c) for c in parts]))).alias("latex"))
