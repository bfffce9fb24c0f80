"""How wide labels are, and how wide and high equations: worked out over their tokens and programs, to any depth."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.equations import FromScript
from foliant.functions.formulas import LATEX, worked_out

#: Signs that commands of labels stand for; spaces; groups that change no width.
SIGNS = {
    "angle": "∠", "times": "×", "div": "÷", "pm": "±", "mp": "∓", "cdot": "·", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "neq": "≠", "ne": "≠", "parallel": "∥", "perp": "⊥", "triangle": "△", "square": "□", "circ": "°", "prime": "′", "sim": "∽",
    "cong": "≅", "sqrt": "√", "infty": "∞", "cdots": "⋯", "ldots": "…", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "theta": "θ", "pi": "π", "phi": "φ", "omega": "ω", "lambda": "λ", "mu": "μ",
}
SPACES = {",": " ", ";": " ", " ": " "}
GROUPS = {"overline", "mathrm", "mathbf", "text", "operatorname"}
#: Signs with thin spaces on both sides; parts of the size that scripts and degree signs have.
BINARY, THIN = set("+=<>±∓×÷≤≥≠∽≅"), " "
SCRIPT, DEGREE = 0.72, 0.63
#: Widths of a label's characters in em; of others 0.5, beyond Latin 1.
LABEL = {
    **dict.fromkeys("0123456789", 0.500), **dict.fromkeys("+=<>±∓×÷−", 0.564), **dict.fromkeys("≤≥≠√∽≅∼", 0.549), **dict.fromkeys("()[]-′", 0.333), **dict.fromkeys("{}", 0.480), **dict.fromkeys(".,· ", 0.250), **dict.fromkeys(":;/", 0.278),
    "|": 0.200, "°": 0.400, "∠": 0.768, "△": 0.750, "□": 0.750, "∥": 0.500, "⊥": 0.658, "∞": 0.750, " ": 0.170,
    "A": 0.722, "B": 0.667, "C": 0.667, "D": 0.722, "E": 0.611, "F": 0.556, "G": 0.722, "H": 0.722, "I": 0.333, "J": 0.389, "K": 0.722, "L": 0.611, "M": 0.889, "N": 0.722, "O": 0.722, "P": 0.556, "Q": 0.722, "R": 0.667, "S": 0.556, "T": 0.611,
    "U": 0.722, "V": 0.722, "W": 0.944, "X": 0.722, "Y": 0.722, "Z": 0.611,
    "a": 0.444, "b": 0.500, "c": 0.444, "d": 0.500, "e": 0.444, "f": 0.333, "g": 0.500, "h": 0.500, "i": 0.278, "j": 0.278, "k": 0.500, "l": 0.278, "m": 0.778, "n": 0.500, "o": 0.500, "p": 0.500, "q": 0.500, "r": 0.333, "s": 0.389, "t": 0.278,
    "u": 0.500, "v": 0.500, "w": 0.722, "x": 0.500, "y": 0.500, "z": 0.444,
    "α": 0.631, "β": 0.549, "γ": 0.411, "δ": 0.494, "θ": 0.521, "π": 0.549, "φ": 0.603, "ω": 0.686, "λ": 0.549, "μ": 0.576,
}
#: Widths of an equation's characters, in thousandths of its size, of Hangul and of words; other words 1000.
GLYPHS = {
    **dict.fromkeys("0123456789", 583),
    "a": 500, "b": 541, "c": 500, "d": 541, "e": 541, "f": 375, "g": 541, "h": 541, "i": 291, "j": 291, "k": 541, "l": 291, "m": 833, "n": 541, "o": 541, "p": 541, "q": 541, "r": 416, "s": 500, "t": 375, "u": 541, "v": 541, "w": 791, "x": 583, "y": 583, "z": 458,
    "A": 750, "B": 666, "C": 666, "D": 708, "E": 666, "F": 625, "G": 708, "H": 750, "I": 375, "J": 458, "K": 750, "L": 625, "M": 916, "N": 750, "O": 708, "P": 625, "Q": 708, "R": 666, "S": 625, "T": 750, "U": 750, "V": 708, "W": 958, "X": 666, "Y": 666, "Z": 625,
    **dict.fromkeys("+-=<>#", 833), **dict.fromkeys("()[]*?", 500), "|": 583, **dict.fromkeys("/;:", 333), **dict.fromkeys(".,", 291), "!": 416, "~": 791,
}
HANGUL = 650
WORDS = {
    "alpha": 500, "beta": 554, "gamma": 444, "delta": 554, "epsilon": 444, "varepsilon": 444, "zeta": 304, "eta": 500, "theta": 554, "vartheta": 500, "iota": 276, "kappa": 526, "lambda": 276, "mu": 833, "nu": 554, "xi": 500, "pi": 554, "rho": 526,
    "sigma": 390, "tau": 394, "upsilon": 388, "phi": 554, "varphi": 500, "chi": 526, "psi": 721, "omega": 526, "times": 811, "div": 811, "pm": 811, "mp": 811, "partial": 541, "prime": 276, "parallel": 500,
}
#: Words that make an equation two lines high; what fractions, scripts, fences and spaces around characters do to a width; the fit to measured equations; heights.
TALL = {"\\sum", "\\prod", "\\int", "\\iint", "\\iiint", "\\oint", "\\bigcup", "\\bigcap"}
FRACTION, BESIDE, SMALL, FENCE, PAD = 0.75, 400, 0.5, 1800, 100
SCALE, BIAS, LEAST = 0.8076, 394, 400
LINE, TWO_LINES = 1200, 2400


def em(c: str) -> float:
    return LABEL.get(c, 1.0 if ord(c) > 0x2FF else 0.5)


def label_width(label: str) -> float | None:
    """The width of a label in em; None where it holds what a label cannot: unknown commands, brackets or dollar signs without their pair."""
    if label.count("$") % 2:
        return None
    total, scripts, pending, command, first = 0.0, [], False, False, True
    for token in LATEX.findall(label.strip().replace("$", "")):
        after_command, command = command, False
        small = bool(scripts and scripts[-1])
        if token in "^_":
            pending = True
            continue
        if token == "{":
            scripts.append(small or pending)
            pending = False
            continue
        if token == "}":
            if not scripts:
                return None
            scripts.pop()
            continue
        if token.isspace():
            if not after_command:
                total += em(" ") * (SCRIPT if small else 1)
                first = False
            command = after_command
            continue
        if token[0] == "\\" and token[1:].isalpha():
            command = True
            if token[1:] in GROUPS:
                continue
            if token[1:] not in SIGNS:
                return None
            token = SIGNS[token[1:]]
        elif token[0] == "\\":
            if token[1:] not in SPACES:
                return None
            total += em(SPACES[token[1:]]) * (SCRIPT if small else 1)
            first = False
            continue
        small |= pending
        if token == "°":
            total += em(token) * DEGREE
        elif small:
            total += em(token) * SCRIPT
        elif token == "-":
            total += em("−") + (0 if first else 2 * em(THIN))
        else:
            total += em(token) + (2 * em(THIN) if token in BINARY else 0)
        pending = first = False
    return None if scripts else total


def of_leaf(text: str) -> tuple[float, bool]:
    """Width, and whether two lines high, of a leaf of a script's program, which is LaTeX."""
    t = text.strip()
    if t.startswith("\\text{"):
        t = t[6:-1]
    elif t.startswith(("\\mathrm{", "\\mathit{", "\\mathbf{")):
        t = t[8:-1]
    elif t in ("\\{", "\\}"):
        t = "("
    elif t in ("\\,", "\\\\") or t.startswith(("\\left", "\\right")):
        return (FENCE if t.startswith(("\\left", "\\right")) else 0.0), False
    elif t.startswith("\\"):
        return float(WORDS.get(t[1:], 1000)), t in TALL
    width = lambda c: GLYPHS.get(c, HANGUL if "가" <= c <= "힣" or "一" <= c <= "鿿" else 0)
    return float(sum(width(c) + PAD for c in t if width(c))), False


def of_parts(name: str, args: list) -> tuple[float, bool]:
    width, tall = sum(a[0] for a in args), any(a[1] for a in args)
    if name in ("frac", "binom", "atop"):
        return max(a[0] for a in args) * FRACTION + BESIDE + (2 * (FENCE + GLYPHS["("] + PAD) if name == "binom" else 0), True
    if name in ("^", "_"):
        return args[0][0] + args[1][0] * SMALL, tall
    if name in ("sqrt", "root"):
        return width, True
    if name.startswith("env "):
        return width, True
    if "\x00" in name:
        signs = [s.removeprefix(p).replace("\\{", "(").replace("\\}", ")") for s, p in zip(name.split("\x00"), ("\\left", "\\right"), strict=True)]
        return width + 2 * FENCE + sum(of_leaf(s)[0] for s in signs if s != "."), tall
    return width, tall


def equation_size(script: str) -> tuple[int, int]:
    """The width and height of an equation script, in units of a word processor (100 a point)."""
    width, tall = worked_out(FromScript().read(script), of_parts, of_leaf)
    return max(int(SCALE * width + BIAS), LEAST), TWO_LINES if tall else LINE


def label_widths(label: Column) -> Column:
    """The width in em of each label; null for a null, and for what is no label."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        coded = x.dictionary_encode()
        return pa.array([label_width(v) for v in coded.dictionary.to_pylist()], pa.float64()).take(coded.indices)

    return run(label)


def equation_sizes(script: Column) -> Column:
    """(width, height) of each equation script; a null as the empty one."""

    @F.arrow_udf("struct<width:int,height:int>")
    def run(x: pa.Array) -> pa.Array:
        coded = x.fill_null("").dictionary_encode()
        sizes = [dict(zip(("width", "height"), equation_size(v), strict=True)) for v in coded.dictionary.to_pylist()]
        return pa.array(sizes, pa.struct([("width", pa.int32()), ("height", pa.int32())])).take(coded.indices)

    return run(script)
