"""Equations between LaTeX and a word processor's script: fractions, roots, scripts, accents, fences, binomials, matrices, symbols.

Of several spellings one is made first; the conversions read an equation's tokens with a stack (`formulas`), to any
depth, in Arrow batches, once for equations that differ only in digits (`shapes`). What is not covered passes through,
and `leaks` finds equations of which something was left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.formulas import LATEX, SCRIPT, Program, after_space, raw_group, worked_out
from foliant.functions.shapes import each_shape
from foliant.functions.text import let, stripped, text_of

#: Letters that go by the same name in both, and commands with the script's words for them.
GREEK = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Chi Psi Omega"
).split()
FUNCTIONS = "sin cos tan sec csc cot arcsin arccos arctan sinh cosh tanh log ln lg exp max min det gcd lcm lim".split()
SYMBOLS = {
    "times": "TIMES", "div": "DIV", "cdot": "CDOT", "pm": "+-", "mp": "-+", "leq": "LEQ", "geq": "GEQ", "neq": "!=", "infty": "INF", "cup": "CUP", "cap": "CAP", "in": "IN", "notin": "NOTIN", "subset": "SUBSET", "supset": "SUPSET",
    "subseteq": "SUBSETEQ", "emptyset": "EMPTYSET", "sum": "SUM", "prod": "PROD", "int": "INT", "iint": "DINT", "iiint": "TINT", "oint": "OINT", "angle": "ANGLE", "triangle": "TRIANGLE", "rightarrow": "->", "to": "->", "leftarrow": "LARROW",
    "Rightarrow": "RARROW", "Leftrightarrow": "LRARROW", "therefore": "THEREFORE", "because": "BECAUSE", "perp": "BOT", "parallel": "PARALLEL", "equiv": "EQUIV", "approx": "APPROX", "propto": "PROPTO", "forall": "FORALL", "exists": "EXIST",
    "partial": "PARTIAL", "nabla": "NABLA", "cdots": "CDOTS", "ldots": "LDOTS", "vdots": "VDOTS", "ddots": "DDOTS", "wedge": "WEDGE", "vee": "VEE", "star": "STAR", "prime": "prime",
}
ACCENTS = {"vec": "VEC", "overrightarrow": "VEC", "bar": "BAR", "overline": "bar", "hat": "HAT", "tilde": "TILDE", "widetilde": "TILDE", "dot": "dot", "ddot": "DDOT", "overarc": "arch", "widehat": "arch", "underline": "underline"}
ENVIRONMENTS = {"cases": "CASES", "pmatrix": "PMATRIX", "bmatrix": "BMATRIX", "vmatrix": "DMATRIX", "matrix": "MATRIX"}
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni")
UNITS = "kcal min km cm mm kg mg mL dL kL g ℃ ℉ ℓ".split()
#: Circled numbers, consonants and syllables, each with its first circled sign.
CIRCLED = [([str(i) for i in range(1, 21)], 0x2460), (list("ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"), 0x3260), (list("가나다라마바사아자차카타파하"), 0x326E)]
#: Rows of a folded equation at most, and the length below which a part joins the row before.
ROWS, SHORTEST = 4, 3


#: What has several spellings, with the one that is read, in this order. The last takes circled marks.
SPELLINGS = [
    (re.compile(pattern, re.A), to)
    for pattern, to in (
        (r"\\lt(?![a-zA-Z])", "<"), (r"\\gt(?![a-zA-Z])", ">"), (r"\\not\s*\\in(?![a-zA-Z])", r"\\notin"), (r"\\not\s*=", r"\\neq"), (r"\\(?:no)?limits(?![a-zA-Z])", ""), (r"\\[dtc]frac(?![a-zA-Z])", r"\\frac"),
        (r"\\leq?(?![a-zA-Z])", r"\\leq"), (r"\\geq?(?![a-zA-Z])", r"\\geq"), (r"\\ne(?![a-zA-Z])", r"\\neq"), (r"\\text\s*\{\s*(" + "|".join(UNITS) + r")\s*\}", r"\1"), (r"\^\s*\{?\s*(?:\\circ|°)\s*\}?", "°"),
        (r"\\textcircled\s*\{\s*([^}]+?)\s*\}", lambda m: CIRCLES.get(m[1], m[1])),
    )
]
CIRCLES = {n: chr(first + i) for names, first in CIRCLED for i, n in enumerate(names)}
RAISED, LOWERED = re.compile(f"[{SUPERSCRIPTS[0]}]+"), str.maketrans(*SUPERSCRIPTS)


def prepared(latex: str) -> str:
    """LaTeX with one spelling for what has several: superscript signs, comparison signs, negations, circled marks, units in text."""
    s = RAISED.sub(r"^{\g<0>}", latex).translate(LOWERED)
    for sign, command in (("≤", r" \leq "), ("≥", r" \geq "), ("≠", r" \neq ")):
        s = s.replace(sign, command)
    for pattern, to in SPELLINGS:
        s = pattern.sub(to, s)
    return s


#: Commands whose content is as tall as two lines: brackets around them grow.
TALL = {"\\frac", "\\sqrt", "\\binom", "\\sum", "\\prod", "\\int", "\\iint", "\\iiint", "\\oint", "\\bigcup", "\\bigcap", "\\bigoplus", "\\bigotimes"}
#: Letters of probability, mean and variance: upright before brackets that hold a capital.
STATISTICS = set("PEV")
#: Arrows over vectors, and the sign of their product.
VECTORS, PRODUCT = {"\\vec", "\\overrightarrow"}, "⦁"
#: Commands of a style, with the script's word, and of spaces.
STYLES = {"\\mathrm": "rm", "\\mathit": "it", "\\mathbf": "bold"}
SPACES = {"\\,": "`", "\\ ": "`", "\\;": "~", "\\:": "~", "\\!": "", "\\quad": "~~", "\\qquad": "~~~~"}
TO_WORDS = {f"\\{c}": w for c, w in {**SYMBOLS, **{x: x for x in GREEK + FUNCTIONS}}.items()}
TO_COMMANDS = {w: f"\\{c}" for c, w in reversed(SYMBOLS.items())} | {x: f"\\{x}" for x in GREEK + FUNCTIONS}
FROM_ACCENTS = {w: f"\\{c}" for c, w in reversed(ACCENTS.items())}
FROM_ENVIRONMENTS = {w: c for c, w in ENVIRONMENTS.items()}
FROM_STYLES = {w: c for c, w in STYLES.items()}


def begins_with_vector(tokens: list[str], at: int) -> bool:
    """What follows a place is a vector, or brackets that hold one."""
    at = after_space(tokens, at)
    if tokens[at : at + 1] == ["\\left"]:
        at = after_space(tokens, at + 1)
    if tokens[at : at + 1] != ["("]:
        return bool(VECTORS & set(tokens[at : at + 1]))
    depth, i = 0, at
    while i < len(tokens):
        depth += (tokens[i] == "(") - (tokens[i] == ")")
        if tokens[i] in VECTORS or not depth:
            return depth > 0
        i += 1
    return False


def products_of_vectors(tokens: list[str]) -> list[str]:
    """LaTeX tokens with the sign of a product of vectors for the dots beside a vector, or beside brackets that hold one."""
    if "\\cdot" not in tokens:
        return tokens
    out, open_, last, ended = [], [], "", False  # ended: a vector, or brackets with one, end right before
    for i, t in enumerate(tokens):
        if t == "\\cdot" and (ended or begins_with_vector(tokens, i + 1)):
            t = PRODUCT
        if t in "({":
            open_.append((t, last in VECTORS))
        elif t in VECTORS:
            open_ = [(c, held or c == "(") for c, held in open_]
        if t in ")}" and open_ and open_[-1][0] == {")": "(", "}": "{"}[t]:
            ended = open_.pop()[1]
        elif not t.isspace():
            ended = last in VECTORS and t != "{"
        if not t.isspace():
            last = t
        out.append(t)
    return out


def reviewed(tokens: list[str]) -> list[str]:
    """LaTeX tokens with complements in capitals (after a single capital, or brackets that hold capitals and neither small letters nor digits), brackets around tall content growing, and letters of probability marked (\x00) before brackets that hold a capital. Brackets are matched once, with running counts."""
    out, open_, marks = [], {"(": [], "{": []}, {}
    capitals = small = tall = 0
    closed: tuple[int, int] | None = None  # what the bracket that has just ended holds
    last = before = ""  # the last tokens that are neither space nor prime
    skip = 0
    for i, t in enumerate(tokens):
        if skip:
            skip -= 1
            continue
        if t == "^":
            j = after_space(tokens, i + 1)
            c, after = raw_group(tokens[: j + 8], j) if tokens[j : j + 1] == ["{"] else ("".join(tokens[j : j + 1]), j + 1)
            if c.strip() == "c":
                holds = closed if last in (")", "}") else None
                fits = holds[0] > 0 and not holds[1] if holds else len(last) == 1 and "A" <= last <= "Z" and not before.isalpha()
                out += ["^", "{", "C" if fits else "c", "}"]
                small += not fits
                skip = after - i - 1
                closed, before, last = None, last, "^"
                continue
        if t in "({":
            kind = t
            open_[kind].append((len(out), capitals, small, tall, last == "\\left", (at := len(out) - 1 - next((k for k, x in enumerate(reversed(out)) if not x.isspace() and x != "\\left"), len(out))) if kind == "(" else -1))
        if t in ")}" and open_["(" if t == ")" else "{"]:
            start, c, m, h, grown, at = open_["(" if t == ")" else "{"].pop()
            closed = (capitals - c, small - m)
            if t == ")":
                if at >= 0 and out[at] in STATISTICS and capitals > c and not (at and (out[at - 1].isalpha() or out[at - 1] == "{" and at > 1 and out[at - 2] in STYLES)):
                    marks[at] = "\x00" + out[at]
                if tall > h and not grown and last != "\\right":
                    marks[start], marks[len(out)] = "\\left(", "\\right)"
        capitals += len(t) == 1 and "A" <= t <= "Z"
        small += len(t) == 1 and ("a" <= t <= "z" or t.isdigit())
        tall += t in TALL
        if not t.isspace() and t != "'":
            before, last = last, t
        out.append(t)
    return [marks.get(i, t) for i, t in enumerate(out)]


class FromLatex(Program):
    def read(self, latex: str) -> list:
        tokens = [x for t in products_of_vectors(reviewed(LATEX.findall(latex))) for x in ([t[:-1], t[-1]] if t in ("\\left(", "\\right)") else [t])]
        i = 0
        while i < len(tokens):
            t, i = tokens[i], i + 1
            if t.isspace():
                self.space = True
            elif t == "{":
                self.row("group", "}")
            elif t == "}" or t == "]":
                if not self.end(t) and t == "]":
                    self.leaf(t)
            elif t in "^_":
                self.script(t)
            elif t == "\\frac":
                self.begin("frac", 2)
            elif t == "\\binom":
                self.begin("binom", 2)
            elif t == "\\sqrt":
                if tokens[(j := after_space(tokens, i)) : j + 1] == ["["]:
                    self.begin("root", 2)
                    self.row("group", "]")
                    i = j + 1
                else:
                    self.begin("sqrt", 1)
            elif t[:1] == "\\" and t[1:] in ACCENTS:
                self.begin(ACCENTS[t[1:]], 1)
            elif t in STYLES:
                self.begin(STYLES[t], 1)
            elif t == "\\text":
                text, i = raw_group(tokens, after_space(tokens, i))
                self.leaf(f" rm {{{text}}}" if text.isascii() and text.isalpha() and text.isupper() else f'"{text}"')
            elif t in ("\\left", "\\right"):
                sign = "".join(tokens[(j := after_space(tokens, i)) : j + 1]).removeprefix("\\") or "."
                i = j + 1
                self.leaf(f" {t[1:].upper()} {sign} ")
            elif t in ("\\begin", "\\end"):
                name, i = raw_group(tokens, after_space(tokens, i))
                if t == "\\end":
                    self.end(f"end {name}") or self.leaf(f"\\end{{{name}}}")
                elif name in ENVIRONMENTS or name == "array":
                    if name == "array" and tokens[(j := after_space(tokens, i)) : j + 1] == ["{"]:
                        _, i = raw_group(tokens, j)
                    self.row(ENVIRONMENTS.get(name, "MATRIX"), f"end {name}")
                else:
                    self.leaf(f"\\begin{{{name}}}")
            elif t == "\\\\":
                self.leaf(" # ")
            elif t in ("\\{", "\\}"):
                self.leaf(f'"{t[1]}"')
            elif t[0] == "\x00":
                self.leaf(f" rm {t[1]} it ")
            elif t == PRODUCT:
                self.leaf(f" {PRODUCT} ")
            elif t in SPACES:
                self.leaf(SPACES[t])
            elif t in TO_WORDS:
                self.leaf(f" {TO_WORDS[t]} ")
            else:
                self.leaf(t.removeprefix("\\") if t[0] == "\\" and not t[1:].isalpha() else t)
        return self.done()


def script_part(name: str, args: list[str]) -> str:
    if name == "row":
        return "".join(args)
    if name == "group":
        return f"{{{args[0]}}}"
    a, b = (args[0].strip(), args[-1].strip())
    if name in "^_":
        base = args[0].rstrip()
        return f"{base}{' ' if base[-1:].isalpha() and args[0][-1:] == ' ' else ''}{name}{{{b}}}"
    if name == "frac":
        return f"{{{a}}} over {{{b}}}"
    if name == "binom":
        return f" LEFT ( {{{a}}} atop {{{b}}} RIGHT ) "
    if name == "root":
        return f" root {{{a}}} of {{{b}}}"
    return f" {name} {{ {a} }}" if name in FROM_ENVIRONMENTS else f" {name} {{{a}}}"


class FromScript(Program):
    def read(self, script: str) -> list:
        tokens = SCRIPT.findall(script)
        i = 0
        while i < len(tokens):
            t, i = tokens[i], i + 1
            low = t.lower()
            ahead = "".join(tokens[(j := after_space(tokens, i)) : j + 1])
            if t.isspace():
                self.space = True
            elif t == "{":
                self.row("group", "}")
            elif t == "}":
                self.end("}")
            elif t in "^_":
                self.script(t)
            elif low in ("over", "atop"):
                self.infix("frac" if low == "over" else "atop")
            elif low == "sqrt":
                self.begin("sqrt", 1)
            elif low == "root":
                self.begin("root", 2)
            elif low == "of" and self.frames[-1].name == "root":
                self.space = False
            elif t in FROM_ACCENTS or low in FROM_ACCENTS and low not in ("dot",):
                self.begin(FROM_ACCENTS.get(t) or FROM_ACCENTS[low], 1)
            elif low in FROM_STYLES:
                if ahead == "{" or ahead[:1].isalnum():
                    self.begin(FROM_STYLES[low], 1)
            elif t.upper() in FROM_ENVIRONMENTS or low in ("pile", "eqalign"):
                self.begin(f"env {FROM_ENVIRONMENTS.get(t.upper(), 'cases')}", 1)
            elif low == "left":
                i = j + 1
                self.row(f"fence {ahead}", "RIGHT")
            elif low == "right":
                i = j + 1
                self.right = "\\right" + ("\\" + ahead if ahead in ("{", "}") else ahead or ".")
                self.end("RIGHT") or self.leaf(self.right)
            elif low in ("from", "to") and t.islower() and self.frames[-1].count and ahead == "{":
                self.script("_" if low == "from" else "^")
            elif t[0] == '"':
                self.leaf(f"\\{t[1]}" if t in ('"{"', '"}"') else f"\\text{{{t[1:-1]}}}" if len(t) > 2 else "")
            elif t == "`":
                self.leaf("\\,")
            elif t == PRODUCT:
                self.leaf("\\cdot ")
            elif t == "#":
                self.leaf(" \\\\ ")
            elif command := TO_COMMANDS.get(t) or (t[0].isalpha() and len(t) > 1 and (TO_COMMANDS.get(t.upper()) or TO_COMMANDS.get(low))):
                self.leaf(f"{command} ")
            elif glued := next((g for g in ("RM", "IT") if t.upper().startswith(g) and t[2:].isupper()), None):
                self.leaf(f"{FROM_STYLES[glued.lower()]}{{{t[2:]}}}")
            else:
                self.leaf(t)
        return self.done()

    def wrapped(self, row) -> None:
        if row.name == "fence (" and self.steps[-2:] == [("atop", 2), ("row", 1)] and row.count == 1:
            self.steps[-2:] = [("binom", 2)]
            return
        sign = row.name.removeprefix("fence ")
        self.steps.append(("\\left" + ("\\" + sign if sign in ("{", "}") else sign or ".") + "\x00" + getattr(self, "right", "\\right."), 1))


def latex_part(name: str, args: list[str]) -> str:
    if name == "row":
        return "".join(args)
    if name == "group":
        return f"{{{args[0]}}}"
    a, b = (args[0].strip(), args[-1].strip())
    if name in "^_":
        return f"{args[0].rstrip()}{name}{{{b}}}"
    if name == "frac":
        return f"\\frac{{{a}}}{{{b}}}"
    if name == "binom":
        return f"\\binom{{{a}}}{{{b}}}"
    if name == "atop":
        return f"{{{a} \\atop {b}}}"
    if name == "root":
        return f"\\sqrt[{a}]{{{b}}}"
    if name == "sqrt":
        return f"\\sqrt{{{a}}}"
    if name.startswith("env "):
        return f"\\begin{{{name[4:]}}} {a} \\end{{{name[4:]}}}"
    if "\x00" in name:
        left, right = name.split("\x00")
        return f"{left} {a} {right}"
    return f"{name}{{{a}}}"


def script_of(latex: str) -> str:
    return " ".join(worked_out(FromLatex().read(latex), script_part).split())


def any_script_of(latex: str) -> str:
    """Of LaTeX in any spelling."""
    return script_of(prepared(latex))


def latex_of(script: str) -> str:
    return " ".join(worked_out(FromScript().read(script), latex_part).split())


def inline_latex_of(text: str) -> str:
    return "$".join([latex_of(p) if i % 2 else p for i, p in enumerate(text.split("$"))])


def to_script(latex: Column) -> Column:
    """LaTeX as an equation script, of any depth; a null as the empty text. Unknown commands stay, so that `leaks` finds them."""
    return each_shape(any_script_of, apart=r"\textcircled")(text_of(latex))


def to_latex(script: Column) -> Column:
    """An equation script as LaTeX, of any depth; a null as the empty text. `over` takes the item before and after it, a group or a token with its scripts."""
    return each_shape(latex_of)(text_of(script))


def folded(script: Column) -> Column:
    """A long chain of equations in rows (#) aligned at their equals signs (&): cut where an = stands outside all brackets, at most `ROWS` rows, very short parts with the row before. A script with rows of its own, or with fewer than two such signs, stays."""
    s = stripped(text_of(script))
    # LEFT and RIGHT count as brackets of a second kind, whatever sign follows.
    marked = F.regexp_replace(F.regexp_replace(s, r"LEFT(?![A-Za-z])", "\x01"), r"RIGHT(?![A-Za-z])", "\x02")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("fence"), F.lit("").alias("last"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        depth = F.greatest(F.lit(0), a["depth"] + F.when(c.isin("(", "{", "["), 1).when(c.isin(")", "}", "]"), -1).otherwise(0))
        fence = F.greatest(F.lit(0), a["fence"] + F.when(c == "\x01", 1).when(c == "\x02", -1).otherwise(0))
        cut = (c == "=") & (depth == 0) & (fence == 0) & (a["last"] != "") & ~a["last"].isin("<", ">", "!", "=")
        return F.struct(depth.alias("depth"), fence.alias("fence"), c.alias("last"), F.concat(a["out"], F.when(cut, "\x03=").otherwise(c)).alias("out"))

    cut = F.replace(F.aggregate(F.split(marked, ""), start, step, lambda a: a["out"]), F.lit("\x03=="), F.lit("=="))
    parts = F.filter(F.transform(F.split(cut, "\x03"), stripped), lambda p: p != "")

    def rows(parts: Column) -> Column:
        short = lambda p: F.length(stripped(F.replace(p, F.lit("="), F.lit("")))) < SHORTEST
        joined = lambda a, p: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat_ws(" ", F.element_at(a, -1), p)))
        merged = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), lambda a, p: F.when(short(p), joined(a, p)).otherwise(F.array_append(a, p)))

        def laid(m: Column) -> Column:
            few = F.when(F.size(m) > ROWS, F.concat(F.slice(m, 1, ROWS - 1), F.array(F.array_join(F.slice(m, F.lit(ROWS), F.size(m)), " ")))).otherwise(m)
            return F.when(F.size(m) > 1, F.array_join(F.transform(few, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("&"), p))), " # "))

        return let(merged, laid)

    done = F.when((F.size(parts) > 2) & ~s.rlike("[#&]"), let(parts, rows))
    return F.coalesce(F.replace(F.replace(done, F.lit("\x01"), F.lit("LEFT")), F.lit("\x02"), F.lit("RIGHT")), text_of(script))


def inline_to_latex(x: Column) -> Column:
    """A text whose $…$ segments are scripts, with them as LaTeX; a null as the empty text."""
    return each_shape(inline_latex_of)(text_of(x))


def leaks(script: Column) -> Column:
    """A converted equation still holds a command."""
    return F.contains(text_of(script), F.lit("\\"))


def stamped(script: Column, stamp: str) -> Column:
    return F.concat(text_of(script), F.lit(stamp))


def unstamped(script: Column, stamp: str) -> Column:
    return F.when(script.endswith(stamp), F.left(script, F.length(script) - len(stamp))).otherwise(script)
