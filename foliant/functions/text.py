"""Column functions over text and markup. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Risk categories, their patterns and severities.
RISKS = {
    "HOL_JJAK": (r"(홀수|짝수)", "high"),
    "DECIMAL": (r"(\d+\.\d{2,})", "high"),
    "CONFIDENCE_INTERVAL": (r"(신뢰구간|신뢰도|오차범위|±)", "high"),
    "INEQUALITY": (r"([<>≤≥≦≧]|\\le\b|\\ge\b|\\leq\b|\\geq\b)", "medium"),
    "EXPONENT": (r"(\^\s*\{?\s*\d)", "medium"),
    "PERCENT": (r"(\d+\s*%)", "low"),
    "UNIT": (r"(\d+\s*(?:cm|mm|km|kg|mg|mL|kL|°C|℃)\b)", "low"),
    "NUMBER": (r"(\d{3,})", "low"),
}
#: What a risk's pattern can begin with, for a class of characters.
RISK_BEGINS = r"홀짝신오±\d<>≤≥≦≧\\^"
#: A score in brackets; heads of a model's sections; fences around an answer.
SCORE = r"[\[［(]\s*(?:총\s*)?\d+(?:\.\d+)?\s*점\s*[\]］)]"
SECTION, SECTION_END, ANY_SECTION = r"###\s*{}\s*###\s*\n?", r"###\s*(?:ANSWER|SOLUTION|TOPIC|DIFFICULTY|END)\s*###|\z", r"(?i)###\s*(?:ANSWER|SOLUTION|TOPIC|DIFFICULTY)\s*###"
FENCE, FENCE_END = r"^```[a-zA-Z]*\s*", r"\s*```$"
#: Commands and the signs they stand for, longer ones before those they begin with.
SIGNS = {r"\div": "÷", r"\times": "×", r"\cdot": "·", r"\pm": "±", r"\leq": "≤", r"\le": "≤", r"\geq": "≥", r"\ge": "≥", r"\neq": "≠"}
#: White space of any script, for a class of characters in the patterns of Spark and of SQL alike.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same, each by itself.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SEVERITY = {"low": 0, "medium": 1, "high": 2}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_of(x: Column) -> Column:
    """A null text counts as empty, wherever texts are concatenated or measured."""
    return F.coalesce(x, F.lit(""))


def without_nulls(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull())


def missing(x: Column) -> Column:
    """Null or empty; blanks are not missing."""
    return x.isNull() | (x == "")


def stripped(x: Column) -> Column:
    """Without white space at the ends, of any script and line breaks included."""
    return F.regexp_replace(x, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def norm_dedup(x: Column, longest: int = 120) -> Column:
    """For comparing stems: no white space or maths signs, lower case, the first characters."""
    return F.substring(F.lower(F.translate(text_of(x), WHITE + "$\\{}^_~,.", "")), 1, longest)


def norm_strict(x: Column) -> Column:
    """Letters and numbers only, case kept."""
    return F.regexp_replace(text_of(x), r"[^\p{L}\p{N}]+", "")


def norm_loose(x: Column) -> Column:
    return F.lower(norm_strict(x))


def norm_space(x: Column) -> Column:
    return F.translate(text_of(x), WHITE, "")


def norm_latex(x: Column) -> Column:
    """LaTeX without spacing macros and white space; its structure stays."""
    return norm_space(F.regexp_replace(text_of(x), r"\\(?:qquad|quad|thinspace|,|;|:|!| )", ""))


def norm_symbols(x: Column) -> Column:
    """For comparing sources that write one sign as a command or as itself: signs for commands, then no white space, braces and script marks."""
    for command, sign in SIGNS.items():
        x = F.replace(x, F.lit(command), F.lit(sign))
    return F.translate(text_of(x), WHITE + "{}$\\_^", "")


def hangul_key(x: Column) -> Column:
    """The Hangul of a text alone, which maths and marks cannot disturb."""
    return F.regexp_replace(text_of(x), "[^가-힣]", "")


def without_lead(x: Column, key: Column) -> Column:
    """What follows in a text after its Hangul has spelled a key; null where it begins otherwise."""
    lead = F.concat(F.lit("(?s)^"), F.array_join(F.transform(F.split(key, ""), lambda c: F.concat(F.lit("[^가-힣]*"), c)), ""))
    return F.when((key != "") & F.regexp_like(x, lead), F.regexp_replace(x, lead, F.lit("")))


def wrapped(x: Column, width: int) -> Column:
    """Lines of words no wider than so many columns, full-width characters counting two; a wider word has a line of its own."""
    wide = lambda s: F.length(s) + F.length(F.regexp_replace(s, r"[\x{0}-\x{2E7F}]", ""))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(a: Column, w: Column) -> Column:
        longer = F.concat_ws(" ", F.nullif(a["line"], F.lit("")), w)
        fits = wide(longer) <= width
        return F.struct(F.when(fits | (a["line"] == ""), a["lines"]).otherwise(F.array_append(a["lines"], a["line"])).alias("lines"), F.when(fits, longer).otherwise(w).alias("line"))

    words = F.filter(F.split(text_of(x), r"\s+"), lambda w: w != "")
    return F.aggregate(words, start, step, lambda a: F.when(a["line"] == "", a["lines"]).otherwise(F.array_append(a["lines"], a["line"])))


def without_scores(x: Column) -> Column:
    """Without scores printed in brackets."""
    return stripped(F.regexp_replace(F.regexp_replace(text_of(x), SCORE, ""), r"\s{2,}", " "))


def sections(x: Column) -> Column:
    """answer, solution, topic, difficulty of a model's delimited answer, the last of each; where none is delimited, those of a JSON object in it."""
    bare = F.regexp_replace(F.regexp_replace(stripped(text_of(x)), FENCE, ""), FENCE_END, "")
    names = ["answer", "solution", "topic", "difficulty"]

    def of(s: Column) -> Column:
        block = lambda n: F.try_element_at(F.regexp_extract_all(s, F.lit(f"(?si){SECTION.format(n)}(.*?)(?={SECTION_END})"), F.lit(1)), F.lit(-1))
        some = s.rlike(ANY_SECTION)
        json = F.from_json(F.regexp_extract(F.regexp_replace(s, r"\\\\|\\(?![\"\\/bfnrtu])", r"\\\\"), r"(?s)(\{.*\})", 1), ", ".join(f"{n} string" for n in names))
        revived = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\f(?=[a-zA-Z])", r"\\f"), r"\x08(?=[a-zA-Z])", r"\\b"), r"\r(?=[a-zA-Z])", r"\\r"), r"\t(?=[a-zA-Z])", r"\\t")
        return F.struct(*[F.when(some, stripped(block(n))).otherwise(revived(json[n])).alias(n) for n in names])

    return let(bare, of)


def mismatch(golden: Column, candidate: Column) -> Column:
    """The category of a difference between two texts, the gravest first: odd for even, decimals, intervals, inequalities, exponents, numbers; null for none of them."""
    g, c = text_of(golden), text_of(candidate)
    swapped = (g.contains("홀수") & c.contains("짝수")) | (g.contains("짝수") & c.contains("홀수"))
    found = lambda x, pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    differ = lambda pattern: found(g, pattern) != found(c, pattern)
    interval = RISKS["CONFIDENCE_INTERVAL"][0]
    return (
        F.when(swapped, "HOL_JJAK")
        .when(differ(r"(\d+\.\d+)"), "DECIMAL")
        .when(g.rlike(interval) != c.rlike(interval), "CONFIDENCE_INTERVAL")
        .when(differ(RISKS["INEQUALITY"][0]), "INEQUALITY")
        .when(differ(r"\^\s*\{?\s*(\d+)"), "EXPONENT")
        .when(differ(r"(\d+)"), "NUMBER")
    )


def snake_keys(json: Column, names: list[str]) -> Column:
    """JSON whose keys are in camel case, with those that stand for one of the names in snake case renamed, at any depth."""
    for name in names:
        head, *rest = name.split("_")
        if rest:
            json = F.regexp_replace(json, f'"{head}{"".join(r.title() for r in rest)}"(\\s*:)', f'"{name}"$1')
    return json


def scrubbed(x: Column) -> Column:
    """Without control characters, tabs and line breaks excepted."""
    return F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def single_backslashes(x: Column) -> Column:
    """Runs of two or more backslashes before a letter become one."""
    return F.regexp_replace(x, r"\\{2,}(?=[A-Za-z])", r"\\")


def without_tags(x: Column) -> Column:
    return F.regexp_replace(text_of(x), r"<[^>]+>", "")


def balanced(x: Column) -> Column:
    """Braces close in order and dollar signs pair up; escaped ones do not count."""
    bare = F.regexp_replace(text_of(x), r"\\[{}$]", "")
    signs = F.regexp_extract_all(bare, F.lit(r"([{}])"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == "{", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (a["bad"] | (depth < 0)).alias("bad"))

    closes = F.aggregate(signs, start, step, lambda a: (a["depth"] == 0) & ~a["bad"])
    return closes & (F.length(F.regexp_replace(bare, r"[^$]", "")) % 2 == 0)


def windows(x: Column, size: int = 12, stride: int = 6) -> Column:
    """Sliding windows of a text; one no longer than a window stands for itself, and an empty one has none."""
    cut = F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{size}}})).{{1,{stride}}}"), F.lit(1))  # in one pass; substring counts from a text's start for each window
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).when(F.length(x) <= size, F.array(x)).otherwise(cut)


def around_risks(x: Column) -> Column:
    """A text without what stands between four letters and the next sign that a risk begins with: no risk reaches past four letters, so all of them stay, in order."""
    return F.regexp_replace(text_of(x), rf"(?<=[A-Za-z\x{{C0}}-\x{{24F}}]{{4}})[^{RISK_BEGINS}]+", " ")


def risk_tokens(x: Column, least: str = "medium") -> Column:
    """Array of (category, token, severity): each token once for its category, categories as listed. An unknown threshold counts as medium."""
    floor = SEVERITY.get(least, 1)

    def found(s: Column) -> Column:
        of = lambda pattern: F.array_distinct(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)))
        return F.concat(*[_labelled(of(pattern), name, severity) for name, (pattern, severity) in RISKS.items() if SEVERITY[severity] >= floor])

    return let(around_risks(x), found)


def _labelled(found: Column, name: str, severity: str) -> Column:
    return F.transform(found, lambda t: F.struct(F.lit(name).alias("category"), t.alias("token"), F.lit(severity).alias("severity")))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in SEVERITY.items() for v in kv])[severity], F.lit(0))


def looked_up(x: Column, aliases: dict[str, str]) -> Column:
    """An alias's meaning; what has none passes through."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])[x], x) if aliases else x


def decoded(x: Column, glyphs: dict[str, str]) -> Column:
    """Private glyphs replaced by what they stand for, character by character."""
    return F.array_join(F.transform(F.split(text_of(x), ""), lambda c: looked_up(c, glyphs)), "")


def score_number(raw: Column) -> Column:
    """A score printed as an integer, a decimal or a string, as a number; null where it is none."""
    return raw.try_cast("double")


def score_text(score: Column) -> Column:
    """A score as exams print it: whole numbers without decimals."""
    return F.when(score == F.floor(score), score.cast("long").cast("string")).otherwise(score.cast("string"))


def printed_scores(x: Column) -> Column:
    """All scores printed in brackets, as numbers: [4점], [3.5점]."""
    return F.transform(F.regexp_extract_all(text_of(x), F.lit(r"[\[［(]\s*(?:총\s*)?(\d+(?:\.\d+)?)\s*점\s*[\]］)]"), F.lit(1)), lambda s: s.cast("double"))


def tag(school: Column, grade: Column, subject: Column, year: Column, term: Column, part: Column) -> Column:
    """[school][grade][subject][yy-term-round]; an unknown subject shows as None."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(F.lit("["), shown(school), F.lit("]["), shown(grade), F.lit("]["), shown(subject), F.lit("]["), shown(year % 100), F.lit("-"), shown(term), F.lit("-"), shown(part), F.lit("]"))


def full_year(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def in_scope(level: Column, grade: Column, year: Column) -> Column:
    """The processing scope: 2024 to 2026, middle schools and first grades of high schools."""
    return year.between(2024, 2026) & ((level == "중") | ((level == "고") & (grade == 1)))


def single_choice(answer: Column) -> Column:
    """Exactly one circled digit, white space aside."""
    return stripped(text_of(answer)).rlike("^[①-⑩]$")


def crossed(now: Column, last: Column, step: int = 1000) -> Column:
    """A counter passed a multiple of the step."""
    return F.floor(now / step) > F.floor(last / step)


def signature(x: Column, length: int = 12) -> Column:
    return F.left(F.sha2(x, 256), F.lit(length))


def flatten_blocks(blocks: Column, maths: bool = True) -> Column:
    """Search text of an array of blocks (type, value, rows): maths in dollar signs, tables cell by cell, figures by their description."""
    cell = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), " ")

    def one(b: Column) -> Column:
        value = text_of(b["value"])
        wrapped = F.concat(F.lit("$"), value, F.lit("$")) if maths else value
        return F.when(b["type"].isin("equation", "equation_block"), wrapped).when(b["type"] == "table", text_of(cell(b["rows"]))).otherwise(value)

    return F.array_join(F.filter(F.transform(F.coalesce(blocks, F.array().cast("array<struct<type:string,value:string,rows:array<array<string>>>>")), one), lambda t: t != ""), " ")


def table_markdown(rows: Column) -> Column:
    """Rows of cells as lines of a | b."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def markdown_rows(x: Column) -> Column:
    """Rows of cells of a Markdown table; rule lines drop out."""
    lines = F.filter(F.split(text_of(x), "\n"), lambda s: s.rlike(r"\|") & ~s.rlike(r"^[\s|:\-]+$"))
    return F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(s, r"^\s*\||\|\s*$", ""), r"\|"), stripped))
