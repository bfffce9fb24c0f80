"""Column functions of the exam domain: canonical answers and solutions, curricula, lint of pages and questions, boxes of crops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import FENCE, FENCE_END, stripped, text_of

CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
#: The words that difficulty may have, and marks of conditions and parts that prose does not start with.
DIFFICULTIES = ["상", "중", "하"]
PART_MARK = r"^\s*(?:\(\s*[가나다라마바0-9]+\s*\)|[①-⑮㉠-㉭ⓐ-ⓩ]|[ㄱ-ㅎ]\s*[.)]|\[\s*(?:서술형|서답형|조건|보기)(?![가-힣\w]))"
#: What marks an error instead of an answer, and how long its details may be.
ERROR, ERROR_DETAILS = r"(?s)^(\[(?:보기|문제) 오류\])\s*(.*)$", 16
#: An answer's number and label at its start, a whole number as details; brackets around a topic, and how long one may be; what rendered pages must not hold: letters by themselves, scores twice.
ANSWER_NUMBER, ANSWER_LABEL, PLAIN_NUMBER = r"^\d+\s*[.)]\s*(?=\S)", r"^\[\s*[가-힣]*형\s*\d*\s*\]\s*", r"^[-+]?\d+(?:\.\d+)?$"
TOPIC_ENDS, TOPIC_LENGTH = r"^[\[\]()<> ]+|[\[\]()<> ]+$", 40
ESSAY_KIND, CONJOINING, LONE, LEADING_VOWEL, SCORE_TWICE = r"\[\s*(서술형|서답형|단답형)", r"[\x{1100}-\x{11FF}]", r"<hp:t[^>]*>[\x{3130}-\x{318F}]</hp:t>", r"(?<![가-힣])[ㅏ-ㅣ][가-힣]", r"\[\s*\d+\s*점\s*\][^<\[]{0,4}\[\s*\d+\s*점\s*\]"
#: Formulas in a text between \\( and \\), a line of two dollar signs.
IN_LINE, LONE_DOLLARS = r"(?s)\\\(\s*(.+?)\s*\\\)", r"(?m)^[ \t]*\$\$[ \t]*$"
GRADER_NOISE = r"[\s$\\{},~]|mathrm|text|dfrac|frac"


def maths_inline(x: Column) -> Column:
    r"""\(…\) and $$…$$ as $…$ on one line; a lone $$ on a line goes."""
    s = F.regexp_replace(text_of(x), IN_LINE, r"\$$1\$")
    parts = F.split(s, r"\$\$")
    whole = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit("$"), F.regexp_replace(stripped(p), r"\s*\n\s*", " "), F.lit("$"))).otherwise(p)), "")
    return F.when(F.size(parts) % 2 == 1, whole).otherwise(F.regexp_replace(s, LONE_DOLLARS, ""))


def answer_text(x: Column, is_choice: Column) -> Column:
    """An answer without its number and label; of a choice its circled digit, a plain digit being circled. Where an error is marked instead, its details are cut to a short line, a number stands as maths."""
    s = F.regexp_replace(stripped(maths_inline(x)), ANSWER_NUMBER, "")
    s = F.regexp_replace(s, ANSWER_LABEL, "")
    mark, details = F.regexp_extract(s, ERROR, 1), stripped(F.regexp_extract(s, ERROR, 2))
    cut = F.left(details, F.lit(ERROR_DETAILS))
    whole_words = F.regexp_extract(cut, r"(?s)^(.{6,}) [^ ]*$", 1)
    short = F.concat(F.regexp_replace(F.when(whole_words != "", whole_words).otherwise(cut), r"\s+$", ""), F.lit("…"))
    shown = F.when(details.rlike(PLAIN_NUMBER), F.concat(F.lit("$"), details, F.lit("$"))).when(F.length(details) > ERROR_DETAILS, short).otherwise(details)
    tagged, number = mark != "", F.trim(F.concat(mark, F.lit(" "), shown))
    circled = F.regexp_extract(s, f"([{CIRCLED}])", 1)
    digit = F.regexp_extract(s, r"\b([1-9]|10)\b", 1)
    picked = F.when(circled != "", circled).when(digit != "", F.substring(F.lit(CIRCLED), digit.try_cast("int"), F.lit(1))).otherwise(s)
    return F.when(tagged, number).when(is_choice, picked).otherwise(s)


def solution_text(x: Column) -> Column:
    """A solution without fences and blank lines, each line without white space at its ends."""
    bare = F.regexp_replace(F.regexp_replace(stripped(text_of(x)), FENCE, ""), FENCE_END, "")
    lines = F.transform(F.split(F.regexp_replace(maths_inline(bare), "\r\n", "\n"), "\n"), stripped)
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def difficulty(x: Column) -> Column:
    s = stripped(text_of(x))
    return F.when(s.isin(DIFFICULTIES), s).otherwise("")


def topic(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text_of(x), r"\s+", " "), TOPIC_ENDS, ""), 1, TOPIC_LENGTH)


def graded(reference: Column, got: Column, is_choice: Column) -> Column:
    """Whether a benchmark answer is right: a choice needs exactly the one circled digit, else either contains the other."""
    bare = lambda c: F.lower(F.replace(F.regexp_replace(text_of(c), GRADER_NOISE, ""), F.lit("π"), F.lit("pi")))
    marks = F.regexp_extract_all(text_of(got), F.lit("([①-⑤])"), F.lit(1))
    within = F.contains(bare(got), bare(reference)) | F.contains(bare(reference), bare(got))
    return F.when(is_choice, (F.size(marks) == 1) & (F.get(marks, F.lit(0)) == reference)).otherwise(within)


def year_of(x: Column) -> Column:
    """The first two to four digits as a year, two-digit ones from 2000 on."""
    y = F.regexp_extract(x.cast("string"), r"(\d{2,4})", 1).try_cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def old_curriculum(grade: Column, year: Column) -> Column:
    """Whether an exam is of the curriculum before the one of 2025; unknown years and grades are not."""
    return F.coalesce(year_of(year) < 2024 + F.regexp_extract(grade.cast("string"), "([123])", 1).try_cast("int"), F.lit(False))


def term_key(name: Column) -> Column:
    """school|yy-term-round of a file name; what is not there stays empty."""
    return F.concat(F.regexp_extract(name, r"\[([^\]]+)\]", 1), F.lit("|"), F.regexp_extract(name, "(2\\d-\\d-(?:중간|기말))", 1))


def display_width(x: Column) -> Column:
    """Columns that a text takes: two for each full-width character."""
    return F.length(text_of(x)) + F.length(F.regexp_replace(text_of(x), r"[\x{0}-\x{2E7F}]", ""))


def born_digital(pages: Column, least: int = 200) -> Column:
    """Whether the first three of an array of page texts hold more than so many characters."""
    return F.aggregate(F.slice(pages, 1, 3), F.lit(0), lambda n, p: n + F.length(stripped(text_of(p)))) > least


def recoverable_prose(x: Column) -> Column:
    """Prose that may be put back: no table, no mark of a condition or part at its start, mostly Hangul."""
    s = stripped(text_of(x))
    compact = F.regexp_replace(s, r"\s+", "")
    hangul = F.length(F.regexp_replace(compact, "[^가-힣]", ""))
    return (compact != "") & ~s.rlike(r"\||---") & ~s.rlike(PART_MARK) & (hangul >= 0.55 * F.length(compact))


def markup_findings(xml: Column) -> Column:
    """What is wrong with rendered XML: stray letters, doubled scores, two spellings of a label, a missing answer block."""
    plain = F.regexp_replace(text_of(xml), "<[^>]+>", "")
    labels = F.regexp_extract_all(plain, F.lit(ESSAY_KIND), F.lit(1))
    return F.array_compact(
        F.array(
            F.when(plain.rlike(CONJOINING), "conjoining letters"),
            F.when(text_of(xml).rlike(LONE), "lone letter"),
            F.when(plain.rlike(LEADING_VOWEL), "leading vowel"),
            F.when(F.array_contains(labels, "서답형") & F.array_contains(labels, "서술형"), "two spellings"),
            F.when(~F.contains(F.replace(plain, F.lit("(정답)"), F.lit("")), F.lit("정답")), "no answers"),
            F.when(plain.rlike(SCORE_TWICE), "score twice"),
        )
    )


def crop_boxes(x: Column, least: float = 0.02) -> Column:
    """The boxes of a crop answer, as shares of the page within 0 and 1: items on a grid of 1000 (y first), or older crops (x first). Slivers are dropped."""
    json = F.regexp_extract(text_of(x), r"(?s)(\{.*\})", 1)
    read = F.from_json(json, "items array<struct<cropBox:array<double>,class:string,number:string>>, crops array<struct<bbox:array<double>,kind:string,number:string>>")
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    def box(b: Column, order: list[int], scale: float, kind: Column, number: Column) -> Column:
        v = [clamp(F.get(b, F.lit(i)) / scale) for i in order]
        return F.struct(*[c.alias(n) for c, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)], F.coalesce(kind, F.lit("problem")).alias("kind"), number.alias("number"))

    items = F.transform(F.filter(read["items"], lambda i: F.size(i["cropBox"]) == 4), lambda i: box(i["cropBox"], [1, 0, 3, 2], 1000.0, i["class"], i["number"]))
    crops = F.transform(F.filter(read["crops"], lambda i: F.size(i["bbox"]) == 4), lambda i: box(i["bbox"], [0, 1, 2, 3], 1.0, i["kind"], i["number"]))
    return F.filter(F.coalesce(items, crops, F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,kind:string,number:string>>")), lambda b: (b["x1"] - b["x0"] > least) & (b["y1"] - b["y0"] > least))


def page_quality(width: Column, height: Column, sharpness: Column, ink: Column, contrast: Column, least_width: int = 500, least_height: int = 500, sharp: float = 100.0, blank: float = 1.0, faded: float = 30.0) -> Column:
    """100 less 30 for a small image, 40 for a blurred one, 50 for a blank one, 25 for one of little contrast, and the reasons."""
    found = {"small": ((width < least_width) | (height < least_height), 30.0), "blurred": (sharpness < sharp, 40.0), "blank": (ink < blank, 50.0), "faded": (contrast < faded, 25.0)}
    score = F.lit(100.0)
    for holds, penalty in found.values():
        score -= F.when(holds, penalty).otherwise(0.0)
    return F.struct(F.greatest(F.lit(0.0), score).alias("score"), F.array_compact(F.array(*[F.when(holds, name) for name, (holds, _) in found.items()])).alias("reasons"))


def number_text(x: Column) -> Column:
    """A number as scripts write it: 3.0 is 3."""
    return F.regexp_replace(x.cast("string"), r"\.0+$", "")
