"""Column functions over questions as nested structs: search texts, worksheets, prompts, lint, and figures that look misread.

A question is a struct as `sources.readers.QUESTION`, a block one as `sources.readers.BLOCK`. All are higher-order
functions inside the row; a null array counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import let, risk_tokens, score_text, stripped, text_of, without_nulls
from foliant.sources.readers import BLOCK, PART

CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
#: What marks a box, an error instead of an answer, a score and an essay's label in a text, and words of a figure's paraphrase.
BOX_LABEL = r"[<\[](보기|조건|상자)[>\]]"
ERROR_TAG = r"^\[(보기|문제)\s*오류\]"
SCORE_IN_TEXT = r"\[\s*(?:총\s*)?\d+(?:\.\d+)?\s*점"
ESSAY_LABEL = r"\[\s*(서술형|서답형|단답형)"
PARAPHRASE = r"(그림|도형|그래프|곡선|좌표|함수)"


def listed(blocks: Column) -> Column:
    return F.coalesce(blocks, F.array().cast(f"array<{BLOCK}>"))


def choices_of(q: Column) -> Column:
    return F.coalesce(q["choices"], F.array().cast(f"array<struct<number:int,contents:array<{BLOCK}>>>"))


def parts_of(q: Column) -> Column:
    return F.coalesce(q["sub_questions"], q["subquestions"], F.array().cast(f"array<{PART}>"))


def is_equation(b: Column) -> Column:
    return text_of(b["type"]).startswith("equation")


def dollars(b: Column) -> Column:
    return F.concat(F.lit("$"), text_of(b["value"]), F.lit("$"))


def cells(b: Column) -> Column:
    """A table's rows in one line: a | b / c."""
    rows = F.coalesce(b["rows"], F.array().cast("array<array<string>>"))
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), " / ")


def has_figure(q: Column) -> Column:
    """A figure among the question's own blocks; those of choices and parts do not count."""
    return F.exists(listed(q["contents"]), lambda b: F.coalesce(b["type"] == "figure", F.lit(False)))


def found_text(blocks: Column) -> Column:
    """What a search finds at ingestion: texts, equations in dollar signs, figures by their description; other blocks say nothing."""
    one = lambda b: F.when(b["type"] == "text", text_of(b["value"])).when(b["type"].isin("equation", "equation_block"), dollars(b)).when(b["type"] == "figure", F.concat(F.lit("[그림: "), text_of(b["value"]), F.lit("]")))
    return stripped(F.array_join(without_nulls(F.transform(listed(blocks), one)), " "))


def exported_text(q: Column) -> Column:
    """The exported text: choices and parts labelled by their numbers, tables without their rows, equations of parts as they are."""
    own = lambda b: F.when(is_equation(b), dollars(b)).when(b["type"] == "figure", F.concat(F.lit("[그림] "), text_of(b["value"]))).otherwise(text_of(b["value"]))
    choice = lambda b: F.when(is_equation(b), dollars(b)).otherwise(text_of(b["value"]))
    labelled = lambda x, one: F.concat(F.lit("("), F.coalesce(x["number"].cast("string"), F.lit("None")), F.lit(") "), F.array_join(F.transform(listed(x["contents"]), one), " "))
    whole = F.concat(F.transform(listed(q["contents"]), own), F.transform(choices_of(q), lambda c: labelled(c, choice)), F.transform(parts_of(q), lambda s: labelled(s, lambda b: text_of(b["value"]))))
    return stripped(F.regexp_replace(F.array_join(whole, " "), r"\s{2,}", " "))


def search_text(q: Column) -> Column:
    """The published text: equations in dollar signs everywhere, tables cell by cell; what is empty leaves no gap."""
    one = lambda b: F.when(is_equation(b), dollars(b)).when(b["type"] == "figure", F.concat(F.lit("[그림] "), text_of(b["value"]))).when(b["type"] == "table", F.coalesce(F.nullif(cells(b), F.lit("")), text_of(b["value"]))).otherwise(text_of(b["value"]))
    numbered = lambda xs, label: F.flatten(F.transform(xs, lambda x: F.concat(F.array(label(F.coalesce(x["number"].cast("string"), F.lit("")))), F.transform(listed(x["contents"]), one))))
    whole = F.concat(F.transform(listed(q["contents"]), one), numbered(choices_of(q), lambda n: n), numbered(parts_of(q), lambda n: F.concat(F.lit("("), n, F.lit(")"))))
    return stripped(F.array_join(F.filter(whole, lambda s: s != ""), " "))


def shown_text(q: Column) -> Column:
    """The text of a hit in a list: figures as a mark only."""
    one = lambda b: F.when(is_equation(b), dollars(b)).when(b["type"] == "figure", F.lit("[그림]")).otherwise(text_of(b["value"]))
    return F.array_join(F.transform(listed(q["contents"]), one), " ")


def worksheet_text(blocks: Column) -> Column:
    """The text of blocks on a solver's worksheet: tables opened, figures described."""
    table = F.lit("[표] ")
    one = lambda b: F.when(b["type"] == "figure", F.concat(F.lit("[그림] "), text_of(b["value"]))).when(b["type"] == "table", F.when(cells(b) != "", F.concat(table, cells(b))).otherwise(F.coalesce(F.nullif(b["value"], F.lit("")), F.lit("[표]")))).otherwise(text_of(b["value"]))
    return stripped(F.array_join(F.filter(F.transform(listed(blocks), one), lambda s: s != ""), " "))


def worksheet(q: Column) -> Column:
    """number, type, score, stem, choices, sub_questions of a question as a solver gets it."""
    return F.struct(
        q["number"].alias("number"), q["type"].alias("type"), q["score"].alias("score"), worksheet_text(q["contents"]).alias("stem"),
        F.transform(choices_of(q), lambda c: F.struct(c["number"].alias("number"), worksheet_text(c["contents"]).alias("text"))).alias("choices"),
        F.transform(parts_of(q), lambda s: F.struct(s["number"].alias("number"), s["score"].alias("score"), worksheet_text(s["contents"]).alias("text"))).alias("sub_questions"),
    )


def markdown(b: Column) -> Column:
    """A table block as lines of | a | b |."""
    rows = F.coalesce(b["rows"], F.array().cast("array<array<string>>"))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")


def prompt_text(q: Column) -> Column:
    """A question as a model reads it: parts with their scores, choices with circled numbers, tables in Markdown. Runs of # that would pass for a delimiter become one."""
    note = lambda v: F.concat(F.lit("\n[그림"), F.when(v != "", F.concat(F.lit(": "), v)).otherwise(""), F.lit("]\n"))

    def one(b: Column) -> Column:
        value = text_of(b["value"])
        maths = F.when(value == "", "").when(b["type"] == "equation", dollars(b)).otherwise(F.concat(F.lit("\n$$"), value, F.lit("$$\n")))
        return F.when(b["type"].isin("equation", "equation_block"), maths).when(b["type"] == "table", F.concat(F.lit("\n"), markdown(b), F.lit("\n"))).when(b["type"] == "figure", note(stripped(value))).when(b["type"] == "image", F.lit("\n[그림]\n")).otherwise(value)

    body = lambda blocks: F.array_join(F.transform(listed(blocks), one), "")
    score = lambda s: F.when(F.coalesce(s["score"].try_cast("double"), F.lit(0.0)) != 0, F.concat(F.lit(" ["), score_text(s["score"].try_cast("double")), F.lit("점]"))).otherwise("")
    part = lambda s: F.concat(F.lit("\n("), F.coalesce(s["number"].cast("string"), F.lit("")), F.lit(") "), body(s["contents"]), score(s))
    mark = lambda n: F.when(n.between(1, 10), F.substring(F.lit(CIRCLED), n, F.lit(1))).otherwise(F.coalesce(n.cast("string"), F.lit("None")))
    choices = F.when(F.size(choices_of(q)) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(choices_of(q), lambda c: F.concat(F.lit("\n"), mark(c["number"]), F.lit(" "), body(c["contents"]))), ""))).otherwise("")
    whole = F.concat(body(q["contents"]), F.array_join(F.transform(parts_of(q), part), ""), choices)
    return F.regexp_replace(stripped(F.regexp_replace(whole, r"\n{3,}", "\n\n")), "#{3,}", "#")


def own_texts(q: Column) -> Column:
    return F.array_join(F.transform(F.filter(listed(q["contents"]), lambda b: b["type"] == "text"), lambda b: text_of(b["value"])), " ")


def lint(q: Column) -> Column:
    """Array of (level, rule) of what breaks the rules of extraction in one question, in order."""
    bad = lambda level, rule, holds: F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule")))
    n, answer = F.size(choices_of(q)), stripped(text_of(q["answer"]))
    empty = F.exists(choices_of(q), lambda c: F.size(listed(c["contents"])) == 0)
    no_box = F.exists(listed(q["contents"]), lambda b: F.coalesce(b["type"] == "figure", F.lit(False)) & (F.coalesce(F.size(b["bbox"]), F.lit(0)) <= 0))
    no_score = q["score"].isNull() | q["score"].isin("", "0")
    return let(
        own_texts(q),
        lambda t: without_nulls(
            F.array(
                bad("FAIL", "fewer than two choices", n == 1), bad("FAIL", "empty choice", empty), bad("FAIL", "score only in the text", no_score & t.rlike(SCORE_IN_TEXT)), bad("WARN", "figure without a box", no_box),
                bad("WARN", "no label type", (n == 0) & t.rlike(ESSAY_LABEL) & (text_of(q["label_type"]) == "")), bad("FAIL", "answer of a choice", (n > 0) & (answer != "") & ~answer.rlike("[①-⑮]") & ~answer.rlike(ERROR_TAG)),
            )
        ),
    )


def two_spellings(questions: Column) -> Column:
    """Both spellings of the essay label among the questions' own texts."""
    labels = F.flatten(F.transform(questions, lambda q: F.regexp_extract_all(own_texts(q), F.lit(ESSAY_LABEL), F.lit(1))))
    return let(labels, lambda x: F.array_contains(x, "서답형") & F.array_contains(x, "서술형"))


def all_blocks(q: Column) -> Column:
    inner = lambda xs: F.flatten(F.transform(xs, lambda x: listed(x["contents"])))
    return F.concat(listed(q["contents"]), inner(choices_of(q)), inner(parts_of(q)))


def figure_risks(q: Column) -> Column:
    """Array of (token, reason) of figures that may be misread: empty, a short paraphrase without any number, or beside a table or box."""

    def of(blocks: Column) -> Column:
        beside = F.exists(blocks, lambda b: F.coalesce((b["type"] == "table") | ((b["type"] == "text") & b["value"].rlike(BOX_LABEL)), F.lit(False)))

        def one(b: Column) -> Column:
            v = stripped(text_of(b["value"]))
            vague = (F.length(v) < 40) & v.rlike(PARAPHRASE) & ~v.rlike(r"\d")
            reason = F.when(v == "", "empty").when(vague, "paraphrase").when(beside, "beside a box")
            token = F.coalesce(F.nullif(F.substring(v, 1, 30), F.lit("")), F.lit("<empty>"))
            return F.when(reason.isNotNull(), F.struct(token.alias("token"), reason.alias("reason")))

        return without_nulls(F.transform(F.filter(blocks, lambda b: b["type"] == "figure"), one))

    return let(all_blocks(q), of)


def flags(q: Column, least: str = "medium") -> Column:
    """Array of (block_type, token, category, severity): risky tokens of texts and equations, block by block, then misread figures."""
    kind = lambda b, r: F.struct(b["type"].alias("block_type"), r["token"].alias("token"), r["category"].alias("category"), r["severity"].alias("severity"))
    texts = F.filter(all_blocks(q), lambda b: b["type"].isin("text", "equation", "equation_block"))
    risky = F.flatten(F.transform(texts, lambda b: F.transform(risk_tokens(b["value"], least), lambda r: kind(b, r))))
    figures = F.transform(figure_risks(q), lambda f: F.struct(F.lit("figure").alias("block_type"), f["token"].alias("token"), F.lit("FIGURE_HANDWRITING").alias("category"), F.lit("medium").alias("severity")))
    return F.concat(risky, figures) if least in ("low", "medium") else risky


def adapted_blocks(blocks: Column) -> Column:
    """Blocks of known types only, with known fields; a table without rows takes those that its value spells as JSON."""
    rows = lambda b: F.coalesce(b["rows"], F.from_json(b["value"], "array<array<string>>"))
    known = F.filter(listed(blocks), lambda b: b["type"].isin("text", "equation", "equation_block", "figure", "table", "image"))
    return F.transform(known, lambda b: F.when(b["type"] == "table", b.withField("rows", rows(b)).withField("value", F.when(b["rows"].isNotNull(), b["value"]))).otherwise(b))
