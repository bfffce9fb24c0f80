"""Scores of one candidate document against one golden document: structure, texts, equations, figures, tables, and what regressed.

Both are rows of (sample_id, questions), the questions typed as `sources.readers.QUESTION`. Two rows meet by one join on
the sample; all else happens inside the row, so that nothing is shuffled twice.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import let, norm_latex, norm_strict, text_of, windows
from foliant.operators.evaluation import TAGS, count_score, presence_f1
from foliant.sources.readers import BLOCK, QUESTION

#: The equation ratio below which equations drifted, and the length from which a text block counts as prose.
EQUATIONS_ALIKE, PROSE = 0.98, 20


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def seq_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest-matching-blocks similarity of each text of an array to its partner in another."""
    one = lambda x, y: 1.0 if not x and not y else SequenceMatcher(None, x, y).ratio()
    return pd.Series([[one(x or "", y or "") for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)])


def blocks(question: Column) -> Column:
    """All blocks of a question: its own, its choices', its parts'."""
    none = F.array().cast(f"array<{BLOCK}>")
    subs = F.coalesce(question["sub_questions"], question["subquestions"])
    inner = lambda xs: F.coalesce(F.flatten(F.transform(xs, lambda x: F.coalesce(x["contents"], none))), none)
    return F.filter(F.concat(F.coalesce(question["contents"], none), inner(question["choices"]), inner(subs)), lambda b: b.isNotNull())


def joined_values(found: Column, *types: str) -> Column:
    return F.array_join(F.transform(F.filter(found, lambda b: b["type"].isin(*types)), lambda b: text_of(b["value"])), "")


def pairs(c: Column, g: Column) -> Column:
    """Array of (c, g), places from 0: by number, the first of each number on either side, then what is left in order."""
    nc, ng = F.transform(c, lambda q: q["number"]), F.transform(g, lambda q: q["number"])
    place = lambda xs, n: F.array_position(xs, n).cast("int") - 1
    pair = lambda i, j: F.struct(i.cast("int").alias("c"), j.cast("int").alias("g"))
    met = F.filter(F.transform(ng, lambda n, j: F.when(n.isNotNull() & (place(ng, n) == j) & (place(nc, n) >= 0), pair(place(nc, n), j))), lambda p: p.isNotNull())

    def rest(met: Column) -> Column:
        left = lambda xs, side: F.filter(F.transform(xs, lambda _, i: i), lambda i: ~F.exists(met, lambda p: p[side] == i))
        zipped = F.filter(F.zip_with(left(c, "c"), left(g, "g"), lambda i, j: F.when(i.isNotNull() & j.isNotNull(), pair(i, j))), lambda p: p.isNotNull())
        return F.concat(met, zipped)

    return let(met, rest)


def mean(xs: Column) -> Column:
    """The mean of an array; 1 of none."""
    return F.when(F.size(xs) == 0, 1.0).otherwise(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs))


def same_number(a: Column, b: Column) -> Column:
    """Equal as numbers where both are, else as texts; null equals null."""
    return F.when(a.try_cast("double").isNotNull() & b.try_cast("double").isNotNull(), a.try_cast("double") == b.try_cast("double")).otherwise(a.eqNullSafe(b))


def prose_dropped(golden: Column, text: Column) -> Column:
    """Whether some long text block of the golden blocks has no window in the candidate's text, both as letters and numbers."""
    lost = lambda t: ~F.exists(windows(t), lambda w: F.contains(text, w))
    return F.exists(F.transform(F.filter(golden, lambda b: b["type"] == "text"), lambda b: norm_strict(b["value"])), lambda t: (F.length(t) >= PROSE) & lost(t))


def largest_table(found: Column) -> Column:
    """The rows of the table with most cells, the first of equals; null without tables."""
    rows = F.transform(F.filter(found, lambda b: b["type"] == "table"), lambda b: F.coalesce(b["rows"], F.array().cast("array<array<string>>")))
    sized = F.transform(rows, lambda r, i: F.struct(F.aggregate(r, F.lit(0), lambda a, x: a + F.size(x)).alias("cells"), (-i).alias("place"), r.alias("rows")))
    return F.array_max(F.transform(sized, lambda s: F.struct(s["cells"], s["place"], s["rows"])))["rows"]


def table_accuracy(candidate: Column, golden: Column) -> Column:
    """The share of a golden table's cells that the candidate has in their places, as letters and numbers; missing cells are empty, and a golden table without cells is met."""
    hits = F.flatten(F.transform(golden, lambda row, i: F.transform(row, lambda c, j: (norm_strict(c) == norm_strict(F.get(F.get(candidate, i), j))).cast("double"))))
    return let(hits, mean)


def outgrown(candidate: Column, golden: Column) -> Column:
    """Whether a candidate's table has more rows, or a row more cells, than the golden one."""
    return (F.size(candidate) > F.size(golden)) | F.exists(F.zip_with(candidate, golden, lambda c, g: F.size(c) > F.size(g)), lambda x: F.coalesce(x, F.lit(False)))


def score_crops(candidate: DataFrame, golden: DataFrame) -> DataFrame:
    """sample_id and scores of each golden sample; a sample without a candidate is scored against no questions."""
    none = F.array().cast(f"array<{QUESTION}>")
    both = golden.select("sample_id", F.coalesce("questions", none).alias("g")).join(candidate.select("sample_id", F.coalesce("questions", none).alias("c")), "sample_id", "left").withColumn("c", F.coalesce("c", none))
    found = both.select(
        "sample_id", "c", "g", pairs(F.col("c"), F.col("g")).alias("p"),
        F.flatten(F.transform("c", blocks)).alias("cb"), F.flatten(F.transform("g", blocks)).alias("gb"),
    )
    q = lambda side, p: F.get(F.col(side), p[side])
    n_choices = lambda x: F.coalesce(F.when(x["choices"].isNotNull(), F.size(x["choices"])), F.lit(0))
    types = lambda side: F.transform("p", lambda p: F.array_join(F.transform(F.coalesce(q(side, p)["contents"], F.array().cast(f"array<{BLOCK}>")), lambda b: text_of(b["type"])), "\x00"))
    number = lambda b, t: F.size(F.filter(b, lambda x: x["type"] == t))
    read = found.select(
        "sample_id", "gb", F.size("c").alias("nc"), F.size("g").alias("ng"), types("c").alias("ct"), types("g").alias("gt"),
        F.transform("p", lambda p: count_score(n_choices(q("c", p)), n_choices(q("g", p)))).alias("choices"),
        F.transform("p", lambda p: q("c", p)["number"].eqNullSafe(q("g", p)["number"]).cast("double")).alias("numbers"),
        F.transform("p", lambda p: same_number(q("c", p)["score"], q("g", p)["score"]).cast("double")).alias("scores"),
        norm_strict(joined_values(F.col("cb"), "text")).alias("c_text"), norm_strict(joined_values(F.col("gb"), "text")).alias("g_text"),
        norm_latex(joined_values(F.col("cb"), "equation", "equation_block")).alias("c_eq"), norm_latex(joined_values(F.col("gb"), "equation", "equation_block")).alias("g_eq"),
        *[number(F.col(b), t).alias(f"{b}_{t}") for b in ("cb", "gb") for t in ("table", "figure")], largest_table(F.col("cb")).alias("c_rows"), largest_table(F.col("gb")).alias("g_rows"),
    )
    rated = read.withColumns({"types": seq_ratios("ct", "gt"), "ratios": seq_ratios(F.array("c_text", "c_eq"), F.array("g_text", "g_eq"))})
    accuracy = F.when(F.col("gb_table") == 0, None).when(F.col("cb_table") == 0, 0.0).otherwise(table_accuracy(F.col("c_rows"), F.col("g_rows")))
    scored = rated.select(
        "*", count_score(F.col("nc"), F.col("ng")).alias("question_count_score"), mean(F.col("choices")).alias("choice_count_score"), mean(F.col("types")).alias("content_type_score"),
        presence_f1(F.col("cb_table"), F.col("gb_table")).alias("table_presence_f1"), presence_f1(F.col("cb_figure"), F.col("gb_figure")).alias("figure_presence_f1"),
        mean(F.col("numbers")).alias("number_score"), mean(F.col("scores")).alias("score_score"), F.get("ratios", F.lit(0)).alias("text_ratio"), F.get("ratios", F.lit(1)).alias("equation_ratio"), accuracy.alias("table_cell_acc"),
    )
    seven = ["question_count_score", "choice_count_score", "content_type_score", "number_score", "score_score", "table_presence_f1", "figure_presence_f1"]
    drift = (F.col("ct") != F.col("gt")) | ((F.col("gb_table") > 0) & (F.col("cb_table") > 0) & outgrown(F.col("c_rows"), F.col("g_rows")))
    when = [
        F.col("nc") != F.col("ng"), F.exists("choices", lambda x: x < 1), drift, F.exists("numbers", lambda x: x < 1), F.col("equation_ratio") < EQUATIONS_ALIKE,
        prose_dropped(F.col("gb"), F.col("c_text")), (F.col("gb_table") > 0) & (F.col("cb_table") == 0),
    ]
    tags = F.array_compact(F.array(*[F.when(F.coalesce(w, F.lit(False)), t) for w, t in zip(when, TAGS, strict=True)]))
    struct = sum((F.col(c) for c in seven[1:]), F.col(seven[0])) / len(seven)
    return scored.select("sample_id", struct.alias("struct_score"), *seven, "text_ratio", "equation_ratio", "table_cell_acc", tags.alias("regressions"))


def aggregated_crops(scores: DataFrame) -> DataFrame:
    """n_samples, means of ratios and structure (1 of none), of table cells (null of none), and how many samples regressed."""
    regressed = F.size("regressions") > 0
    some = lambda c: F.coalesce(F.avg(c), F.lit(1.0))
    return scores.agg(
        F.count("*").alias("n_samples"), some("text_ratio").alias("mean_text_ratio"), some("equation_ratio").alias("mean_equation_ratio"), some("struct_score").alias("struct_accuracy"),
        F.avg("table_cell_acc").alias("mean_table_cell_acc"), F.count_if(regressed).alias("n_regressions"), F.coalesce(F.avg(regressed.cast("int")), F.lit(0.0)).alias("regression_rate"),
    )
