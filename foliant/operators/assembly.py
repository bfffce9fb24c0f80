"""Documents put together from pages: questions that run over a page's end, titles, labels of essays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import SPACE, text_of
from foliant.operators.helpers import own
from foliant.operators.ordered import HOT, carried, numbered
from foliant.sources.durable import durable

#: The kinds of essay, the one that stands for all, and an essay's label with its number at a text's start.
ESSAYS, ESSAY = ["서술형", "서답형", "단답형"], "서술형"
NUMBERED = r"\A(\s*[\[【]\s*서술형\s*)(\d+)(\s*[\]】])"


def one_label(text: Column) -> Column:
    """A text with one word for all kinds of essay, said once."""
    s = F.replace(F.replace(text, F.lit(ESSAYS[1]), F.lit(ESSAY)), F.lit(ESSAYS[2]), F.lit(ESSAY))
    return F.when(text.rlike("|".join(ESSAYS[1:])), F.regexp_replace(s, r"\s*\(\s*서술형\s*\)\s*(?=[\]】])", "")).otherwise(text)


def stitched(parts: DataFrame, document: str, most: int = HOT) -> DataFrame:
    """document, page, place, number, contents (texts) of each question, from the pieces on pages (document, page, place, number, contents): a piece without a number goes on with the question before it, be that on an earlier page; pieces before the first question stand for themselves, without a number. Pages may come in any order."""
    order = ["page", "place"]
    opened = F.when(F.col("number").isNotNull(), F.struct("page", "place", "number"))
    rows = carried(parts.select(document, *order, "contents", opened.alias("opened")), document, order, "opened", "question", most)
    own = F.coalesce("question", F.struct("page", "place", F.lit(None).cast("int").alias("number"))).alias("question")
    pieces = rows.select(document, own, F.struct(*order, F.coalesce("contents", F.array().cast("array<string>")).alias("contents")).alias("piece"))
    one = pieces.groupBy(document, "question").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return one.select(document, "question.page", "question.place", "question.number", F.flatten(F.transform("pieces", lambda p: p["contents"])).alias("contents"))


def titles(pages: DataFrame, document: str) -> DataFrame:
    """document, title of each document: the header of its first page that has one."""
    header = F.regexp_replace(text_of(F.col("header")), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")
    return pages.groupBy(document).agg(F.min_by(F.nullif(header, F.lit("")), F.when(header != "", F.col("page"))).alias("title"))


def essays_unified(questions: DataFrame, document: str, essay: Column, most: int = HOT) -> DataFrame:
    """questions (document, page, place, contents) with one word for all kinds of essay. Where all of a document's essays are labelled with numbers and some are the same, they are numbered anew from 1, in order."""
    is_essay, label, anew, nth = own("essay"), own("label"), own("anew"), own("nth")
    rows = questions.withColumn(is_essay, essay).withColumn("contents", F.transform("contents", one_label))
    rows = durable(rows.withColumn(label, F.when(F.col(is_essay), F.nullif(F.regexp_extract(F.get("contents", F.lit(0)), NUMBERED, 2), F.lit("")))))
    counts = rows.filter(is_essay).groupBy(document).agg(((F.count(label) == F.count("*")) & (F.count_distinct(label) < F.count("*"))).alias(anew)).filter(anew)
    key, name = rows[document], own("document")
    change = counts.select(F.col(document).alias(name), anew)
    met = rows.join(change, key.eqNullSafe(F.col(name)), "left").drop(name)
    some = met.filter(F.coalesce(F.col(anew), F.lit(False)) & F.col(is_essay))
    renamed = numbered(some, document, ["page", "place"], nth, most).withColumn("contents", F.transform("contents", lambda c, i: F.when(i == 0, F.regexp_replace(c, F.lit(NUMBERED), F.concat(F.lit("$1"), F.col(nth).cast("string"), F.lit("$3")))).otherwise(c)))
    rest = met.filter(~(F.coalesce(F.col(anew), F.lit(False)) & F.col(is_essay)))
    return rest.drop(is_essay, label, anew).unionByName(renamed.drop(is_essay, label, anew, nth))
