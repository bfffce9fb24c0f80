"""Merge policies: who wins where two sources fill one field. Each is one join and a projection, and running it twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.answers import agree, canonical, worst_confidence
from foliant.functions.equations import inline_to_latex
from foliant.functions.text import single_choice, text_of
from foliant.operators.helpers import own

FIELDS = ("answer", "solution", "topic", "difficulty")
UNREADABLE = "�"


def last_wins(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last."""
    rest = [c for c in items.columns if c not in keys]
    return items.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def first_wins(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first."""
    rest = [c for c in items.columns if c not in keys]
    return items.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def full(x: Column) -> Column:
    """Null for null and empty."""
    return F.nullif(x, F.lit(""))


def _met(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    marked = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("met"))
    return old.join(marked, keys, "left")


def _rest(old: DataFrame, *set_: str) -> list[str]:
    return [c for c in old.columns if c not in set_]


def merge_printed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Printed answers overwrite answer and solution, even with nothing; topic and difficulty only with something. An unreadable answer is none."""
    m = _met(old, new, keys)
    clean = lambda c: full(F.when(F.col(c).contains(UNREADABLE), "").otherwise(F.col(c)))
    over = lambda c: F.when(F.col("met"), clean(f"new_{c}")).otherwise(F.col(c)).alias(c)
    soft = lambda c: F.coalesce(full(F.col(f"new_{c}")), F.col(c)).alias(c)
    source = F.when(F.col("met") & clean("new_answer").isNotNull(), "printed").otherwise(F.col("answer_source")).alias("answer_source")
    return m.select(*_rest(old, *FIELDS, "answer_source"), over("answer"), over("solution"), soft("topic"), soft("difficulty"), source)


def merge_new_first(old: DataFrame, new: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """New values where there are any, else old ones."""
    m = _met(old, new, keys)
    return m.select(*_rest(old, *fields), *[F.coalesce(full(F.col(f"new_{c}")), F.col(c)).alias(c) for c in fields])


def merge_filled(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values first, from a finished copy whose equations are scripts: in answers and solutions they become LaTeX. Where an answer came from stays."""
    return merge_new_first(old, new.withColumns({c: inline_to_latex(F.col(c)) for c in ("answer", "solution")}), keys)


def merge_old_first(old: DataFrame, new: DataFrame, keys: list[str], fields: tuple[str, ...] = ("topic", "difficulty")) -> DataFrame:
    """Old values where there are any, else new ones."""
    m = _met(old, new, keys)
    return m.select(*_rest(old, *fields), *[F.coalesce(full(F.col(c)), full(F.col(f"new_{c}"))).alias(c) for c in fields])


def merge_solved(old: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], long: int = 60) -> DataFrame:
    """Two independent solutions fill missing answers where they agree; long written answers fill the solution only. answer_source tells the worse confidence."""
    fields = ("answer", "solution", "confidence")
    pick = lambda d, s: d.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in fields])
    # Each side is canonicalised once, to columns, where both are there.
    both = pick(a, "a").join(pick(b, "b"), keys).withColumns({"a_forms": canonical(F.col("a_answer")), "b_forms": canonical(F.col("b_answer"))})
    m = old.join(both, keys, "left")
    open_ = full(F.col("answer")).isNull() & full(F.col("a_answer")).isNotNull() & full(F.col("b_answer")).isNotNull()
    written = ~single_choice(F.col("a_answer")) & (F.greatest(F.length(F.get("a_forms", F.lit(0))), F.length(F.get("b_forms", F.lit(0)))) > long)
    agreed = open_ & ~written & agree(F.col("a_forms"), F.col("b_forms"))
    solution = F.coalesce(full(F.col("a_solution")), full(F.col("b_solution")), F.col("solution"))
    return m.select(
        *_rest(old, "answer", "solution", "answer_source"),
        F.when(agreed, F.col("a_answer")).otherwise(F.col("answer")).alias("answer"),
        F.when(agreed | (open_ & written), solution).otherwise(F.col("solution")).alias("solution"),
        F.when(agreed, F.concat(F.lit("computed:"), worst_confidence(F.col("a_confidence"), F.col("b_confidence")))).otherwise(F.col("answer_source")).alias("answer_source"),
    )


def merge_blank(old: DataFrame, new: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Fills only rows whose answer is blank, only with what is there."""
    m = _met(old, new, keys)
    blank = F.trim(text_of(F.col("answer"))) == ""
    return m.select(*_rest(old, *fields), *[F.when(blank, F.coalesce(full(F.col(f"new_{c}")), F.col(c))).otherwise(F.col(c)).alias(c) for c in fields])


def patched(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns set from a map of overrides by key; a null in the map sets null."""
    m = rows.join(patches.select(key, F.col("set").alias(own("set"))), key, "left")
    value = lambda c: F.when(F.coalesce(F.map_contains_key(own("set"), c), F.lit(False)), F.element_at(own("set"), F.lit(c)).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return m.select(*[value(c) if c in columns else F.col(c) for c in rows.columns])


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows replaced by key, new keys added."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def exam_status(items: DataFrame, key: str) -> DataFrame:
    """key, solution_status: no_source without items, done with any answer, else pending."""
    has = F.max(F.when(full(F.col("answer")).isNotNull(), 1).otherwise(0))
    return items.groupBy(key).agg(F.when(F.count("number") == 0, "no_source").when(has == 1, "done").otherwise("pending").alias("solution_status"))


def marked_done(exams: DataFrame, files: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """exams with status done and their question_count where their file is there and has a question; others as they were."""
    have = questions.groupBy(key).agg(F.count("*").alias(own("n"))).join(files.select(key).distinct(), key, "left_semi")
    met = exams.join(have, key, "left")
    new = {"status": F.when(F.col(own("n")) > 0, "done").otherwise(F.col("status")), "question_count": F.coalesce(own("n"), "question_count")}
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in exams.columns])


def best_variant(files: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the order given, with the group's size."""
    w = Window.partitionBy(*keys)
    return files.withColumns({"variants": F.count("*").over(w), own("n"): F.row_number().over(w.orderBy(*order))}).filter(F.col(own("n")) == 1).drop(own("n"))
