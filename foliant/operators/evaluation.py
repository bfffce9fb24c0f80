"""Evaluation of candidate outputs against golden records: similarity, pairing, scores, gates and mined failures."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import let, mismatch, norm_latex, norm_space, norm_strict, norm_symbols, windows
from foliant.operators.helpers import own

#: Tags of regressions, in order.
TAGS = ["QUESTION_COUNT", "CHOICE_COUNT", "CONTENT_TYPE_DRIFT", "NUMBER_MISMATCH", "EQUATION_DRIFT", "BOX_PROSE_DROP", "TABLE_MISSING"]


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest-matching-blocks similarity of two texts; two empty ones are alike. It depends on the order of its arguments."""
    return pd.Series([1.0 if not x and not y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])


def presence_f1(a: Column, b: Column) -> Column:
    """Agreement of two counts: twice the smaller over their sum; both zero agree."""
    return F.when((a == 0) & (b == 0), 1.0).otherwise(2.0 * F.least(a, b) / (a + b))


def count_score(a: Column, b: Column) -> Column:
    """The smaller count over the larger; both zero agree."""
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def paired(candidate: DataFrame, golden: DataFrame, sample: str, number: str, order: str) -> DataFrame:
    """sample, g_order, c_order: golden questions with their candidates, by number first, each candidate once; what is left over by position."""
    first = lambda d, p: d.filter(F.col(number).isNotNull()).groupBy(sample, number).agg(F.min(order).alias(f"{p}_order"))
    met = first(golden, "g").join(first(candidate, "c"), [sample, number]).select(sample, "g_order", "c_order")

    def left_over(d: DataFrame, p: str) -> DataFrame:
        rest = d.select(sample, F.col(order).alias(f"{p}_order")).join(met.select(sample, f"{p}_order"), [sample, f"{p}_order"], "left_anti")
        return rest.withColumn("place", F.row_number().over(Window.partitionBy(sample).orderBy(f"{p}_order")))

    return met.unionByName(left_over(golden, "g").join(left_over(candidate, "c"), [sample, "place"]).select(sample, "g_order", "c_order"))


def cell_accuracy(candidate: Column, golden: Column) -> Column:
    """The share of a golden table's cells that the candidate has in their places, white space aside; missing cells are empty, and a golden table without cells gives null."""
    cells = F.flatten(F.transform(golden, lambda row, i: F.transform(row, lambda c, j: (norm_space(c) == norm_space(F.coalesce(F.get(F.get(candidate, i), j), F.lit("")))).cast("int"))))
    return F.when(F.size(cells) > 0, F.aggregate(cells, F.lit(0), lambda a, x: a + x) / F.size(cells))


def prose_present(text: Column, hay: Column) -> Column:
    """The share of a text's windows that occur in another, both as letters and numbers; 1 without any."""
    found = let(F.struct(norm_strict(text).alias("t"), norm_strict(hay).alias("hay")), lambda z: F.transform(windows(z["t"]), lambda w: F.contains(z["hay"], w).cast("int")))
    return let(found, lambda f: F.when(F.size(f) == 0, 1.0).otherwise(F.aggregate(f, F.lit(0), lambda a, x: a + x) / F.size(f)))


def question_scores(pairs: DataFrame) -> DataFrame:
    """sample_id and the measures of each pair of questions (c_ and g_: number, text, equations, n_choices, types)."""
    return pairs.select(
        "sample_id",
        seq_ratio(norm_strict(F.col("c_text")), norm_strict(F.col("g_text"))).alias("text_ratio"),
        seq_ratio(norm_latex(F.col("c_equations")), norm_latex(F.col("g_equations"))).alias("equation_ratio"),
        count_score(F.col("c_n_choices"), F.col("g_n_choices")).alias("choice_score"),
        seq_ratio(F.array_join("c_types", "\x00"), F.array_join("g_types", "\x00")).alias("type_score"),
        F.when(F.col("c_number").eqNullSafe(F.col("g_number")), 1.0).otherwise(0.0).alias("number_score"),
    )


def sample_scores(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row a sample: means of its pairs' measures (1 without any) and its regression tags. counts: sample_id, c_n, g_n (questions)."""
    names = ["text_ratio", "equation_ratio", "choice_score", "type_score", "number_score"]
    means = question_scores(pairs).groupBy("sample_id").agg(*[F.avg(c).alias(c) for c in names])
    j = counts.join(means, "sample_id", "left").select("sample_id", count_score(F.col("c_n"), F.col("g_n")).alias("count_score"), *[F.coalesce(c, F.lit(1.0)).alias(c) for c in names])
    tags = [("QUESTION_COUNT", F.col("count_score") < 1), ("CHOICE_COUNT", F.col("choice_score") < 1), ("CONTENT_TYPE_DRIFT", F.col("type_score") < 1), ("NUMBER_MISMATCH", F.col("number_score") < 1), ("EQUATION_DRIFT", F.col("equation_ratio") < 0.98)]
    return j.withColumn("regressions", F.array_compact(F.array(*[F.when(c, t) for t, c in tags])))


def agreement(found: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """total, agree, share: of the values that both sides have, how many are the same, white space at the ends aside; the share of none is null."""
    some = lambda d, n: d.select(*keys, F.regexp_replace(value, r"^\s+|\s+$", "").alias(n)).filter(F.col(n) != "")
    both = some(found, "f").join(some(reference, "r"), keys)
    return both.agg(F.count("*").alias("total"), F.count_if(F.col("f") == F.col("r")).alias("agree")).withColumn("share", F.try_divide("agree", "total"))


def verified(reference: DataFrame, found: DataFrame, key: str, number: str, text: str, score: str) -> DataFrame:
    """key, n_reference, n_found, similarity, scores: per document the mean similarity of its questions' texts, a missing one counting 0, and the share of its known scores that are the same."""
    g = found.select(key, number, F.lit(True).alias(own("met")), F.col(text).alias(own("t")), F.col(score).alias(own("s")))
    both = reference.select(key, number, text, score).join(g, [key, number], "left")
    rated = both.withColumn("sim", F.when(F.col(own("met")).isNull(), 0.0).otherwise(seq_ratio(norm_symbols(F.col(text)), norm_symbols(F.col(own("t"))))))
    known = F.when(F.col(score).isNotNull() & F.col(own("met")), F.col(score).eqNullSafe(F.col(own("s"))).cast("int"))
    each = rated.groupBy(key).agg(F.count("*").alias("n_reference"), F.avg("sim").alias("similarity"), F.avg(known).alias("scores"))
    return each.join(found.groupBy(key).agg(F.count("*").alias("n_found")), key).select(key, "n_reference", "n_found", "similarity", "scores")


def aggregated(scores: DataFrame, measures: list[str]) -> DataFrame:
    """n, the mean of each measure without nulls (1 where there are none), and the share of rows with regressions."""
    return scores.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(m), F.lit(1.0)).alias(f"mean_{m}") for m in measures], F.coalesce(F.avg((F.size("regressions") > 0).cast("int")), F.lit(0.0)).alias("regression_rate"))


def ab_gate(base: DataFrame, candidate: DataFrame, key: str = "sample_id", epsilon: float = 1e-9) -> DataFrame:
    """n, base_rate, candidate_rate, new_regressions, passed over common samples (key, regressions): no worse rate, and no sample with a tag it had not."""
    both = base.select(key, F.col("regressions").alias("b")).join(candidate.select(key, F.col("regressions").alias("c")), key)
    rate = lambda c: F.coalesce(F.avg((F.size(c) > 0).cast("int")), F.lit(0.0))
    got = both.agg(F.count("*").alias("n"), rate("b").alias("base_rate"), rate("c").alias("candidate_rate"), F.coalesce(F.sum((F.size(F.array_except("c", "b")) > 0).cast("int")), F.lit(0)).alias("new_regressions"))
    return got.withColumn("passed", (F.col("candidate_rate") <= F.col("base_rate") + epsilon) & (F.col("new_regressions") == 0))


def threshold_gate(summary: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """The summary with `passed`: every measure within its bound; a measure that is null passes."""
    ok = F.lit(True)
    for name, bound in least.items():
        ok &= F.coalesce(F.col(name) >= bound, F.lit(True))
    for name, bound in most.items():
        ok &= F.coalesce(F.col(name) <= bound, F.lit(True))
    return summary.withColumn("passed", ok)


def segments_of(golden: str | None, candidate: str | None, context: int) -> list[dict]:
    """Where two texts differ, with some characters of context."""
    a, b = golden or "", candidate or ""
    cuts = (o for o in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal")
    return [{"golden": a[max(0, i - context) : j + context], "candidate": b[max(0, k - context) : m + context]} for _, i, j, k, m in cuts]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("golden", T.StringType()), T.StructField("candidate", T.StringType())])))
def diff_segments(golden: pa.Array, candidate: pa.Array, context: pa.Array) -> pa.Array:
    """The segments of each pair, worked out once for each different pair of a batch."""
    pairs = [*zip(golden.to_pylist(), candidate.to_pylist(), context.to_pylist(), strict=True)]
    known = {p: segments_of(*p) for p in set(pairs)}
    return pa.array([known[p] for p in pairs], pa.list_(pa.struct([("golden", pa.string()), ("candidate", pa.string())])))


def mined(pairs: DataFrame, context: int = 5) -> DataFrame:
    """sample_id, golden, candidate, category of each difference of pairs (sample_id, g_text, c_text)."""
    found = pairs.select("sample_id", F.explode(diff_segments("g_text", "c_text", F.lit(context))).alias("d")).select("sample_id", "d.golden", "d.candidate")
    return found.withColumn("category", F.coalesce(mismatch(F.col("golden"), F.col("candidate")), F.lit("UNCATEGORIZED")))


def clusters(failures: DataFrame, samples: int = 8) -> DataFrame:
    """category, n, samples: failures by category, null as UNCATEGORIZED, with the first few of each."""
    named = failures.withColumn("category", F.coalesce("category", F.lit("UNCATEGORIZED")))
    n = named.groupBy("category").agg(F.count("*").alias("n"))
    top = named.withColumn(own("n"), F.row_number().over(Window.partitionBy("category").orderBy("sample_id", "golden", "candidate"))).filter(F.col(own("n")) <= samples)
    return n.join(top.groupBy("category").agg(F.array_sort(F.collect_list("sample_id")).alias("samples")), "category")
