"""Integrity audits and quality gates, one aggregate each instead of a query a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import balanced, missing
from foliant.operators.helpers import own
from foliant.sources.durable import durable


def numbering(rows: DataFrame, key: str, number: str) -> DataFrame:
    """key, n, duplicates, gaps: of each key's numbers those that occur twice, and the first ten missing between least and greatest."""
    # Numbers come together once each, so a hot key holds no more than it has distinct ones.
    counted = rows.groupBy(key, number).agg(F.count("*").alias("times"))
    seen = F.collect_list(number)
    return counted.groupBy(key).agg(
        F.sum("times").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("times") > 1, F.col(number)))).alias("duplicates"),
        F.slice(F.array_except(F.sequence(F.min(number), F.max(number)), seen), 1, 10).alias("gaps"),
    )


def deviation(rows: DataFrame, value: str, expected: float, least: int = 50, most: float = 0.12) -> DataFrame:
    """value, n, share, biased: shares of values; biased where, of enough rows, one's share is further than `most` from what is expected."""
    counted = rows.groupBy(value).agg(F.count("*").alias("n"))
    total = F.lit(counted.agg(F.sum("n")).first()[0] or 0)
    shares = counted.withColumn("share", F.col("n") / total)
    return shares.select(value, "n", "share", ((total >= least) & (F.abs(F.col("share") - expected) > most)).alias("biased"))


def coverage(rows: DataFrame, *fields: str) -> DataFrame:
    """total, and for each field how many rows have it and which share; no rows count as one in the share."""
    have = [F.coalesce(F.sum((~missing(F.col(f).cast("string"))).cast("int")), F.lit(0)).alias(f"n_{f}") for f in fields]
    return rows.agg(F.count("*").alias("total"), *have).select("total", *[x for f in fields for x in (f"n_{f}", (F.col(f"n_{f}") / F.greatest("total", F.lit(1))).alias(f"share_{f}"))])


def score_checksum(parents: DataFrame, parts: DataFrame, key: str, total: str, part: str, tolerance: float) -> DataFrame:
    """key, total, parts, differs: a printed total against the sum of its parts; a total of zero or none is not checked."""
    sums = parts.groupBy(key).agg(F.sum(part).alias("parts"))
    known = parents.select(key, F.col(total).alias("total")).join(sums, key).filter(F.coalesce(F.col("total"), F.lit(0)) != 0)
    return known.withColumn("differs", F.abs(F.col("total") - F.col("parts")) > tolerance)


def choices_of(questions: DataFrame) -> Column:
    return F.coalesce(F.size("choices"), F.lit(0))


def question_findings(questions: DataFrame) -> DataFrame:
    """exam_id, number, findings: what is wrong with each question (typed as sources.readers.QUESTION), in order; only those with findings."""
    text = lambda bs: F.array_join(F.transform(F.coalesce(bs, F.array().cast("array<struct<value:string>>")), lambda b: F.coalesce(b["value"], F.lit(""))), "")
    stem = F.array_join(F.transform(F.coalesce("contents", F.array().cast(questions.schema["contents"].dataType)), lambda b: F.coalesce(b["value"], F.lit(""))), "")
    drawn = F.exists("contents", lambda b: b["type"].isin("figure", "table"))
    subs = F.coalesce(F.col("sub_questions"), F.col("subquestions"))
    n = F.when(F.col("choices").isNull(), 0).otherwise(F.size("choices"))
    mcq = F.col("type") == "mcq"
    blank = F.exists("choices", lambda c: F.trim(F.array_join(F.transform(c["contents"], lambda b: F.coalesce(b["value"], F.lit(""))), "")) == "")
    index = F.position(F.lit("①②③④⑤⑥⑦⑧⑨⑩"), F.lit("①")) * 0 + F.position(F.trim(F.coalesce("answer", F.lit(""))), F.lit("①②③④⑤⑥⑦⑧⑨⑩"))
    found = F.array(
        F.when((F.trim(stem) == "") & ~F.coalesce(drawn, F.lit(False)) & (F.coalesce(F.size(subs), F.lit(0)) <= 0), "empty stem"),
        F.when(mcq & (n != 5), "choices"),
        F.when(F.coalesce(blank, F.lit(False)), "empty choice"),
        F.when(mcq & (F.length(F.trim(F.coalesce("answer", F.lit("")))) == 1) & (index > n), "answer beyond choices"),
        F.when(~mcq & (n > 0), "choices without MCQ"),
        F.when(~balanced(stem), "unbalanced markup"),
        F.when(stem.contains("�"), "unreadable"),
    )
    return questions.select("exam_id", "number", F.array_compact(found).alias("findings")).filter(F.size("findings") > 0)


def gate(questions: DataFrame, least: int = 15, tolerance: float = 0.05) -> DataFrame:
    """exam_id, reason: why an extracted exam is not taken, the first of the rules; null where it is. questions: exam_id, number, n_choices, unresolved (boolean), printed (array of printed scores), score."""
    g = questions.groupBy("exam_id").agg(
        F.count("*").alias("n"), F.count_distinct("number").alias("distinct"), F.min("number").alias("low"), F.max("number").alias("high"), F.max("unresolved").alias("unresolved"),
        F.coalesce(F.bool_or((F.col("n_choices") > 0) & (F.col("n_choices") != 5)), F.lit(False)).alias("short"), F.count("score").alias("scored"), F.sum("score").alias("total"), F.sum(F.size("printed")).alias("n_printed"),
        F.sum(F.aggregate("printed", F.lit(0.0), lambda a, x: a + x)).alias("sum_printed"),
    )
    reason = (
        F.when(F.col("n") < least, "few questions")
        .when((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("distinct") != F.col("n")), "numbering")
        .when(F.col("unresolved"), "unresolved glyphs")
        .when(F.col("short"), "choices")
        .when((F.col("n_printed") != F.col("scored")) | (F.abs(F.col("sum_printed") - F.coalesce("total", F.lit(0.0))) > tolerance), "scores")
    )
    return g.select("exam_id", reason.alias("reason"))


def stable_ids(now: DataFrame, then: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, verdict of each key of `then`: ok where all known fields agree, shifted where only another key of `now` agrees, mislabeled where none does, weak where nothing is known. Empty fields match anything."""
    some = [(F.col(f"t.{f}").isNull() | (F.col(f"t.{f}") == F.col(f"n.{f}"))) for f in fields]
    known = F.coalesce(*[F.when(F.col(f).isNotNull(), True) for f in fields], F.lit(False))
    t = then.select(key, *fields, known.alias("known"))
    here = t.alias("t").join(now.alias("n"), F.col(f"t.{key}") == F.col(f"n.{key}"), "left")
    agree = some[0]
    for s in some[1:]:
        agree &= s
    same = here.select(F.col(f"t.{key}").alias(key), *[F.col(f"t.{f}").alias(f) for f in fields], "known", F.coalesce(agree, F.lit(False)).alias("same"))
    # Only rows that do not agree in place look elsewhere: for each choice of known fields, among the different values that `now` has of them.
    lost = same.filter("known and not same")
    found = []
    for mask in range(1, 1 << len(fields)):
        have = [f for i, f in enumerate(fields) if mask >> i & 1]
        some = lost
        for f in fields:
            some = some.filter(F.col(f).isNotNull() if f in have else F.col(f).isNull())
        found.append(some.join(now.select(*have).distinct(), have, "left_semi").select(key))
    other = reduce(DataFrame.unionByName, found).distinct().withColumn("elsewhere", F.lit(True))
    return same.join(other, key, "left").select(key, F.when(~F.col("known"), "weak").when(F.col("same"), "ok").when(F.col("elsewhere"), "shifted").otherwise("mislabeled").alias("verdict"))


def surrogate_ids(rows: DataFrame, order: list[str], name: str = "id", within: str = own("bucket"), buckets: int | None = None) -> DataFrame:
    """rows with consecutive ids from 1 in a total order. Rows are ranged over so many buckets, as many as Spark's shuffles have if none is given, and numbered within each; the buckets' sizes, a short table, give the offsets."""
    ranged = rows.repartitionByRange(*([buckets] if buckets else []), *order).withColumn(within, F.spark_partition_id())
    local = durable(ranged.withColumn(own("n"), F.row_number().over(Window.partitionBy(within).orderBy(*order))))  # the sampled ranges must not change between uses
    sizes = local.groupBy(within).agg(F.count("*").alias(own("size")))
    before = sizes.withColumn(own("before"), F.coalesce(F.sum(own("size")).over(Window.orderBy(within).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(within, own("before"))
    return local.join(F.broadcast(before), within).withColumn(name, F.col(own("n")) + F.col(own("before"))).drop(within, own("n"), own("before"))  # a row a bucket
