"""Pairs of collections with nearly the same stems, by an inverted index instead of comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import norm_dedup
from foliant.sources.durable import durable


def stems(rows: DataFrame, key: str, text: str, shortest: int = 20) -> DataFrame:
    """key, stem: normalised texts that are long enough, repeats included."""
    return rows.select(F.col(key).alias("key"), norm_dedup(F.col(text), 1 << 20).alias("whole")).filter(F.length("whole") >= shortest).select("key", F.substring("whole", 1, 120).alias("stem"))


def classes(found: DataFrame) -> DataFrame:
    """key, rep, total, stems of each key with stems, from (key, stem): keys with the same stems, equally many in all, are copies, and their least key stands for them. stems: the numbers (64-bit hashes) of the distinct ones, in order."""
    one = found.select("key", F.xxhash64("stem").alias("stem")).groupBy("key", "stem").agg(F.count("*").alias("times"))
    sets = one.groupBy("key").agg(F.sum("times").alias("total"), F.array_sort(F.collect_list("stem")).alias("stems"))
    digest = F.struct(F.xxhash64("total", "stems").alias("a"), F.xxhash64(F.lit("second"), "stems", "total").alias("b"))
    marked_ = durable(sets.withColumn("digest", digest))
    reps = marked_.groupBy("digest").agg(F.min("key").alias("rep"))
    return marked_.join(reps, "digest").select("key", "rep", "total", "stems")


def similar_pairs(known: DataFrame, threshold: float = 0.85, apart: int = 3) -> DataFrame:
    """x < y, similarity, tx, ty: pairs of classes, by the keys that stand for them, whose shared distinct stems are so large a share of the larger number of distinct stems.

    Classes whose numbers of stems, repeats included, differ by more than `apart` are no pair. A pair that reaches the
    threshold shares a stem among the first of each in one global order, rarest first: of n distinct stems the first
    n - ceil(threshold * n) + 1. Only those are joined, so stems that everything shares hardly ever meet; and where two
    share such a stem, what is left of both after it must still do, or they are no candidates there. The similarity of
    the candidates is then exact. Copies do not meet at all: each is a member of its class.
    """
    sets = durable(known.filter("key = rep").select("key", "total", "stems"))
    one = sets.select("key", F.explode("stems").alias("stem"))
    often = one.groupBy("stem").agg(F.count("*").alias("keys"))
    n, need = F.size("stems"), lambda x: F.ceil(F.lit(threshold) * x).cast("int")
    # Stems of one key alone find nothing: they only move the others' places.
    shared = one.join(often.filter("keys > 1"), "stem").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("keys", "stem"))).alias("order"))
    met = sets.join(shared, "key").withColumn("alone", n - F.size("order"))
    length = F.greatest(F.lit(0), n - need(n) + 1 - F.col("alone"))
    prefix = met.select("key", "total", n.alias("n"), "alone", F.posexplode(F.slice("order", F.lit(1), length)).alias("at", "s")).select("key", "total", "n", (F.col("alone") + F.col("at")).alias("at"), "s.stem")
    a, b = prefix.alias("a"), prefix.alias("b")
    most = F.greatest("a.n", "b.n")
    near = (F.col("a.n") >= F.col("b.n") * threshold) & (F.col("b.n") >= F.col("a.n") * threshold) & (F.abs(F.col("a.total") - F.col("b.total")) <= apart)
    # Of what comes before a shared stem at places i and j no more than the lesser is shared; after it no more than the shorter rest.
    hope = F.least(F.col("a.at"), F.col("b.at")) + 1 + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) - 1 >= need(most)
    pairs = a.join(b, (F.col("a.stem") == F.col("b.stem")) & (F.col("a.key") < F.col("b.key")) & near & hope).select(F.col("a.key").alias("x"), F.col("b.key").alias("y")).distinct()
    left = sets.select(F.col("key").alias("x"), F.col("total").alias("tx"), F.col("stems").alias("sx"))
    right = sets.select(F.col("key").alias("y"), F.col("total").alias("ty"), F.col("stems").alias("sy"))
    close = pairs.join(left, "x").join(right, "y")
    return close.select("x", "y", (F.size(F.array_intersect("sx", "sy")) / F.greatest(F.size("sx"), F.size("sy"))).alias("similarity"), "tx", "ty").filter(F.col("similarity") >= threshold)


def marked(pairs: DataFrame) -> DataFrame:
    """loser, keeper: of each pair the one with more stems stays, the lower key among equals; of several keepers the last pair's in (x, y) order counts."""
    keeps = F.col("tx") >= F.col("ty")
    each = pairs.select(F.when(keeps, F.col("y")).otherwise(F.col("x")).alias("loser"), F.when(keeps, F.col("x")).otherwise(F.col("y")).alias("keeper"), F.struct("x", "y").alias("o"))
    return each.groupBy("loser").agg(F.max_by("keeper", "o").alias("keeper"))


def copies_marked(known: DataFrame) -> DataFrame:
    """loser, keeper: each copy with the key that stands for its class."""
    return known.filter("key <> rep").select(F.col("key").alias("loser"), F.col("rep").alias("keeper"))


def fingerprint(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, fingerprint, n: a hash of a collection's stems in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), norm_dedup(F.col(text)).alias("t")))), lambda x: x["t"])
    return rows.groupBy(key).agg(F.sha1(F.array_join(parts, "|")).alias("fingerprint"), F.count("*").alias("n"))
