"""The query surface: filters that apply only when given, searches, queues, prioritised lookups, statistics."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import text_of
from foliant.operators.helpers import dealt, own
from foliant.sources.durable import durable


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """rows where each given column has the value wanted; None, 0 and '' mean any."""
    for name, value in wanted.items():
        if value:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def containing(rows: DataFrame, column: str, text: str | None) -> DataFrame:
    """rows whose text contains another, letters in either case; % and _ are wildcards. Without a text all rows."""
    return rows.filter(F.col(column).ilike(f"%{text}%")) if text else rows


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def counted(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def with_any(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """rows whose key occurs among others."""
    return rows.join(others.select(key), key, "left_semi")


def without_any(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key), key, "left_anti")


def ranked_match(rows: DataFrame, candidates: DataFrame, on: list[str], key: str, tier: Column, order: list[Column]) -> DataFrame:
    """The best candidate of each row by tier, then order; rows without any are dropped. Candidates meet rows by equal columns only."""
    met = rows.join(candidates, on).withColumn("tier", tier).filter("tier is not null")
    return met.withColumn(own("n"), F.row_number().over(Window.partitionBy(key).orderBy("tier", *order))).filter(F.col(own("n")) == 1).drop(own("n"))


def tiered_match(rows: DataFrame, candidates: DataFrame, key: str, tiers: list[tuple[list[str], Column, list[Column]]], pick: list[str]) -> DataFrame:
    """key, pick and tier of the best candidate of each row; rows without any are dropped.

    A tier is the columns that must be equal, a condition on candidates, and the order among them: the least counts.
    Only one candidate of each tier and equal columns can be the best, so no more than that meets a row.
    """
    met, found, tier = rows, [], F.lit(None).cast("int")
    for i, (on, holds, order) in enumerate(tiers):
        best = candidates.filter(holds).groupBy(*on).agg(F.min_by(F.struct(*pick), F.struct(*[o.alias(f"o{j}") for j, o in enumerate(order)])).alias(f"best_{i}"))
        met = met.join(best, on, "left")
        found.append(F.col(f"best_{i}"))
    for i in reversed(range(len(tiers))):
        tier = F.when(found[i].isNotNull(), i).otherwise(tier)
    best = F.coalesce(*found)
    return met.filter(best.isNotNull()).select(key, *[best[c].alias(c) for c in pick], tier.alias("tier"))


def grams(x: Column, *sizes: int) -> Column:
    """The different runs of so many characters of a text."""
    of = lambda n: F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.array_distinct(F.flatten(F.array(*[of(n) for n in sizes])))


def held(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """part, whole: which texts (part) stand in which (whole), both distinct and not empty. Each part meets wholes by one of its pairs of characters only (a part of one character by that), the one that fewest wholes have."""
    at = wholes.select("whole", F.explode(grams(F.col("whole"), 1, 2)).alias("gram"))
    often = at.groupBy("gram").agg(F.count("*").alias("n"))
    own = parts.select("part", F.explode(F.when(F.length("part") > 1, grams(F.col("part"), 2)).otherwise(F.array("part"))).alias("gram"))
    rare = own.join(often, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0").select("part", F.col("r.gram").alias("gram"))
    return rare.join(at, "gram").filter(F.contains("whole", F.col("part"))).select("part", "whole")


def found_in_order(rows: DataFrame, vocabulary: DataFrame, key: str, name: str) -> DataFrame:
    """key, entry, tier of each row: an entry of the same name (0), else of the same name without white space and case (1), else the first that holds the name or that it holds (2). Names and entries of any number: each different name is looked up once, by equality and then by the characters that it shares with entries. Blank names and entries hold nothing."""
    b, e0, e1, e2 = map(own, ("bare", "exact", "alike", "near"))
    bare = lambda c: F.lower(F.regexp_replace(text_of(F.col(c)), r"\s+", ""))
    exact = vocabulary.select(F.col("entry").alias(e0), F.col("entry").alias(name)).distinct()
    alike = vocabulary.groupBy(bare("entry").alias(b)).agg(F.min("entry").alias(e1)).filter(f"{b} <> ''")
    left = rows.select(name, bare(name).alias(b)).distinct().join(exact, name, "left_anti").select(b).filter(f"{b} <> ''").distinct().join(alike, b, "left_anti")
    inside = held(left.select(F.col(b).alias("part")), alike.select(F.col(b).alias("whole"))).select(F.col("part").alias(b), F.col("whole").alias("e"))
    around = held(alike.select(F.col(b).alias("part")), left.select(F.col(b).alias("whole"))).select(F.col("whole").alias(b), F.col("part").alias("e"))
    near = inside.union(around).join(alike.select(F.col(b).alias("e"), F.col(e1).alias(e2)), "e").groupBy(b).agg(F.min(e2).alias(e2))
    met = rows.withColumn(b, bare(name)).join(exact, name, "left").join(alike, b, "left").join(near, b, "left")
    return met.select(key, F.coalesce(e0, e1, e2).alias("entry"), F.when(F.col(e0).isNotNull(), 0).when(F.col(e1).isNotNull(), 1).when(F.col(e2).isNotNull(), 2).alias("tier"))


def zipped(a: DataFrame, b: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """group, place, left, right: the values of two lists by their places in order; a place that one side lacks is null there."""
    placed = lambda d, n: d.select(group, F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("place"), F.col(name).alias(n))
    return placed(a, "left").join(placed(b, "right"), [group, "place"], "full")


#: Of the known rows of equal fields so many make a block, about; rows that look for them are dealt over so many parts.
IDS, PARTS = 256, 16


def wildcard_match(rows: DataFrame, known: DataFrame, fields: list[str], key: str) -> DataFrame:
    """key of rows and id of known: where all fields that a row has agree, its empty fields matching anything. It is an equality join, as known rows stand under each choice of their fields; rows without any match nothing.

    The pairs are far more than the rows: blocks of ids meet parts of the rows, so that no task has all of a key, and the rows of a part meet the same ids in the same order one after the other, which columnar files hold in few bytes.
    """
    on, block, blocks, part = map(own, ("on", "block", "blocks", "part"))
    have = lambda mask: [f for i, f in enumerate(fields) if mask >> i & 1]
    choice = lambda some: F.struct(*[(F.col(f) if f in some else F.lit(None).cast(known.schema[f].dataType)).alias(f) for f in fields])
    choices = [F.when(reduce(and_, [F.col(f).isNotNull() for f in have(mask)]), choice(have(mask))) for mask in range(1, 1 << len(fields))]
    under = known.select("id", F.explode(F.array_compact(F.array(*choices))).alias(on))
    sizes = under.groupBy(on).agg(F.ceil(F.count("*") / IDS).alias(blocks))
    ids = under.join(sizes, on).select("id", on, F.pmod(F.xxhash64("id"), blocks).alias(block), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias(part))
    some = rows.filter(reduce(or_, [F.col(f).isNotNull() for f in fields])).select(key, F.struct(*fields).alias(on), F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias(part))
    met = some.join(sizes, on).select(key, on, part, F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)).alias(block))
    return dealt(met, on, block, part).hint("merge").join(ids, [on, block, part]).select(key, "id")


def grid_fit(points: DataFrame, x: str, y: str, steps: DataFrame, shift: str) -> DataFrame:
    """shift, slope, intercept, error of the best of a grid of shifts: y fitted to the square of x less the shift by least squares. The grid is a short list; each point meets each of its steps once, and sums alone are kept."""
    z = F.pow(F.col(x) - F.col(shift), 2)
    each = points.withColumn(shift, F.explode(F.array(*[F.lit(r[0]) for r in steps.select(shift).collect()]))).withColumn(own("z"), z)
    fit = each.groupBy(shift).agg(F.regr_slope(y, own("z")).alias("slope"), F.regr_intercept(y, own("z")).alias("intercept"), F.regr_r2(y, own("z")).alias("fit"))
    return fit.orderBy(F.desc("fit"), shift).limit(1)


#: The shares of values below what robust gives, by name.
SHARES = {"median": 0.5, "p95": 0.95}
#: Groups of more values are cut into stretches, by edges from a sketch of this accuracy.
MANY, ACCURACY = 100_000, 2_000


def robust(rows: DataFrame, value: str, *by: str, many: int = MANY) -> DataFrame:
    """mean, median, p95 (linear, exact), greatest and count of a value.

    No task has all values of a group: those of many values are cut by edges close around each percentile. Stretches are counted, and different values meet only of those that hold a percentile. The edges are sketched, but the counts are not: bad ones would make long stretches, not other results.
    """
    v = F.col(value)
    edges, part, size, before, end, cut = map(own, ("edges", "part", "size", "before", "end", "cut"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(own(c))) for c in by], F.lit(True))
    named = [F.col(c).alias(own(c)) for c in by]
    around = [max(0.0, min(1.0, share + d / ACCURACY)) for share in SHARES.values() for d in (-2, 2)]
    sketched = F.approx_percentile(v, around, ACCURACY).alias(edges)
    stats = durable(rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.max(v).alias("most"), F.count(v).alias("n"), sketched))
    cuts = stats.filter(F.col("n") > many).select(*named, edges)  # a row for so many of the table
    beyond = F.coalesce(reduce(add, [(v > F.col(edges)[i]).cast("int") for i in range(len(around))]), F.lit(0))
    parts = rows.filter(v.isNotNull()).join(F.broadcast(cuts), same, "left").select(*by, value, F.col(edges).isNotNull().alias(cut), beyond.alias(part))

    group = Window.partitionBy(*by)
    sizes = parts.filter(cut).groupBy(*by, part).agg(F.count("*").alias(size))
    spans = sizes.withColumn(end, F.sum(size).over(group.orderBy(part))).withColumn("n", F.sum(size).over(group))
    place = {name: (F.col("n") - 1) * share for name, share in SHARES.items()}
    holds = lambda rank: (F.col(end) > rank) & (F.col(end) - F.col(size) <= rank)
    wanted = spans.filter(reduce(or_, [holds(f(p)) for p in place.values() for f in (F.floor, F.ceil)]))
    wanted = wanted.select(*named, F.col(part).alias(own("of")), (F.col(end) - F.col(size)).alias(before))

    found = parts.join(F.broadcast(wanted), same & (F.col(part) == F.col(own("of"))), "left").filter(~F.col(cut) | F.col(before).isNotNull())
    counts = found.groupBy(*by, F.coalesce(before, F.lit(0)).alias(before), value).agg(F.count("*").alias(size))
    ended = counts.withColumn(end, F.col(before) + F.sum(size).over(Window.partitionBy(*by, before).orderBy(value)))
    met = stats.join(ended.select(*named, v.cast("double").alias(part), size, end), same, "left")
    at = lambda rank: F.max(F.when(holds(rank), F.col(part)))
    first = [F.first(c).alias(c) for c in ("mean", "most", "n")]
    got = met.groupBy(*by).agg(*first, *[at(f(p)).alias(own(f"{name}_{i}")) for name, p in place.items() for i, f in enumerate((F.floor, F.ceil))])

    def between(name: str, p: Column) -> Column:
        low, high = F.col(own(f"{name}_0")), F.col(own(f"{name}_1"))
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(name)

    return got.select(*by, "mean", *[between(name, p) for name, p in place.items()], "most", "n")


def path_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, path, left, right where two sets of (key, path, value) differ; a missing path is null."""
    both = a.select(key, "path", F.col("value").alias("left")).join(b.select(key, "path", F.col("value").alias("right")), [key, "path"], "full")
    return both.filter(~F.col("left").eqNullSafe(F.col("right")))
