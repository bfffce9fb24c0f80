"""Operators that depend on the order of rows: accepted headers, carried values, islands, tails, columns, reading order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.helpers import own
from foliant.sources.durable import durable


#: An essay's label before its number.
ESSAY_LABEL = r"[\[【]\s*(?:서술형|서답형|단답형)\s*\d*\s*[\]】]"

#: Rows of one group beyond which it is cut into ranges.
HOT = 1_000_000


def accepted(numbers: Column) -> Column:
    """Of candidate numbers in order those that continue 1, 2, 3, …: each is taken only if it follows the last taken."""
    return F.aggregate(numbers, F.array().cast("array<int>"), lambda acc, n: F.when(n == F.size(acc) + 1, F.array_append(acc, n)).otherwise(acc))


def accepted_places(numbers: Column) -> Column:
    """The places, from 0, of the numbers that `accepted` takes."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))

    def step(a: Column, n: Column) -> Column:
        taken = F.coalesce(n == F.size(a["places"]) + 1, F.lit(False))
        return F.struct((a["at"] + 1).alias("at"), F.when(taken, F.array_append(a["places"], a["at"])).otherwise(a["places"]).alias("places"))

    return F.aggregate(numbers, start, step, lambda a: a["places"])


def skeleton(lines: DataFrame, group: str, order: str, text: str, header: str = r"^\s*(\d{1,2})\s*[.)]", most: int = HOT) -> DataFrame:
    """group, number, text of the questions that a document's lines make: a line that begins with the next number opens a question, the lines up to the next one belong to it; what stands before the first is left out. Of a document only the numbers of lines that begin with one come together, and then the lines of each question."""
    number = F.regexp_extract(text, header, 1).try_cast("int")
    heads = lines.select(group, F.col(order).alias("o"), number.alias("n")).filter("n is not null").groupBy(group).agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("x"))
    opened = heads.withColumn("at", accepted_places(F.transform("x", lambda r: r["n"]))).select(group, F.explode(F.transform("at", lambda i: F.get("x", i))).alias("h")).select(F.col(group).alias(own("g")), F.col("h.o").alias(own("o")), F.col("h.n").alias(own("number")))
    met = lines.select(group, F.col(order), F.col(text)).join(opened, F.col(group).eqNullSafe(F.col(own("g"))) & (F.col(order) == F.col(own("o"))), "left").drop(own("g"), own("o"))
    whole = carried(met, group, order, own("number"), own("open"), most).filter(F.col(own("open")).isNotNull())
    one = whole.groupBy(group, F.col(own("open")).alias("number")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("x"))
    return one.select(group, "number", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("text"))


def last_above(figures: DataFrame, glyphs: DataFrame, page: str, band: float = 30.0) -> DataFrame:
    """figures (id, page, x, y) with `glyph`: the last glyph (glyph, page, x, y) above each, no further than the band to either side. Glyphs are laid on columns as wide as the band, so that figures meet only those near them."""
    laid = glyphs.select(page, "glyph", F.col("x").alias("gx"), F.col("y").alias("gy"), F.explode(F.array(*[F.floor(F.col("x") / band) + i for i in (-1, 0, 1)])).alias("column"))
    near = figures.withColumn("column", F.floor(F.col("x") / band)).join(laid, [page, "column"]).filter((F.abs(F.col("x") - F.col("gx")) <= band) & (F.col("gy") < F.col("y")))
    return figures.join(near.groupBy("id").agg(F.max_by("glyph", F.struct("gy", "glyph")).alias("glyph")), "id", "left")


def overlap_share(a: list[Column], b: list[Column]) -> Column:
    """The part of the smaller of two boxes (x0, y0, x1, y1) that lies in the other."""
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    shared = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.coalesce(F.try_divide(shared, F.least(area(a), area(b))), F.lit(0.0))


def ranged(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame | None:
    """rows cut by group and order into ranges of about `most`, with their range in a column of its own; None where no group has more rows than that. Written, as the sampled ranges must not change between uses."""
    counts = rows.groupBy(group).count()
    if counts.filter(F.col("count") > most).isEmpty():
        return None
    total = counts.agg(F.sum("count")).first()[0]
    return durable(rows.repartitionByRange(max(2, -(-total // most)), group, *order).withColumn(own("p"), F.spark_partition_id()))


def with_parts(rows: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """rows of `ranged` with the columns that parts (range, group, …) have for their range and group, an unknown group included."""
    named = parts.select(F.col(own("p")).alias(own("q")), F.col(group).alias(own("g")), *[c for c in parts.columns if c not in (own("p"), group)])
    return rows.join(named, (F.col(own("p")) == F.col(own("q"))) & F.col(group).eqNullSafe(F.col(own("g"))), "left").drop(own("q"), own("g"))


def carried(rows: DataFrame, group: str, order: str | list[str], value: str, name: str, most: int = HOT) -> DataFrame:
    """rows with the last known value at or before each. Groups of more than `most` rows are cut into ranges: each is carried on its own, then what the ranges before it end with is put at its start."""
    order = [order] if isinstance(order, str) else order
    last = lambda *by: F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cut = ranged(rows, group, order, most)
    if cut is None:
        return rows.withColumn(name, last(group))
    ends = cut.groupBy(own("p"), group).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(own("end")))
    before = F.last(own("end"), ignorenulls=True).over(Window.partitionBy(group).orderBy(own("p")).rowsBetween(Window.unboundedPreceding, -1))
    local = cut.withColumn(name, last(own("p"), group))
    return with_parts(local, ends.select(own("p"), group, before.alias(own("before"))), group).withColumn(name, F.coalesce(name, own("before"))).drop(own("before"), own("p"))


def numbered(rows: DataFrame, group: str, order: list[str], name: str, most: int = HOT) -> DataFrame:
    """rows with their place in their group, from 1. Groups of more than `most` rows are cut into ranges, whose sizes are summed."""
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    cut = ranged(rows, group, order, most)
    if cut is None:
        return rows.withColumn(name, place(group))
    sizes = cut.groupBy(own("p"), group).agg(F.count("*").alias(own("n")))
    start = F.coalesce(F.sum(own("n")).over(Window.partitionBy(group).orderBy(own("p")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return with_parts(cut.withColumn(name, place(own("p"), group)), sizes.select(own("p"), group, start.alias(own("before"))), group).withColumn(name, F.col(name) + F.col(own("before"))).drop(own("before"), own("p"))


def segments(rows: DataFrame, group: str, start: str, most: int = HOT) -> DataFrame:
    """rows with `end`: where the next one of the group starts. Groups of more than `most` rows are cut into ranges: the last of each ends where the next range begins."""
    after = lambda *by: F.lead(start).over(Window.partitionBy(*by).orderBy(start))
    cut = ranged(rows, group, [start], most)
    if cut is None:
        return rows.withColumn("end", after(group))
    starts = cut.groupBy(own("p"), group).agg(F.min(start).alias(own("first")))
    following = F.lead(own("first")).over(Window.partitionBy(group).orderBy(own("p")))
    return with_parts(cut.withColumn("end", after(own("p"), group)), starts.select(own("p"), group, following.alias(own("next"))), group).withColumn("end", F.coalesce("end", own("next"))).drop(own("next"), own("p"))


def with_facts(rows: DataFrame, facts: DataFrame, group: str) -> DataFrame:
    """rows with the columns of facts (one row a group), an unknown group included. Spark splits a hot group's side of the join."""
    return rows.join(facts.withColumnRenamed(group, own("g")), F.col(group).eqNullSafe(F.col(own("g"))), "left").drop(own("g"))


def answer_fragment(choices: Column, score: Column, number: Column, stem: Column, label_type: Column, earlier: Column) -> Column:
    """Whether a row looks like a piece of an answer key: no choices, score or label, and a number that an essay before it had already. earlier: the set of those numbers."""
    unseen = (number > 0) & ~F.coalesce(F.array_contains(earlier, number), F.lit(False))
    labelled = F.coalesce(stem, F.lit("")).rlike(ESSAY_LABEL)
    return ~(choices | (F.coalesce(score, F.lit(0.0)) != 0) | (F.trim(F.coalesce(label_type, F.lit(""))) != "") | F.coalesce(unseen, F.lit(False)) | labelled)


def earlier_essays(rows: DataFrame, group: str, order: str, number: str, essay: Column, name: str = "earlier") -> DataFrame:
    """rows with the set of numbers that essays before each had. Of each number only its first place is kept, so that what meets a row is no longer than the set that it can get."""
    firsts = rows.filter(essay & F.col(number).isNotNull()).groupBy(group, number).agg(F.min(order).alias(own("first"))).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(own("first")).alias("at"), F.col(number).alias("number")))).alias(own("firsts")))
    before = F.transform(F.filter(own("firsts"), lambda x: x["at"] < F.col(order)), lambda x: x["number"])
    return with_facts(rows, firsts, group).withColumn(name, F.coalesce(before, F.array().cast(f"array<{rows.schema[number].dataType.simpleString()}>"))).drop(own("firsts"))


def spaced_islands(rows: DataFrame, group: str, order: list[str], maths: str, char: str, name: str = "island", most: int = HOT) -> DataFrame:
    """rows with the number of their run of maths or text: a space right after maths counts as maths."""
    # Spaces in a row after maths all belong to it: the last that is no space decides.
    shown = carried(rows.withColumn(own("own"), F.when(F.col(char) != " ", F.col(maths))), group, order, own("own"), own("last"), most)
    marked = shown.withColumn(own("m"), F.when(F.col(char) == " ", F.coalesce(own("last"), F.lit(False))).otherwise(F.col(maths))).drop(own("own"), own("last"))
    return islands(marked, group, order, own("m"), name, most).drop(own("m"))


def list_cut(rows: DataFrame, group: str, order: str, number: str, last: str) -> DataFrame:
    """group, cut: the first place after the last question whose number is no greater than that question's: there an answer list begins. last: the last question's place."""
    at = rows.filter(F.col(order) == F.col(last)).select(group, F.col(number).alias(own("last")))
    return rows.join(at, group).filter((F.col(order) > F.col(last)) & (F.col(number) <= F.col(own("last")))).groupBy(group).agg(F.min(order).alias("cut"))


def islands(rows: DataFrame, group: str, order: list[str], value: str, name: str = "island", most: int = HOT) -> DataFrame:
    """rows with the number of their run of equal values, from 1. Groups of more than `most` rows are cut into ranges, numbered each on its own and then on from the ranges before."""
    cut = ranged(rows, group, order, most)
    by = [group] if cut is None else [own("p"), group]
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w))
    if cut is None:
        return rows.withColumn(own("new"), (changed | first).cast("int")).withColumn(name, F.sum(own("new")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(own("new"))
    along = Window.partitionBy(group).orderBy(own("p"))
    ends = cut.groupBy(own("p"), group).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias(own("end")))
    met = with_parts(cut, ends.select(own("p"), group, F.lag(own("end")).over(along).alias(own("last"))), group)
    starts = F.when(first, F.col(own("last")).isNull() | ~F.col(value).eqNullSafe(F.col(own("last"))["v"])).otherwise(changed)
    new = durable(met.withColumn(own("new"), starts.cast("int")).drop(own("last")))
    sums = new.groupBy(own("p"), group).agg(F.sum(own("new")).alias(own("sum")))
    before = F.coalesce(F.sum(own("sum")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = new.withColumn(name, F.sum(own("new")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return with_parts(local, sums.select(own("p"), group, before.alias(own("before"))), group).withColumn(name, F.col(name) + F.col(own("before"))).drop(own("before"), own("new"), own("p"))


def tail_trimmed(rows: DataFrame, group: str, order: str, fragment: Column, most: float = 0.5) -> DataFrame:
    """rows without the longest run at a group's end that is all fragments, unless that were more than `most` of the group. What stands behind a group's last row that is no fragment is that run."""
    d = rows.withColumn(own("f"), F.coalesce(fragment, F.lit(False)))
    met = with_facts(d, d.groupBy(group).agg(F.max(F.when(~F.col(own("f")), F.col(order))).alias(own("last")), F.count("*").alias(own("n"))), group)
    tail = met.withColumn(own("tail"), F.col(own("last")).isNull() | (F.col(order) > F.col(own("last"))))
    cut = tail.groupBy(group).agg(F.sum(F.col(own("tail")).cast("int")).alias(own("cut")))
    return with_facts(tail, cut, group).filter(~F.col(own("tail")) | (F.col(own("cut")) > most * F.col(own("n")))).drop(own("f"), own("last"), own("n"), own("tail"), own("cut"))


def reordered(rows: DataFrame, group: str, order: str, number: str, most: int = HOT) -> DataFrame:
    """rows with `place`: by number if all numbers of a group are positive and distinct, else as they were."""
    valid = rows.groupBy(group).agg(((F.min(number) > 0) & (F.count_distinct(number) == F.count("*"))).alias(own("ok")))
    keyed = with_facts(rows, valid, group).withColumn(own("key"), F.when(F.coalesce(own("ok"), F.lit(False)), F.col(number)).otherwise(F.col(order)))
    return numbered(keyed, group, [own("key"), order], "place", most).drop(own("ok"), own("key"))


def renumbered(rows: DataFrame, group: str, order: str, label: str, most: int = HOT) -> DataFrame:
    """rows with labels 1, 2, 3, … where a group's labels are all there but some are twice."""
    state = rows.groupBy(group).agg(((F.count(label) == F.count("*")) & (F.count_distinct(label) < F.count("*"))).alias(own("again")))
    placed = numbered(with_facts(rows, state, group), group, [order], own("place"), most)
    return placed.withColumn(label, F.when(F.col(own("again")), F.col(own("place")).cast("string")).otherwise(F.col(label).cast("string"))).drop(own("again"), own("place"))


def column_cut(rows: DataFrame, group: str, x: str, least: float) -> DataFrame:
    """group, cut: the middle of the widest gap between sorted x, null where none is wide enough; the leftmost of equals."""
    w = Window.partitionBy(group).orderBy(x)
    gaps = rows.select(group, x).distinct().withColumn(own("p"), F.lag(x).over(w)).select(group, (F.col(x) - F.col(own("p"))).alias("gap"), ((F.col(x) + F.col(own("p"))) / 2).alias("middle"))
    return gaps.groupBy(group).agg(F.max_by("middle", F.struct("gap", -F.col("middle"))).alias("middle"), F.max("gap").alias("gap")).select(group, F.when(F.col("gap") >= least, F.col("middle")).alias("cut"))


def reading_order(boxes: DataFrame, group: str) -> DataFrame:
    """boxes (id, x0, y0, x1, y1) with `place`: rows of boxes that overlap by half their height, top down, each from left to right. One page a group, so groups are small."""
    schema = T.StructType([*boxes.schema.fields, T.StructField("place", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines: list[list] = []
        for b in sorted(pdf.itertuples(), key=lambda b: (b.y0, b.x0, b.id)):
            for line in lines:
                top, bottom = line[0].y0, line[0].y1
                if min(bottom, b.y1) - max(top, b.y0) >= 0.5 * min(bottom - top, b.y1 - b.y0):
                    line.append(b)
                    break
            else:
                lines.append([b])
        order = [b.Index for line in lines for b in sorted(line, key=lambda b: (b.x0, b.y0, b.id))]
        return pdf.loc[order].assign(place=range(1, len(order) + 1))

    return boxes.groupBy(group).applyInPandas(run, schema)


def last_before(left: DataFrame, right: DataFrame, group: str, at: str, value: str, most: int = HOT) -> DataFrame:
    """left with the value of the last row of right at or before it in its group: both are merged into one order and the last known value carried, so no pairs are made; a hot group is cut into ranges."""
    tagged = left.withColumns({own("v"): F.lit(None).cast(right.schema[value].dataType), own("r"): F.lit(1)}).unionByName(right.select(group, at, F.col(value).alias(own("v")), F.lit(0).alias(own("r"))), allowMissingColumns=True)
    return carried(tagged, group, [at, own("r")], own("v"), f"last_{value}", most).filter(F.col(own("r")) == 1).drop(own("v"), own("r"))


def point_in_box(points: DataFrame, boxes: DataFrame, page: str, cell: float = 50.0) -> DataFrame:
    """points (id, page, x, y) with the first box (box, page, x0, y0, x1, y1) they lie in: boxes are laid on a grid, so that points meet only boxes near them. Of boxes in one place only the first counts, and each place of points is looked up once."""
    grid = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    first = boxes.groupBy(page, "x0", "x1", "y0", "y1").agg(F.min("box").alias("box"))
    laid = first.withColumn("gx", grid("x0", "x1")).withColumn("gy", grid("y0", "y1"))
    places = points.select(page, "x", "y").distinct()
    p = places.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)})
    hit = p.join(laid, [page, "gx", "gy"]).filter("x between x0 and x1 and y between y0 and y1").groupBy(page, "x", "y").agg(F.min("box").alias("box"))
    return points.join(hit, [page, "x", "y"], "left")


def outer_boxes(boxes: DataFrame, page: str) -> DataFrame:
    """boxes that lie in no larger one of their page; of equal ones the first. A page's boxes are few."""
    a, b = boxes.alias("a"), boxes.alias("b")
    area = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    inside = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a.x0") >= F.col("b.x0")) & (F.col("a.x1") <= F.col("b.x1")) & (F.col("a.y0") >= F.col("b.y0")) & (F.col("a.y1") <= F.col("b.y1"))
    larger = (area("b") > area("a")) | ((area("b") == area("a")) & (F.col("b.box") < F.col("a.box")))
    return a.join(b, inside & larger, "left_anti")


def overlap(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """The length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(x1, y1) - F.greatest(x0, y0))
