"""URL filters: rules for hosts and paths, and beyond them a tree of path templates judged by labelled purity.

All in DataFrame functions. A url's path is cut into segments; runs of digits in a segment become `#` and long
hexadecimal names `{hex}` at once. Then, level by level as deep as paths part, for each host and parent those children are merged into the wildcard `*` whose
labelled purity does not differ from their siblings' by more than chance allows. Among many children, those of few urls
are compared with each other, and one of so many must differ the more to stand alone; children of many urls are judged
by their own labels, whatever their siblings' number. A template's purity is its share of good
labelled urls, smoothed toward its host's, which is smoothed toward that of all; a purity far below that of all blocks.

Counts are aggregated to (host, path shape) before anything is joined, so a host with a third of all urls is a few
rows where its paths have few shapes. Null urls and those without `://` have empty host and path; they form a
template of their own like any other. Repeated rows stay. Without labels the purity of all is taken as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import HOT, hot_join, rounds, sized, written

#: Verdict and rule (host, path) as the contract has them.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Levels that the SQL twin writes out; the tree here grows as deep as paths part.
DEPTH = 6
#: A parent with so many children, or more, has variable ones: those of fewer urls than this.
CHILDREN, URLS = 16, 8
#: The chance, over all of a parent's children, that one of the variable ones stands alone though it is like the others.
ERROR = 0.05
#: Standard deviations by which a branch must differ from its siblings to stand alone.
APART = 2.0
#: Labelled urls that a host's, or everyone's, purity counts as; and the part of everyone's purity below which a template is rejected.
STRENGTH, LEAST = 10.0, 0.7

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, name in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked last, and so first
        domain, slash, rest = name.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """The path's segments with digits and hexadecimal names generalised."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike(r"\A[0-9a-f]{12,}\z") & s.rlike("[a-f]"), F.lit("{hex}")).otherwise(F.regexp_replace(s, "[0-9]+", "#")))


def generalised(shapes: DataFrame, level: int, hot: int = HOT) -> DataFrame:
    """shapes (host, shape, template, n, labelled, good) with the template's segment at `level` merged where its siblings are like it."""
    total = shapes.count()
    deep = shapes.filter(F.size("template") >= level)
    parent = F.slice("template", 1, level - 1)
    node = deep.groupBy("host", parent.alias("parent"), F.element_at("template", level).alias("child")).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "good")])
    few = F.col("n") < URLS
    family = node.groupBy("host", "parent").agg(F.count("*").alias("children"), F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"), *[F.coalesce(F.sum(F.when(few, F.col(c))), F.lit(0)).alias(f"few_{c}") for c in ("labelled", "good")])
    many = F.col("children") >= CHILDREN
    p = F.col("all_good") / F.greatest("all_labelled", F.lit(1))
    # The rest of a large family is what is left of it: a child with most of its labels must not set its own standard.
    rest = F.when(many, 1 - F.col("labelled") / F.greatest("all_labelled", F.lit(1))).otherwise(F.lit(1.0))
    alike = F.pow(F.col("good") - F.col("labelled") * p, 2) <= APART * APART * F.col("labelled") * (p * (1 - p) + 1e-9) * rest + 1e-9
    # Chernoff's bound of the chance that a child of few urls has its labels as one of its kind, times the number of children.
    q = F.least(F.greatest(F.col("few_good") / F.greatest("few_labelled", F.lit(1)), F.lit(1e-9)), F.lit(1 - 1e-9))
    bad, share = F.col("labelled") - F.col("good"), F.col("good") / F.greatest("labelled", F.lit(1))
    apart = F.when(F.col("good") > 0, F.col("good") * F.log(share / q)).otherwise(0.0) + F.when(bad > 0, bad * F.log((1 - share) / (1 - q))).otherwise(0.0)
    variable = F.exp(-apart) * F.col("children") >= ERROR
    merged = hot_join(node, family, ["host", "parent"], total, "inner", hot).filter((F.col("children") > 1) & F.when(many & few, variable).otherwise(alike)).select("host", "parent", "child", F.lit(True).alias("merged"))
    keyed = hot_join(deep.select("*", parent.alias("parent"), F.element_at("template", level).alias("child")), merged, ["host", "parent", "child"], total, "left", hot)
    star = F.concat("parent", F.array(F.when(F.col("merged"), F.lit("*")).otherwise(F.col("child"))), F.slice(F.col("template"), level + 1, F.size("template")))
    return keyed.select("host", "shape", star.alias("template"), "n", "labelled", "good").union(shapes.filter(F.size("template") < level))


def templates(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """host, shape, template, n, labelled, good of each host and path shape. urls: host, path. labels: host, path, good (boolean)."""
    counted = urls.select("host", shape_of(F.col("path")).alias("shape"), F.lit(1).alias("n"), F.lit(0).alias("labelled"), F.lit(0).alias("good"))
    marked = labels.filter("good is not null").select("host", shape_of(F.col("path")).alias("shape"), F.lit(0), F.lit(1), F.col("good").cast("int"))
    shapes = counted.union(marked).groupBy("host", "shape").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "good")]).withColumn("template", F.col("shape")).select("host", "shape", "template", "n", "labelled", "good")
    kept, level = rounds(shapes.sparkSession, "url-templates"), 1
    shapes = kept(shapes)
    # Below a parent of one shape nothing parts.
    while not shapes.filter(F.size("template") >= level).groupBy("host", F.slice("template", 1, level - 1)).count().filter("count > 1").isEmpty():
        shapes, level = kept(generalised(shapes, level)), level + 1
    return shapes


def purity(shapes: DataFrame, strength: float = STRENGTH, hot: int = HOT) -> DataFrame:
    """host, shape, template, purity, everyone: the template's smoothed share of good labelled urls, and that of all."""
    total = shapes.count()
    good, known = shapes.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    everyone = F.lit((good + 1.0) / (known + 1.0))
    host = shapes.groupBy("host").agg(((F.sum("good") + strength * everyone) / (F.sum("labelled") + strength)).alias("host_purity"))
    each = hot_join(shapes.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("labelled").alias("l")), host, ["host"], total, "inner", hot)
    each = each.select("host", "template", ((F.col("g") + strength * F.col("host_purity")) / (F.col("l") + strength)).alias("purity"))
    return hot_join(shapes.select("host", "shape", "template"), each, ["host", "template"], total, "inner", hot).select("host", "shape", "template", "purity", everyone.alias("everyone"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of pages (page_id, url). labels: url, good (boolean) of known urls. Where no rule decides, templates go whose purity is below `least` of everyone's, whatever share of all is good."""
    url = F.col("url").cast("string")
    urls = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = labels.select(host_of(url).alias("host"), path_of(url).alias("path"), F.col("good").cast("boolean"))
    table = written(purity(templates(urls, known)), "url-purity")
    rule, says = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    found = hot_join(urls.withColumn("shape", shape_of(F.col("path"))), sized(table), ["host", "shape"], urls.count())
    method = F.when(F.col("purity") < least * F.col("everyone"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.round("purity", 9).alias("purity"))
