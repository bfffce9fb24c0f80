"""Secret scans: patterns of known secrets, and character Markov models that tell random strings from identifiers.

All in DataFrame functions. Three patterns give the base spans. Long runs of secret-like characters outside them
are scored by two character bigram models, one of random strings and one of ordinary identifiers, both counted by
Spark from labelled samples and smoothed; a run whose log-likelihood ratio for each character, and in total, is
high enough becomes a span of kind `markov`. The models are 2 x 65 x 65 numbers, whatever the samples' size.

All work on a text grows as its length, and with its spans as their number times its root. Positions are code
points, end exclusive. Null texts have no spans, as empty ones; repeated rows stay; other columns
of the input are kept beside the results by `redact`, and `scan` returns its own columns only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import drawn

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
#: Runs are whole, so that a least length in the pattern equals dropping shorter runs afterwards.
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
#: What the models judge: whole runs of these characters, 20 or more.
RUN = r"((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+)"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = {"assign": 1, "access": 2, "hex": 3, "markov": 4}
#: Least log-likelihood ratio: of a character's mean, and in total.
MEAN, TOTAL = 0.5, 12.0
#: Documents whose words are the sample of ordinary identifiers, and generated random strings.
IDENTIFIER_DOCS, RANDOM_STRINGS = 300, 1500
#: First characters of such a document that are looked at.
IDENTIFIER_CHARS = 2000

Spans = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each of the items, state by state: in blocks of about the root of their number, so that appending copies short arrays only."""

    def inner(last: Column, block: Column) -> Column:
        start = F.struct(last.alias("last"), F.array().cast("array<int>").alias("states"))
        return F.aggregate(block, start, lambda a, x: let(step(a["last"], x), lambda s: F.struct(s.alias("last"), F.array_append(a["states"], s).alias("states"))))

    def outer(acc: Column, block: Column) -> Column:
        return let(inner(acc["last"], block), lambda b: F.struct(b["last"].alias("last"), F.array_append(acc["blocks"], b["states"]).alias("blocks")))

    def whole(items: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / size).cast("int") - 1), lambda k: F.slice(items, k * size + 1, size))
        start = F.struct(zero.alias("last"), F.array().cast("array<array<int>>").alias("blocks"))
        return F.when(F.size(items) > 0, F.flatten(F.aggregate(blocks, start, outer)["blocks"])).otherwise(F.array().cast("array<int>"))

    return let(items, whole)


def spans(text: Column, pattern: str, kind: str, group: int = 1, least: int = 1) -> Column:
    """The spans of a pattern's matches, whose group has `least` characters or more: lengths of matches and of what lies between add up to places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
    both = F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("match"), F.transform(value, F.length).alias("value"))
    ends = lambda m: running(F.transform(m, lambda x: x["gap"] + x["match"]), F.lit(0), lambda at, n: at + n)
    span = lambda x, end: F.when(x["value"] >= least, F.struct((end - x["match"]).alias("start"), F.lit(KINDS[kind]).alias("kind"), end.alias("end")))
    return F.when(F.regexp_like(text, F.lit(pattern)), let(both, lambda m: F.filter(F.zip_with(m, ends(m), span), lambda x: x.isNotNull()))).otherwise(F.array().cast(Spans))


def joined(all_spans: Column) -> Column:
    """kind:start:end, in order of start, then kind, joined by commas."""
    name = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(v), F.lit(k))])
    return F.array_join(F.transform(F.array_sort(all_spans), lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


# The models


def labelled_samples(docs: DataFrame, most_docs: int = IDENTIFIER_DOCS, most_random: int = RANDOM_STRINGS) -> DataFrame:
    """token, random: seeded random strings in hexadecimal, base 64 and capitals, and words and joined words of a bounded, seeded sample of the documents as identifiers."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    forms = [F.substring(digest, 1, 40), F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "=+$", ""), 1, 40), F.substring(F.translate(F.base64(F.unhex(digest)), "abcdefghijklmnopqrstuvwxyz+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234"), 1, 20)]
    random = spark.range(most_random).select(F.explode(F.array(*forms)).alias("token"), F.lit(True).alias("random"))
    some = drawn(docs.select("doc_id", F.substring("text", 1, IDENTIFIER_CHARS).alias("text")), most_docs, docs.count(), "doc_id", "text").filter("text is not null")
    words = some.select(F.regexp_extract_all("text", F.lit("([A-Za-z][a-z]+)"), F.lit(1)).alias("words"))
    pairs = words.select(F.explode(F.arrays_zip(F.col("words").alias("w"), F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))).alias("next"))).alias("p")).select(F.col("p.w"), F.coalesce("p.next", F.lit("")).alias("next"))
    forms = F.array(F.lower("w"), F.concat_ws("_", F.lower("w"), F.lower("next")), F.concat(F.lower("w"), F.initcap("next")))
    return random.union(pairs.select(F.explode(forms).alias("token"), F.lit(False).alias("random")))


def model(samples: DataFrame, smooth: float = 0.5, lean: float = 10.0) -> list[list[float]]:
    """The log-likelihood ratio of random strings to identifiers of each character after each, from labelled tokens (token, random). Seldom seen pairs lean on how often the second character follows any."""
    pair = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, 2))
    pairs = samples.filter(F.length("token") > 1).select("random", F.explode(pair).alias("p")).filter(F.col("p").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    seen = {(r["random"], r["p"]): r["count"] for r in pairs.groupBy("random", "p").count().collect()}
    chance = {}
    for kind in (True, False):
        after = {b: sum(seen.get((kind, a + b), 0) for a in LETTERS) + smooth for b in LETTERS}
        whole = sum(after.values())
        for a in LETTERS:
            row = sum(seen.get((kind, a + b), 0) for b in LETTERS)
            chance |= {(kind, a, b): (seen.get((kind, a + b), 0) + lean * after[b] / whole) / (row + lean) for b in LETTERS}
    return [[round(math.log(chance[True, a, b] / chance[False, a, b]), 6) for b in LETTERS] for a in LETTERS]


def ratio(token: Column, table: list[list[float]]) -> Column:
    """The log-likelihood ratio of a token: the sum over its neighbouring characters."""
    flat = F.from_json(F.lit("[" + ",".join(str(x) for row in table for x in row) + "]"), "array<double>")
    places = F.from_json(F.lit("[" + ",".join(str(LETTERS.find(chr(c))) for c in range(128)) + "]"), "array<int>")
    codes = F.transform(F.split(token, ""), lambda c: F.element_at(places, F.ascii(c) + 1))
    pair = lambda a, b: F.element_at(flat, a * len(LETTERS) + b + 1)
    return let(codes, lambda c: F.aggregate(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), pair), F.lit(0.0), lambda acc, x: acc + x))


def random_runs(tokens: Column, places: Column, base: Column, table: list[list[float]], mean: float = MEAN, total: float = TOTAL) -> Column:
    """Spans of the runs that the models call random and no base span overlaps. Runs never overlap each other: in order of start, one is clear if all before it end where it starts, and the next starts where it ends."""
    judged = F.transform(F.arrays_zip(tokens.alias("token"), places.alias("s")), lambda x: F.struct(x["s"].alias("s"), F.length(x["token"]).alias("n"), ratio(x["token"], table).alias("llr")))
    high = F.transform(F.filter(judged, lambda j: (j["llr"] >= total) & (j["llr"] >= mean * j["n"])), lambda j: j["s"])

    def clear(both: Column) -> Column:
        reach = running(F.transform(both, lambda x: x["end"]), F.lit(0), F.greatest)
        alone = lambda far: F.transform(both, lambda x, i: F.when((x["kind"] == KINDS["markov"]) & (x["start"] >= F.when(i > 0, F.get(far, i - 1)).otherwise(0)) & (F.coalesce(F.get(both, i + 1)["start"], x["end"]) >= x["end"]), x))
        return F.filter(let(reach, alone), lambda x: x.isNotNull())

    return let(high, lambda h: F.when((F.size(h) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(h, base)), clear)).otherwise(h))


def with_spans(docs: DataFrame, table: list[list[float]], *keep: str) -> DataFrame:
    """row (`keep` of docs), text, and assign, access, hex, base, markov: arrays of spans."""
    text, none = F.col("text"), F.array().cast(Spans)
    whole = docs.select(F.struct(*[F.col(f"`{n}`") for n in keep]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = whole.select("*", spans(text, ASSIGN, "assign", 2, 12).alias("assign"), spans(text, ACCESS, "access").alias("access"), spans(text, HEX, "hex").alias("hex"), F.regexp_extract_all(text, F.lit(RUN), F.lit(1)).alias("runs"))
    places = F.when(F.size("runs") > 0, spans(text, RUN, "markov")).otherwise(none)
    placed = found.select("*", places.alias("places"), F.concat("assign", "access", "hex").alias("base"))
    kept = F.when(F.size("runs") > 0, random_runs(F.col("runs"), F.col("places"), F.col("base"), table)).otherwise(none)
    return placed.select("row", "text", "assign", "access", "hex", "base", kept.alias("markov"))


def scan(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of every row of docs (doc_id, text)."""
    table = model(labelled_samples(docs) if samples is None else samples)
    got = with_spans(docs, table, "doc_id")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return got.select(F.col("row.doc_id").cast("long").alias("doc_id"), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "markov")).alias("spans"))


def redact(docs: DataFrame, samples: DataFrame | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns, with each run of overlapping spans in text replaced by the mark. Null texts stay null."""
    table = model(labelled_samples(docs) if samples is None else samples)
    got = with_spans(docs, table, *docs.columns).select("row", "text", F.array_sort(F.concat("base", "markov")).alias("spans"), (F.length("text") == F.octet_length("text")).alias("plain"))
    some = F.size("spans") > 0
    # Bytes are cut in the time of what is cut, code points are not: texts beyond ASCII are cut as arrays of code points.
    letters = F.when(some & ~F.col("plain"), F.split("text", "")).otherwise(F.array().cast("array<string>"))
    placed = got.select("*", letters.alias("letters"), F.when(some, running(F.transform("spans", lambda x: x["end"]), F.lit(0), F.greatest)).alias("reach"))

    def done(raw: Column) -> Column:
        def piece(start: Column, size: Column) -> Column:
            return F.when(F.col("plain"), F.substring(raw, start + 1, size).cast("string")).otherwise(F.array_join(F.slice("letters", start + 1, size), ""))

        def before(x: Column, i: Column) -> Column:
            return let(F.when(i > 0, F.get("reach", i - 1)).otherwise(0), lambda at: F.when(x["start"] >= at, F.concat(piece(at, x["start"] - at), F.lit(mark))).otherwise(""))

        rest = piece(F.element_at("reach", -1), F.when(F.col("plain"), F.octet_length(raw)).otherwise(F.size("letters")) - F.element_at("reach", -1))
        return F.concat(F.array_join(F.transform("spans", before), ""), rest)

    text = F.col("row").getField("text")
    clean = F.when(text.isNotNull() & some, let(F.col("text").cast("binary"), done)).otherwise(text)
    return placed.select(*[(clean if n == "text" else F.col("row").getField(n)).alias(n) for n in docs.columns])
