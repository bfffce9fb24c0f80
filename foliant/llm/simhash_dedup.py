"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `most` differing bits are linked; documents reachable over links form one component.
The 64 bits are grouped into m partitions, correlated bits together. Two fingerprints that differ in at most
`most` bits must, for thresholds t_i with sum(t_i + 1) = most + 1, differ in at most t_i bits of some partition
i. A dynamic program picks the t_i (-1: partition unused) that minimise probes plus estimated candidates, and
the cheapest m is taken. A row is written for each key that a fingerprint owns or probes; rows meet by key,
are verified on all 64 bits, and each key group gives a spanning forest of its links, not all its pairs.
Components come from alternating large-star and small-star rounds over DataFrames.

Null or blank texts have fingerprint zero, which is linked like any other; repeated rows stay; a null doc_id
gets its component, whose id is the smallest non-null doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import HOT, drawn, hot_join, rounds, sized, written

MOST = 4
SHINGLE = 4
#: Fingerprints from which bit correlations and candidate counts are estimated.
SAMPLE = 4000
#: Owners of a key beyond which its group is split into blocks over tasks.
BLOCK = 20_000
#: Row keys, of eight bytes each, that are broadcast at most.
GONE = 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 60_000):
        bits = np.unpackbits(hashes[at : at + 60_000].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: Column) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and more longs of every row."""
    wide = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    names = ["doc_id", "fp", *wide.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=names)

    return wide.mapInArrow(run, ", ".join(f"{n} long" for n in names))


# The plan: partitions and thresholds


def group_bits(fps: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size; each grows by the bit that correlates most with those it has."""
    bits = np.unpackbits(fps.view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float64)
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits**2).sum(axis=0))
    near = np.abs(bits.T @ bits) / np.maximum(np.outer(spread, spread), 1e-9)
    left, groups = list(range(64)), []
    for i in range(m):
        size = len(left) // (m - i)
        group = [left.pop(0)]
        while len(group) < size:
            group.append(left.pop(int(np.argmax(near[np.ix_(left, group)].sum(axis=1)))))
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def ball(width: int, radius: int) -> int:
    total, term = 1, 1
    for i in range(radius):
        term = term * (width - i) // (i + 1)
        total += term
    return total


def expected(fps: np.ndarray, bits: list[int], most: int) -> list[float]:
    """The share of pairs of fingerprints that differ in at most t of the bits, t from 0: seen in the sample where it is frequent enough, else as if bits were independent."""
    part = fps & np.uint64(mask_of(bits))
    seen = np.zeros(most + 1)
    for at in range(0, len(part), 500):
        apart = np.bitwise_count(part[at : at + 500, None] ^ part[None, :])
        seen += [(apart <= t).sum() for t in range(most + 1)]
    pairs = max(1, len(part) * (len(part) - 1))
    share = np.unpackbits(fps.view(np.uint8), bitorder="little").reshape(-1, 64).mean(axis=0)[bits] if len(fps) else np.full(len(bits), 0.5)
    law = np.zeros(most + 2)
    law[0] = 1
    for p in 2 * share * (1 - share):
        law[1:] = law[1:] * (1 - p) + law[:-1] * p
        law[0] *= 1 - p
    low = np.cumsum(law[: most + 1])
    return [float(max(low[t], (seen[t] - len(part)) / pairs if seen[t] - len(part) >= 20 else 0)) for t in range(most + 1)]


def sides(t: int) -> tuple[int, int]:
    """Radii of what the two sides of a pair enumerate, so that a part difference of t or less meets in a key."""
    return (t + 1) // 2, t // 2


def allocate(fps: np.ndarray, groups: list[list[int]], n: int, most: int) -> tuple[float, list[int]]:
    """Cost for each fingerprint and the thresholds, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        share, after = expected(fps, bits, most), {}
        for used, (cost, ts) in best.items():
            for t in range(-1, most - used + 1):
                own, probe = sides(t) if t >= 0 else (0, 0)
                more = 0 if t < 0 else ball(len(bits), own) + (ball(len(bits), probe) if probe else 1) + 0.02 * n * share[t]
                if (to := used + t + 1) <= most + 1 and (to not in after or cost + more < after[to][0]):
                    after[to] = (cost + more, [*ts, t])
        best = after
    return best[most + 1]


def plan(fps: np.ndarray, n: int, most: int = MOST) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is used."""
    found = []
    for m in range(1, most + 2):
        groups = group_bits(fps, m) if len(fps) > 1 else [list(range(i * 64 // m, (i + 1) * 64 // m)) for i in range(m)]
        cost, ts = allocate(fps, groups, n, most)
        found.append((cost, [(b, t) for b, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


# Keys and links


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keys(part: int, bits: list[int], t: int) -> list[Column]:
    """Arrays of (part, key, own) for a fingerprint: what it owns and what it probes in a partition."""
    at = F.col("fp").bitwiseAND(F.lit(signed(mask_of(bits))))
    ones = F.array(*[F.lit(signed(1 << b)) for b in bits])
    row = lambda key, own: F.struct(F.lit(part).alias("part"), key.alias("key"), F.lit(own).alias("own"))
    one = lambda own: F.transform(ones, lambda b: row(at.bitwiseXOR(b), own))
    pairs = F.array(*[F.lit(signed(1 << b | 1 << c)) for b, c in combinations(bits, 2)])
    two = lambda own: F.transform(pairs, lambda b: row(at.bitwiseXOR(b), own))
    out = [F.array(row(at, True))]
    if t == 1:  # of two keys a bit apart, one has it set
        out.append(F.transform(F.filter(ones, lambda b: F.col("fp").bitwiseAND(b) != 0), lambda b: row(at.bitwiseXOR(b), False)))
    elif t >= 2:
        own, _ = sides(t)
        out.append(one(True))
        if own >= 2:
            out.append(two(t == 4))
    return out


def forest(fps: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links between own and any member of one key group connect, at most one for each member."""
    left, right, rest, unseen = [], [], np.ones(len(fps), bool), np.ones(len(fps), bool)
    for seed in np.flatnonzero(own):
        if not unseen[seed]:
            continue
        unseen[seed] = rest[seed] = False
        queue = [seed]
        while queue:
            block, queue = queue[:256], queue[256:]
            open_ = np.flatnonzero(rest)
            if not len(open_):
                break
            close = np.bitwise_count(fps[block][:, None] ^ fps[open_][None, :]) <= most
            close &= own[block][:, None] | own[open_][None, :]
            hit = close.any(axis=0)
            left.append(fps[block][close.argmax(axis=0)[hit]])
            right.append(fps[open_[hit]])
            rest[open_[hit]] = unseen[open_[hit]] = False
            queue += list(open_[hit])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def linked(rows: DataFrame, most: int) -> DataFrame:
    """src, dst: links in each (part, key, block) group of rows that lie together and in order."""

    def solve(group: np.ndarray, fps: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(group)])
        left, right, small = [], [], np.repeat(sizes <= 32, sizes)
        for lag in range(1, min(32, int(sizes[sizes <= 32].max(initial=1)))):  # small groups: all pairs, without a loop over groups
            i = np.flatnonzero(small[:-lag] & (group[lag:] == group[:-lag]) & (own[lag:] | own[:-lag]))
            i = i[(fps[i] != fps[i + lag]) & (np.bitwise_count(fps[i] ^ fps[i + lag]) <= most)]
            left.append(fps[i])
            right.append(fps[i + lag])
        for at, size in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
            f, first = np.unique(fps[at : at + size], return_index=True)
            mine = np.zeros(len(f), bool)
            mine[np.searchsorted(f, fps[at : at + size][own[at : at + size]])] = True
            a, b = forest(f, mine, most)
            left.append(a)
            right.append(b)
        a, b = (np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = number = 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, key, block, fp, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])]
            new[0] = last != (part[0], key[0], block[0])
            group = number + np.cumsum(new)
            number, last = group[-1], (part[-1], key[-1], block[-1])
            if rows >= 200_000 and new.any():  # a whole number of groups goes
                cut = int(np.flatnonzero(new)[-1])
                held.append((group[:cut], fp[:cut].view(np.uint64), own[:cut].astype(bool)))
                yield solve(*map(np.concatenate, zip(*held, strict=True)))
                held, rows, group, fp, own = [], 0, group[cut:], fp[cut:], own[cut:]
            held.append((group, np.ascontiguousarray(fp).view(np.uint64), own.astype(bool)))
            rows += len(group)
        if held:
            yield solve(*map(np.concatenate, zip(*held, strict=True)))

    return rows.mapInArrow(run, "src long, dst long")


def links(fps: DataFrame, most: int = MOST, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """src < dst (as signed numbers): links between distinct fingerprints fp that have the components of all links."""
    n = fps.count()
    some = drawn(fps, sample, n, "fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts = plan(some, n, most)
    rows = fps.select("fp", F.explode(F.flatten(F.array(*[F.concat(*keys(i, bits, t)) for i, (bits, t) in enumerate(parts)]))).alias("k")).select("k.*", "fp")
    owned = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(mask_of(bits)))).alias("key")) for i, (bits, _) in enumerate(parts)])).alias("k")).select("k.*")
    if owned.groupBy("part", "key").count().filter(F.col("count") > block).isEmpty():
        plain = rows.select("part", "key", F.lit(0).alias("block"), "fp", "own")
        return linked(plain.repartition("part", "key").sortWithinPartitions("part", "key"), most)
    # Hot keys: each of a key's blocks of owners meets each of its blocks of members in a group of its own.
    salts = rows.groupBy("part", "key").agg(F.ceil(F.sum(F.col("own").cast("int")) / block).cast("int").alias("owners"), F.ceil(F.count("*") / block).cast("int").alias("members")).filter("owners > 1 or members > 1")
    cut = rows.join(salts, ["part", "key"], "left").select("part", "key", "fp", "own", F.coalesce("owners", F.lit(1)).alias("owners"), F.coalesce("members", F.lit(1)).alias("members"))
    mine = F.transform(F.sequence(F.lit(0), F.col("members") - 1), lambda j: F.struct((F.pmod(F.hash("fp"), "owners") * F.col("members") + j).alias("block"), F.lit(True).alias("own")))
    others = F.transform(F.sequence(F.lit(0), F.col("owners") - 1), lambda i: F.struct((i * F.col("members") + F.pmod(F.hash("fp", F.lit(1)), "members")).alias("block"), F.lit(False).alias("own")))
    dealt = cut.select("part", "key", "fp", F.explode(F.concat(F.when(F.col("own"), mine).otherwise(F.array().cast("array<struct<block:int,own:boolean>>")), others)).alias("b")).select("part", "key", "b.block", "fp", "b.own")
    return linked(dealt.repartition("part", "key", "block").sortWithinPartitions("part", "key", "block"), most)


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """node, root for each node of an edge: the smallest node it reaches. Alternating large-star and small-star rounds until nothing changes; each is written, and the one before deleted. The hub of a star may have most of the edges."""
    kept, mark = rounds(edges.sparkSession, "edges"), None
    now = kept(edges.select("src", "dst").filter("src <> dst").distinct())
    total = 2 * now.count()
    while True:
        both = now.union(now.select("dst", "src"))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = hot_join(both, low, ["src"], total, "inner", hot).filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = hot_join(large, low, ["src"], total, "inner", hot).select(F.explode(F.array(F.struct("dst", "m"), F.struct(F.col("src").alias("dst"), F.col("m")))).alias("e")).select(F.col("e.dst").alias("src"), F.col("e.m").alias("dst")).filter("src <> dst").distinct()
        now = kept(small)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(30,0)"))).first()
        total = 2 * mark[0]
        if mark == was:
            break
    roots = now.groupBy("src").agg(F.min("dst").alias("root")).withColumnRenamed("src", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, most: int = MOST, shingle: int = SHINGLE, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text)."""
    each = written(fingerprints(docs, shingle), "fingerprints")
    fps = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), most, block=block), hot)
    known = written(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = hot_join(known, least, ["root"], known.count(), "inner", hot).select("fp", "component_id")
    # A fingerprint of very many rows, such as that of blank texts, would be one task's share of a shuffle.
    return hot_join(each, named, ["fp"], each.count(), "inner", hot).select("doc_id", "fp", "component_id")


def row_key(docs: DataFrame) -> Column:
    """A key of a row's content, of two hashes of 64 bits, so that rows that differ have different keys among any number there can be. Nulls count, which a hash alone passes over; a map is the array of its entries, in order."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.array_sort(F.map_entries(c)) if kind.startswith("map<") else c for c, (_, kind) in zip(names, docs.dtypes, strict=True)]
    parts = [*plain, *[c.isNull() for c in names]]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("b"))


def keep_one(docs: DataFrame, most: int = MOST, shingle: int = SHINGLE, unnamed: bool = False) -> DataFrame:
    """One row of docs, all columns, for each component: of the smallest doc_id, then of the least row key. Rows without a doc_id come last in a component; they stay only if `unnamed`."""
    key = row_key(docs)
    each = written(fingerprints(docs, shingle, key["a"].alias("row_a"), key["b"].alias("row_b")).select("doc_id", "fp", F.struct(F.col("row_a").alias("a"), F.col("row_b").alias("b")).alias("row")), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    fps = written(each.groupBy("fp").agg(F.min(first).alias("best")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), most))
    best = fps.join(roots, fps["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp")).agg(F.min("best").alias("best")).select("best.*")
    chosen = (best if unnamed else best.filter("not unnamed")).select("row", F.lit(True).alias("chosen"))
    rows = written(each.groupBy("row").agg(F.count("*").alias("rows")).join(chosen, "row", "left"), "rows")
    # Texts need not move while the rows that go are few; beyond that both sides are shuffled by their keys.
    key = f"row_{uuid.uuid4().hex}"
    gone = sized(rows.filter("chosen is null").select(F.col("row").alias(key)), GONE)
    kept = docs.withColumn(key, row_key(docs)).join(gone, key, "left_anti")
    if not rows.filter("chosen and rows > 1").isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
