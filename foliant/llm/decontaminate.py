"""Benchmark decontamination: passages within an edit distance of a benchmark item.

Texts are sequences of words, lower-cased and without punctuation at their ends. A document holds an item of n
words if some run of its words has a word edit distance of at most floor(n / 5) to it (similarity 0.8 or more).

The method: a CGK random walk embeds a window of words: at each step the walk writes the word it stands on and stays or
moves on by a random bit of word and step, so that an edit costs a walk a few steps until it is back in line.
Bit-sampling LSH hashes a few positions of the walk; that is repeated with other walks and positions until the target
recall is reached. How often is measured for each window size and number of edits, on edited random windows of either
kind of edit. Windows are as long as the item; but an edit in every fifth word leaves the walks of a long item hardly a
common step, so an item for which more than `MOST` walks were needed is cut into the fewest windows that need no more:
of p windows one has at most every p-th of the item's edits. With as many windows as edits and one, some window has none.

Every run of a window's words in a document is a window too, cut off at the document's end. Before the walk, those are
left out that have fewer word pairs of items than a match must have. Windows of items and documents that collide are
candidates, each (document, item, place) once; those go that hold fewer of the item's words than a window of a match
must, then those around whose place fewer of them stand than a match must have, and the others are verified by the exact
edit distance of the whole item. No filter loses a match.

Null and blank texts hold nothing, and neither does any text an item without words. Items of fewer than five words
allow no edit, so an item of one word is held by every text with that word. Copies of an item match alike. Items come to
the driver block by block, a stated query set; documents are scanned once for each block, there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import enough_near, pieces, split_words, written

#: Edits allowed: one in so many words.
ONE_IN = 5
#: Chance that a match is found, positions of a walk that make a hash, and walks at most for one window size.
TARGET, BITS, MOST = 0.99, 3, 50
#: Window sizes that are tried.
SIZES = [*range(1, 13), 14, 16, 19]
#: Edited windows and walks from which the chance of a collision is measured.
TRIALS, WALKS = 600, 120
#: Items in one index, and hashes in it (24 bytes each), but for a single item with more; more take more scans.
ITEMS, HASHES = 20_000, 4_000_000
#: Collisions that are held before those of one place are made one.
HITS = 4_000_000
#: Punctuation that is cut from the ends of words.
ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„‚…–—¿¡"
def bare(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=ENDS)


def distances(pattern: list[int], text: list[int]) -> list[int]:
    """The edit distance of the pattern to the nearest run that ends after each word of the text (Myers' bit vectors)."""
    n, at = len(pattern), {}
    for i, x in enumerate(pattern):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, out = full, 0, n, []
    for x in text:
        eq = at.get(x, 0)
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(d | plus)), d & plus
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(d | up)), d & up
        out.append(score)
    return out


def nearest(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the run of the text that is nearest to the item, leftmost among equals; None beyond `most`."""
    ends = distances(item, text)
    if not ends or (low := min(ends)) > most:
        return None
    end = ends.index(low) + 1
    back = distances(item[::-1], text[:end][::-1])
    return low, end - 1 - max(i for i, d in enumerate(back) if d == low), end


def flipped(words: int, walks: int) -> np.ndarray:
    """For each walk and word the random bits of up to 63 steps, as one number."""
    return np.random.default_rng(7).integers(0, 1 << 63, (walks, words + 1), dtype=np.int64)


class Walks:
    """CGK walks over windows of one size: the positions of each that make its hash."""

    def __init__(self, size: int, repeats: int, bits: int = BITS):
        rng = np.random.default_rng([11, size])
        picks = [np.sort(rng.choice(2 * size, min(bits, 2 * size), replace=False)).tolist() for _ in range(repeats)]
        self.picks = [{x: int(rng.integers(1, 1 << 62)) | 1 for x in p} for p in picks]

    def hashes(self, coins: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """For each repeat the hashes of the windows words[start:end], as if zeros followed. coins: a row for each repeat, more are not used."""
        for bits, picked in zip(coins, self.picks, strict=False):
            at, out = starts.copy(), np.zeros(len(starts), np.int64)
            for step in range(max(picked) + 1):
                word = np.where(at < ends, words[np.minimum(at, len(words) - 1)], 0)
                if step in picked:
                    out = (out ^ (word + 1)) * picked[step]
                    out ^= out >> 29
                at += bits[word] >> step & 1
            yield out


@cache
def collisions(size: int, edits: int, bits: int = BITS) -> np.ndarray:
    """Shares of walks that collide, of windows and their edited twins: a row for changed, left out and put in words each."""
    rng = np.random.default_rng([5, size, edits])
    plain = np.arange(1, TRIALS * size + 1).reshape(TRIALS, size)
    other, rows = iter(range(TRIALS * size + 1, 1 << 40)), []
    for kind in range(3):
        for row in plain.tolist():
            out = [[w] for w in row]
            for i in rng.choice(size, edits, replace=False):
                out[i] = [[next(other)], [], [next(other), row[i]]][kind]
            flat = [w for x in out for w in x]
            rows.append([*flat, *(next(other) for _ in range(size - len(flat)))][:size])
    walks, coins = Walks(size, WALKS, bits), flipped(next(other), WALKS)
    starts = np.arange(TRIALS) * size
    same = np.zeros((3, TRIALS))
    edited = np.array(rows).ravel()
    for a, b in zip(walks.hashes(coins, plain.ravel(), starts, starts + size), walks.hashes(coins, edited, np.arange(3 * TRIALS) * size, (np.arange(3 * TRIALS) + 1) * size), strict=True):
        same += a == b.reshape(3, TRIALS)
    return same / WALKS


def repeats_for(size: int, edits: int, bits: int = BITS, target: float = TARGET, most: int = MOST) -> int | None:
    """The least number of walks that find edited windows with the target recall, whatever the kind of edit; None beyond `most`."""
    if not edits:
        return 1
    miss = 1 - collisions(size, edits, bits)
    return next((r for r in range(1, most + 1) if (1 - miss**r).mean(axis=1).min() >= target), None)


@cache
def windows_of(n: int, bits: int = BITS) -> tuple[int, int, int, list[int]]:
    """Size, edits, repeats and offsets of the windows that stand for an item of n words; none overlap."""
    edits = n // ONE_IN
    for parts in range(1, edits + 2):
        size, some = max(x for x in SIZES if x <= n // parts), edits // parts
        if n // parts < 2 * size and (repeats := repeats_for(size, some, bits)):
            return size, some, repeats, [i * n // parts for i in range(parts)]
    raise ValueError(n)


@dataclass
class Index:
    """Items, and their windows' hashes."""

    ids: list[int]
    items: list[list[int]] = field(default_factory=list)
    words: dict[str, int] = field(default_factory=dict)
    pairs: np.ndarray | None = None
    #: (item, word) of the words that an item has, as sorted numbers
    members: np.ndarray | None = None
    #: the bits of the walks, which windows of all sizes share
    coins: np.ndarray | None = None
    #: size and edits: the walks, and for each repeat the sorted hashes, and each hash's item and offset
    tables: dict[tuple[int, int], tuple[Walks, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = field(default_factory=dict)


def build(rows: list[tuple[int, str | None]], bits: int = BITS) -> Index:
    """The index of (item_id, text) rows."""
    words, owner = split_words(pa.array([t for _, t in rows], pa.string()))
    lists: list[list[str]] = [[] for _ in rows]
    for k, w in zip(owner.tolist(), bare(words).to_pylist(), strict=True):
        lists[k] += [w] if w else []
    kept = [(i, w) for (i, _), w in zip(rows, lists, strict=True) if w]
    index = Index([i for i, _ in kept])
    for _, w in kept:
        index.items.append([index.words.setdefault(x, len(index.words) + 1) for x in w])
    index.pairs = np.zeros(1 << 22, bool)
    for w in index.items:
        index.pairs[pair_slot(np.array(w[:-1], np.int64), np.array(w[1:], np.int64))] = True
    index.members = np.unique(np.array([k * (len(index.words) + 1) + x for k, w in enumerate(index.items) for x in set(w)], np.int64))
    by_kind: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    for k, w in enumerate(index.items):
        size, edits, repeats, offsets = windows_of(len(w), bits)
        by_kind.setdefault((size, edits), (repeats, []))[1].extend((k, o) for o in offsets)
    index.coins = flipped(len(index.words), max((r for r, _ in by_kind.values()), default=0))
    for (size, edits), (repeats, places) in by_kind.items():
        words = np.array([x for k, o in places for x in index.items[k][o : o + size]], np.int64)
        starts, tables = np.arange(len(places)) * size, []
        walks = Walks(size, repeats, bits)
        who, offset = (np.array(x, np.int64) for x in zip(*places, strict=True))
        for h in walks.hashes(index.coins, words, starts, starts + size):
            o = np.argsort(h, kind="stable")
            tables.append((h[o], who[o], offset[o]))
        index.tables[size, edits] = walks, tables
    return index


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 1_000_003 + b) & ((1 << 22) - 1)


def aligned(words: np.ndarray, p: np.ndarray, last: np.ndarray, item: np.ndarray, members: np.ndarray, width: int, size: int, edits: int, at_once: int = 100_000) -> np.ndarray:
    """Which windows that begin at p may be the item's: with their edits they hold all words of an item's window but `edits`. members: item * width + word, sorted."""
    out = np.zeros(len(p), bool)
    for lo in range(0, len(p), at_once):
        at = p[lo : lo + at_once, None] + np.arange(size + edits)
        key = item[lo : lo + at_once, None] * width + words[np.minimum(at, len(words) - 1)]
        held = members[np.minimum(np.searchsorted(members, key), len(members) - 1)] == key
        out[lo : lo + at_once] = (held & (at < last[lo : lo + at_once, None])).sum(axis=1) >= size - edits
    return out


def candidates(index: Index, words: np.ndarray, owner: np.ndarray) -> set[tuple[int, int, int]]:
    """(document, item, place): where windows of documents collide with windows of items, and enough of the item's words are near. Places are of the item's first word."""
    found: set[tuple[int, int, int]] = set()
    if not len(words):
        return found
    known = words > 0
    both = np.zeros(len(words), np.int32)
    both[:-1] = known[:-1] & known[1:] & (owner[:-1] == owner[1:])
    at = np.flatnonzero(both)
    both[at] = index.pairs[pair_slot(words[at], words[at + 1])]
    sums = np.concatenate([[0], np.cumsum(both, dtype=np.int32)])
    first, last = (np.searchsorted(owner, np.arange(owner[-1] + 1), side=side) for side in ("left", "right"))
    sizes = np.fromiter(map(len, index.items), np.int64, len(index.items))
    longest = int(sizes.max(initial=0))
    span = len(words) + longest
    for (size, edits), (walks, tables) in index.tables.items():
        ends = np.minimum(np.arange(len(words)) + size, last[owner])
        need = size - 1 - 2 * edits
        starts = np.flatnonzero(sums[ends - 1] - sums[: len(words)] >= need if need > 0 else known)
        found_at: list[np.ndarray] = []
        for at in range(0, len(starts), 50_000):
            block = starts[at : at + 50_000]
            for h, (keys, who, offset) in zip(walks.hashes(index.coins, words, block, ends[block]), tables, strict=True):
                lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                hit = np.flatnonzero(hi > lo)
                if not len(hit):
                    continue
                n = (hi - lo)[hit]
                k = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p = np.repeat(block[hit], n)
                some = aligned(words, p, last[owner[p]], who[k], index.members, len(index.words) + 1, size, edits)
                k, p = k[some], p[some]
                # One number for (document, item, place): walks and windows of one match give the same few.
                found_at.append((owner[p] * len(sizes) + who[k]) * span + p - offset[k] + longest)
                if sum(map(len, found_at)) > HITS:
                    found_at = [np.unique(np.concatenate(found_at))]
        key = np.unique(np.concatenate(found_at)) if found_at else np.zeros(0, np.int64)
        doc, item, place = key // span // len(sizes), key // span % len(sizes), key % span - longest
        n, most = sizes[item], sizes[item] // ONE_IN
        some = enough_near(words, np.maximum(first[doc], place - most), np.minimum(last[doc], place + n + most), item, index.members, len(index.words) + 1, most)
        found.update(zip(doc[some].tolist(), item[some].tolist(), place[some].tolist(), strict=True))
    return found


def matches(index: Index, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(document, item_id, start, end, distance) for each text and each item that it holds; of several runs the nearest, then the first."""
    flat, owner = split_words(texts)
    coded = flat.dictionary_encode()
    if not len(flat) or not index.words:
        return []
    distinct = bare(coded.dictionary)
    number = pc.fill_null(pc.add(pc.index_in(distinct, pa.array(index.words, distinct.type)), 1), 0).to_numpy().astype(np.int64)
    number[pc.equal(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)] = -1
    words = number[coded.indices.to_numpy()]
    words, owner = words[words >= 0], owner[words >= 0]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for doc, k, place in sorted(candidates(index, words, owner)):
        item = index.items[k]
        most = len(item) // ONE_IN
        if done.get((doc, k), -1) >= place:
            continue
        done[doc, k] = place + most  # its neighbourhood is covered by the run below
        first, end = np.searchsorted(owner, doc), np.searchsorted(owner, doc, side="right")
        lo, hi = max(first, place - 2 * most), min(end, place + len(item) + 3 * most + 1)
        if lo < hi and (got := nearest(item, words[lo:hi].tolist(), most)):
            now = got[0], int(lo - first) + got[1], int(lo - first) + got[2]
            best[doc, k] = min(best.get((doc, k), now), now)
    return [(doc, index.ids[k], start, end, d) for (doc, k), (d, start, end) in best.items()]


def blocks(rows: Iterable[tuple[int, str | None]], items: int = ITEMS, hashes: int = HASHES) -> Iterator[list[tuple[int, str | None]]]:
    """The rows in blocks of a bounded number of items and of hashes that their windows make; a block at least."""
    block, held = [], 0
    for row in rows:
        n = len((row[1] or "").split())
        _, _, repeats, offsets = windows_of(n) if n else (0, 0, 0, [])
        if block and (len(block) == items or held + repeats * len(offsets) > hashes):
            yield block
            block, held = [], 0
        block.append(row)
        held += repeats * len(offsets)
    yield block


def indexes(benchmark: DataFrame, items: int = ITEMS) -> Iterator[tuple[Broadcast, bool]]:
    """A broadcast index of each block of items, and whether it is the last. One block at a time is held; the one before is let go."""
    cut = blocks(((r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()), items)
    block = next(cut)
    while True:
        after = next(cut, None)
        index = benchmark.sparkSession.sparkContext.broadcast(build(block))
        yield index, after is None
        if after is None:
            return
        index.unpersist()
        block = after


def leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, start, end (words of the text, end exclusive), distance for each document row and item it holds."""
    parts = []
    for index, last in indexes(benchmark, items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                got = matches(index.value, batch.column(1))
                doc, item, start, end, distance = zip(*got, strict=True) if got else [()] * 5
                ids = batch.column(0).take(pa.array(doc, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (item, start, end, distance))], names=["doc_id", "item_id", "start", "end", "distance"])

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, start long, end long, distance long")
        parts.append(found if last else written(found, "leaks"))
    return reduce(DataFrame.union, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item."""
    at = docs.columns.index("text")
    for index, last in indexes(benchmark, items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                held = {doc for doc, *_ in matches(index.value, batch.column(at))}
                yield batch.filter(pa.array([i not in held for i in range(batch.num_rows)], pa.bool_()))

        kept = docs.mapInArrow(run, docs.schema)
        docs = kept if last else written(kept, "without-leaks")
    return docs
