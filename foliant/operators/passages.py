"""Passages that a structured question lost, put back from its transcription, in the transcription's order."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.exams import recoverable_prose
from foliant.functions.text import SPACE, let, stripped, text_of
from foliant.operators.helpers import own

#: Windows by which a paragraph is found, the letters that one must have to count and to be put back, a box's mark.
WINDOW, STRIDE = 12, 6
LEAST, LOST = 8, 20
BOX = "<상자> "
MARKED = r"^\s*(<\s*(조건|보기|증명|상자)\s*>|\[\s*(조건|보기)\s*\])"


def key(x: Column) -> Column:
    """Letters and numbers in lower case."""
    return F.lower(F.regexp_replace(text_of(x), r"[^\p{L}\p{M}\p{N}]+", ""))


def paragraphs(transcription: Column) -> Column:
    """Paragraphs between blank lines; where there is one only, lines."""
    cut = lambda p: F.filter(F.transform(F.split(text_of(transcription), p), stripped), lambda x: x != "")
    return let(cut(rf"\n[{SPACE}]*\n"), lambda x: F.when(F.size(x) > 1, x).otherwise(cut("\n")))


def windows(x: str) -> list[str]:
    return [x[k : k + WINDOW] for k in range(0, max(len(x) - WINDOW, 0) + 1, STRIDE)] if x else []


def anchors(keys: list[str], blocks: list[str]) -> list[dict[int, int]]:
    """For each key the blocks in which its windows end, and how many of them."""
    hay, ends, out = "".join(blocks), [], []
    for b in blocks:
        ends.append((ends[-1] if ends else 0) + len(b))
    for k in keys:
        found: dict[int, int] = {}
        for w in windows(k) if len(k) >= LEAST else []:
            at, here = hay.find(w), set()
            while at >= 0:
                here.add(bisect_right(ends, at + len(w) - 1))
                at = hay.find(w, at + 1)
            for block in here:
                found[block] = found.get(block, 0) + 1
        out.append(found)
    return out


def chain(found: list[dict[int, int]]) -> list[int | None]:
    """For each key the block, or none, that is part of the heaviest chain of blocks that never falls, one of a key at most. A tree over the blocks has the heaviest chain up to each, so n anchors take n log n steps."""
    size = 1 + max((b for f in found for b in f), default=0)
    tree: list[tuple[int, int]] = [(0, -1)] * (size + 1)  # weight, last step
    steps: list[tuple[int, int, int]] = []  # key, block, step before

    def heaviest(block: int) -> tuple[int, int]:
        best, i = (0, -1), block + 1
        while i:
            best = max(best, tree[i], key=lambda x: x[0])
            i -= i & -i
        return best

    for k, f in enumerate(found):
        new = [(b, n, heaviest(b)) for b, n in sorted(f.items())]
        for b, n, (weight, before) in new:
            steps.append((k, b, before))
            i = b + 1
            while i <= size:
                tree[i] = max(tree[i], (weight + n, len(steps) - 1), key=lambda x: x[0])
                i += i & -i
    out: list[int | None] = [None] * len(found)
    step = heaviest(size - 1)[1]
    while step >= 0:
        k, b, step = steps[step]
        out[k] = b
    return out


def places(keys: list[str], blocks: list[str]) -> list[int | None]:
    """Before which block each key that is in none of them belongs: after the block of the last key before it that is in its order. None for keys that are there, or too short."""
    found = anchors(keys, blocks)
    out, pointer = [], 0
    for k, numbers, kept in zip(keys, found, chain(found), strict=True):
        pointer = pointer if kept is None else kept + 1
        out.append(None if numbers or len(k) < LOST else pointer)
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _places(keys: pa.Array, blocks: pa.Array) -> pa.Array:
    return pa.array([places(k or [], [x or "" for x in b or []]) for k, b in zip(keys.to_pylist(), blocks.to_pylist(), strict=True)], pa.list_(pa.int32()))


def restored(rows: DataFrame, contents: str, transcription: str, name: str) -> DataFrame:
    """rows with a column more: an array of texts with the long prose paragraphs of a transcription that none of them holds, as boxes, where the transcription has them. Nothing is put into an empty array, nor where no text has a letter."""
    lost, keys, at, put = map(own, ("lost", "keys", "at", "put"))
    marked = lambda p: F.when(p.rlike(MARKED), p).otherwise(F.concat(F.lit(BOX), p))
    ready = rows.withColumns({lost: F.transform(paragraphs(F.col(transcription)), lambda p: F.struct(p.alias("text"), key(p).alias("key"))), keys: F.transform(contents, key)})
    found = ready.withColumn(at, _places(F.transform(lost, lambda p: p["key"]), F.col(keys)))
    texts = F.transform(F.arrays_zip(F.col(lost).alias("lost"), F.col(at).alias("at")), lambda z: F.struct(F.when(recoverable_prose(z["lost"]["text"]), z["at"]).alias("at"), marked(z["lost"]["text"]).alias("text")))
    before = lambda i: F.transform(F.filter(put, lambda t: t["at"] == i), lambda t: t["text"])
    whole = F.concat(F.flatten(F.transform(contents, lambda c, i: F.concat(before(i), F.array(c)))), before(F.size(contents)))
    return found.withColumn(put, texts).withColumn(name, F.when((F.size(contents) > 0) & (F.array_join(keys, "") != ""), whole).otherwise(F.col(contents))).drop(lost, keys, at, put)
