"""Fill-in-middle transformation by one numpy kernel over a whole Arrow batch.

A text's units are runs of ASCII letters and single other code points. Two cuts, drawn from a digest of the doc_id,
part it into prefix, middle and suffix, which are written with marks as prefix-suffix-middle or suffix-prefix-middle.

The kernel works on the UTF-8 bytes of all rows together: a table gives each byte's class; a byte starts a unit unless
it continues a code point or is a letter right after a letter; a row's first byte always starts one; running sums of
both count units and code points; and searchsorted finds all rows' cuts at once. Bytes are taken in windows of bounded
size, through which the sums are carried, so that a text of any length takes bounded memory beside itself.

Null texts count as empty, which stay as they are (form `plain`), as do texts that hold a mark, and a tenth of all. A
null doc_id draws from the digest of `1:`. Repeated rows stay, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
#: Of a hundred texts so many are transformed, and of those so many have the suffix first.
TRANSFORMED = 90
SUFFIX_FIRST = 20
#: Bytes in a batch, and in a window of the running sums.
TOGETHER = 8_000_000
WINDOW = 16_000_000
LETTER, CONTINUED = 1, 2
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
CLASS[0x80:0xC0] = CONTINUED


def sums(flat: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Units and code points that start in flat[lo:i], for each i from lo to hi. at: where rows start, and the end of the last."""
    kind = CLASS[flat[lo:hi]]
    point = kind != CONTINUED
    letter = kind == LETTER
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    if lo and len(unit) and letter[0] and CLASS[flat[lo - 1]] == LETTER:
        unit[0] = False
    first = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo  # ends of empty rows are starts of the next
    unit[first] = True
    out = np.zeros((2, hi - lo + 1), np.int32)
    np.cumsum(unit, out=out[0, 1:])
    np.cumsum(point, out=out[1, 1:])
    return out[0], out[1]


def cuts(flat: np.ndarray, at: np.ndarray, draws: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: how many units it has; its two cuts in bytes of flat (2, rows); and the code points before each cut, in its row (2, rows). draws (2, rows): a cut falls before the unit of that number modulo n + 1; the smaller comes first."""
    rows = len(at) - 1
    steps = [(lo, min(lo + window, len(flat))) for lo in range(0, max(len(flat), 1), window)]
    units, points, carried, seen = np.zeros(rows + 1, np.int64), np.zeros(rows + 1, np.int64), [(0, 0)], None
    for lo, hi in steps:
        seen = sums(flat, at, lo, hi)
        inside = slice(np.searchsorted(at, lo), np.searchsorted(at, hi, side="right"))
        for total, own, base in zip((units, points), seen, carried[-1], strict=True):
            total[inside] = base + own[at[inside] - lo]
        carried.append((carried[-1][0] + int(seen[0][-1]), carried[-1][1] + int(seen[1][-1])))
    n = np.diff(units)
    wanted = units[:-1] + np.sort(draws % (n + 1), axis=0) + 1  # the number of units up to and with the one after the cut
    where, before = np.full(wanted.shape, len(flat), np.int64), np.full(wanted.shape, points[-1], np.int64)
    for (lo, hi), base, after in zip(steps, carried, carried[1:], strict=False):
        here = (wanted > base[0]) & (wanted <= after[0])
        if here.any():
            own = seen if len(steps) == 1 else sums(flat, at, lo, hi)
            i = np.searchsorted(own[0], wanted[here] - base[0]) - 1
            where[here], before[here] = lo + i, base[1] + own[1][i]
    return n, where, before - points[:-1]


def transform(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points, null if plain) and output of each row."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=TOGETHER):
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            _, at, data = texts.buffers()
            at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            flat = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
            at = at - at[0]
            h = np.array([batch.column(2 + k).to_numpy() for k in range(4)])
            n, (one, two), (prefix, upto) = cuts(flat, at, h[:2], window)
            marked = np.logical_or.reduce([pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in (PREFIX, SUFFIX, MIDDLE)])
            plain = (n == 0) | marked | (h[2] % 100 >= TRANSFORMED)
            last = ~plain & (h[3] % 100 < SUFFIX_FIRST)
            raw, out = memoryview(flat), []
            for lo, a, b, hi, as_is, swapped in zip(at[:-1].tolist(), one.tolist(), two.tolist(), at[1:].tolist(), plain.tolist(), last.tolist(), strict=True):
                p, m, s = raw[lo:a], raw[a:b], raw[b:hi]
                out.append(bytes(raw[lo:hi]) if as_is else b"".join((MARKS[1], s, MARKS[0], p, MARKS[2], m) if swapped else (MARKS[0], p, MARKS[1], s, MARKS[2], m)))
            form = np.where(plain, "plain", np.where(last, "spm", "psm"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(prefix, mask=plain), pa.array(upto - prefix, mask=plain), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *drawn).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from; marks stand in transformed outputs only where they were put."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda *order: F.concat(*[parts[i] for i in order])
    return F.when(form == "psm", part(1, 3, 2)).when(form == "spm", part(2, 3, 1)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """What `transform` gives, with digests of the output and of the text restored from it instead of the output."""
    return transform(docs).withColumn("output_sha256", F.sha2("output", 256)).withColumn("restored_sha256", F.sha2(restored(F.col("output"), F.col("form")), 256)).drop("output")
