"""Text functions over columns, in Arrow batches, worked out once for all texts that differ only in their digits.

Such texts have one shape: the text with 0 for each of the digits 0 to 9. A function that copies digits, whatever their
values, makes of a shape a template: what it gives, and which digit goes where. A text's result is then its own digits
put into the template, for all texts of a shape at once. A template is made from the function's own results, digits
numbered; where those don't fit together, and where a shape was met only a few times, the function works on each text.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TextFunction = Callable[[str], str]
ZERO, NINE = ord("0"), ord("9")
#: For each byte of a text that of its shape. Bytes of signs beyond ASCII are none of the digits'.
SHAPED = np.array([ZERO if ZERO <= b <= NINE else b for b in range(256)], np.uint8)
#: Texts of one shape, from which on a template is made: it takes up to four runs of the function for 729 digits.
FEW = 8
#: Shapes that a process remembers, the last met ones, and the bytes of the longest of them; longer ones are known for a batch.
REMEMBERED, LONGEST = 4_096, 1_000
#: Digits copied at a time.
AT_ONCE = 1 << 20


class Template(NamedTuple):
    """A result in bytes, the places of the digits that were copied, and their places in the text."""

    result: np.ndarray
    to: np.ndarray
    place: np.ndarray


#: By function and shape: the number of texts met so far, or the template; None where there can be none.
KNOWN: dict[tuple[TextFunction, bytes], int | Template | None] = {}


def template(f: TextFunction, shape: bytes) -> Template | None:
    """What f makes of texts of a shape; None if its results for different digits don't fit together."""
    text = np.frombuffer(shape, np.uint8)
    digits = np.flatnonzero(text == ZERO)
    run = lambda x: np.frombuffer(f(x.tobytes().decode()).encode(), np.uint8)
    result, to, which, step = run(text), None, 0, 1
    while step < max(2, len(digits)):  # A digit's number in base nine, a place at a time; 1 to 9, as 0 is in the result.
        numbered = text.copy()
        numbered[digits] += (1 + np.arange(len(digits)) // step % 9).astype(np.uint8)
        got = run(numbered)
        if len(got) != len(result):
            return None
        moved = np.flatnonzero(got != result)
        values = got[moved].astype(np.int64) - ZERO
        if to is not None and not np.array_equal(to, moved) or (result[moved] != ZERO).any() or (values < 1).any() or (values > 9).any():
            return None
        to, which, step = moved, which + (values - 1) * step, step * 9
    if (which >= len(digits)).any():
        return None
    return Template(result, to.astype(np.int32), digits[which].astype(np.int32))


def known(f: TextFunction, shape: bytes, n: int) -> Template | None:
    """The template of a shape of n more texts, if it was met often enough."""
    if len(shape) > LONGEST:
        return template(f, shape) if n > FEW else None
    met = KNOWN.pop((f, shape), 0)
    if isinstance(met, int):
        met += n
        if met > FEW:
            met = template(f, shape)
    KNOWN[f, shape] = met
    if len(KNOWN) > REMEMBERED:
        del KNOWN[next(iter(KNOWN))]
    return met if isinstance(met, Template) else None


def worked(f: TextFunction, x: pa.Array, apart: str | None = None) -> pa.Array:
    """f of each text; a null stays null."""
    coded = x.dictionary_encode()
    texts = coded.dictionary.cast(pa.large_string())
    n = len(texts)
    if not n:
        return pa.nulls(len(x), pa.string())
    _, starts, data = texts.buffers()
    starts = np.frombuffer(starts, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data or b"", np.uint8)
    shaped = SHAPED[data[starts[0] : starts[-1]]]
    shapes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(starts - starts[0]), pa.py_buffer(shaped)]).dictionary_encode()
    kind = shapes.indices.to_numpy()
    order = np.argsort(kind, kind="stable")
    ends = np.searchsorted(kind[order], np.arange(len(shapes.dictionary) + 1))
    made, sizes = [], []
    for shape, at, end in zip(shapes.dictionary.to_pylist(), ends, ends[1:]):
        rows = order[at:end]
        t = None if apart and apart.encode() in shape else known(f, shape, len(rows))
        if t is None:
            results = [f(v).encode() for v in texts.take(pa.array(rows)).to_pylist()]
            made.append(np.frombuffer(b"".join(results), np.uint8))
            sizes.append(np.array([len(r) for r in results], np.int64))
        else:
            filled = np.tile(t.result, (len(rows), 1))
            few = max(1, AT_ONCE // max(1, len(t.place)))
            for i in range(0, len(rows), few):
                filled[i : i + few, t.to] = data[starts[rows[i : i + few]][:, None] + t.place]
            made.append(filled.ravel())
            sizes.append(np.full(len(rows), len(t.result), np.int64))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    results = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(np.concatenate(made)))
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return results.take(pa.array(back).take(coded.indices)).cast(pa.string())


def each_shape(f: TextFunction, apart: str | None = None) -> Callable[[Column], Column]:
    """A text function over a column. It must copy the digits 0 to 9 or leave them out, and do the same whatever their values, except in texts that hold `apart`, which are worked out one by one."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return worked(f, x, apart)

    return run
