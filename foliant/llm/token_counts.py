"""Token counts of texts of any length by overlap resynchronisation.

A tokenizer file of the tokenizers library counts. Texts of up to CHUNK bytes are encoded together; longer ones in
chunks that overlap, so that no more than a few chunks' tokens are in memory at once. Each chunk is encoded with
offsets, and neighbours are spliced at a common boundary p of words in their overlap that is proven stable:

* both chunks have a word that starts at p, and no token before it reaches beyond p;
* the characters at p and after it are starters that never compose with what stands before them (`STARTERS`), so the
  normal form of the whole is that of the two sides;
* of the earlier chunk at least `look` bytes follow p, more than any contraction or special string, so its words before
  p are those of the whole text;
* the pattern of words looks at nothing before a match, so from a common start of a match on the later chunk's words are
  those of the whole text, too, up to its own end.

Where an overlap holds no such boundary (a word, or a run of marks, longer than it), the later chunk starts further
back and reaches further, twice as far each time; where not even the whole earlier chunk helps, that is encoded anew
with what follows. So counts are those of the whole text, whatever the sizes of chunk and overlap.

Null texts count as empty: no bytes and no tokens. Repeated rows stay, an empty table gives an empty result. A row's
text lies in one task, as Spark holds it; its chunks follow each other there.
"""

from __future__ import annotations

import bisect
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Encoding, Tokenizer

from foliant.llm.common import pieces, segment_sum, split_words

#: Bytes that are encoded at a time, and by how much chunks overlap at first.
CHUNK = 16_384
OVERLAP = 256
#: Bytes of short texts that are encoded in one call, and pieces of them whose counts a worker keeps.
TOGETHER = 4_000_000
KEPT = 200_000
#: Tokens beyond which a text is over the limit.
LIMIT = 2_048
#: Characters that no normal form joins to what stands before them: all below the first combining mark, letters of Greek, Cyrillic, Hebrew, Arabic, Devanagari and Thai, punctuation and letters of Chinese and Japanese, Hangul syllables.
STARTERS = re.compile(r"[\x00-˿Α-Ρα-ωА-я\u05D0-\u05EA\u0621-\u064A\u0905-\u0939\u0E01-\u0E2E、-〩ぁ-ゖァ-ヺ一-鿿가-힣]{2}")


class Chunk:
    """An encoded chunk; what is asked of it is answered by the library's encoding, so that no list of all offsets is made."""

    def __init__(self, encoding: Encoding, size: int):
        self.encoding, self.size, self.tokens = encoding, size, len(encoding)

    def place(self, token: int) -> int:
        """The character that a token begins at; it grows with the token."""
        return self.encoding.token_to_chars(token)[0]

    def starts(self, token: int) -> bool:
        """A word starts with the token, and no token before it reaches into it."""
        e = self.encoding
        return not token or e.token_to_word(token) != e.token_to_word(token - 1) and e.token_to_chars(token - 1)[1] <= self.place(token)

    def start_at(self, place: int) -> int | None:
        """The token that begins a word at a character; None where none does."""
        token = bisect.bisect_left(range(self.tokens), place, key=self.place)
        return token if token < self.tokens and self.place(token) == place and self.starts(token) else None


class Counter:
    """Counts of one tokenizer file."""

    def __init__(self, spec: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if chunk < 16 or overlap < 1:
            raise ValueError("a chunk must have 16 bytes and an overlap one, at least")
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        self.spaceless, self.kept = self.drops_spaces(), {}
        self.look = 8 + max([len(x["content"].encode()) for x in json.loads(spec)["added_tokens"]], default=0)

    def chunk_of(self, data: memoryview, lo: int, hi: int) -> Chunk:
        text = str(data[lo:hi], "utf-8")
        return Chunk(self.library.encode(text, add_special_tokens=False), len(text))

    def splice(self, a: Chunk, b: Chunk, shared: str) -> tuple[int, int] | None:
        """The tokens of a before, and of b before, the last stable boundary that they have in common in the text they share, the end of a."""
        limit, room = len(shared), 0
        while limit and room < self.look:  # in bytes, as special strings may hold any character
            limit -= 1
            room += len(shared[limit].encode())
        if room < self.look:
            return None
        for in_b in range(bisect.bisect_right(range(b.tokens), limit, key=b.place) - 1, -1, -1):
            if b.starts(in_b) and STARTERS.match(shared, p := b.place(in_b)) and (in_a := a.start_at(a.size - len(shared) + p)) is not None:
                return in_a, in_b
        return None

    def known(self, pieces: list[str]) -> np.ndarray:
        """The number of tokens of each piece; a bounded number of pieces is kept from batch to batch."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = [x for x in pieces if x not in self.kept]
        self.kept.update(zip(new, self.sizes_of(new), strict=True))
        return np.array([self.kept[x] for x in pieces], np.int64)

    def long(self, data: memoryview) -> int:
        """The number of tokens of a text of any length."""
        end = len(data)
        lo, hi, skip, total = 0, border(data, min(end, self.chunk)), 0, 0
        a = self.chunk_of(data, lo, hi)
        while hi < end:
            width, found = self.overlap, None
            while found is None:
                start = max(lo, border(data, max(0, hi - width)))
                stop = border(data, min(end, start + max(self.chunk, 2 * (hi - start))))
                if start == lo or stop <= hi:
                    stop = border(data, min(end, lo + 2 * max(hi - lo, self.chunk)))
                    self.widened += 1
                    break
                b = self.chunk_of(data, start, stop)
                found = self.splice(a, b, str(data[start:hi], "utf-8"))
                width *= 2
                self.widened += found is None
            if found is None:  # the same chunk, further on: what was skipped of it stays
                hi = stop
                a = self.chunk_of(data, lo, hi)
            else:
                total += found[0] - skip
                a, lo, hi, skip = b, start, stop, found[1]
        return total + a.tokens - skip

    def sizes_of(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def drops_spaces(self) -> bool:
        """White space only parts words: it has no tokens and changes none beside it."""
        ids = lambda x: self.library.encode(x, add_special_tokens=False).ids
        return all(not ids(w + w) and ids(a + w + b) == ids(a) + ids(b) for w in " \t\n\v\f\r" for a in "a1!é" for b in "a1!é")

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text. Where white space only parts words, short texts' different pieces between it are counted once."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        short = np.flatnonzero((sizes > 0) & (sizes <= self.chunk))
        few = texts.take(pa.array(short))
        if self.spaceless:
            flat, owner = split_words(few)
            coded = flat.dictionary_encode()
            each = self.known(coded.dictionary.to_pylist())
            out[short] = segment_sum(each[coded.indices.to_numpy()], owner, len(short))
        elif len(short):
            out[short] = self.sizes_of(few.to_pylist())
        for i in np.flatnonzero(sizes > self.chunk):
            out[i] = self.long(memoryview(texts[int(i)].as_buffer()))
        return out


def border(data: memoryview, at: int) -> int:
    """The place of the character that the byte at `at` is part of."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


_counters: dict[tuple, Counter] = {}


def counter_in_task(spec: str, chunk: int, overlap: int) -> Counter:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    key = (hash(spec), chunk, overlap)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(spec, chunk, overlap)
    return _counters[key]


def counter(docs: DataFrame, path: str, chunk: int, overlap: int) -> Callable[[], Counter]:
    """What makes the counter in a task; the file is read by the driver."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    return lambda: counter_in_task(spec.value, chunk, overlap)


def count(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row, by the tokenizer file (JSON) at path."""
    make = counter(docs, path, chunk, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in pieces(batches, most=TOGETHER):
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(own.counts(texts))], names=["doc_id", "n_bytes", "n_tokens"])

    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
