"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The vocabulary is a public tokenizer's JSON file (BPE with word ends, lower case, white space dropped). Spark
counts the letter words of all texts; the most frequent are compiled into a minimal acyclic automaton over their
UTF-8 bytes, whose transitions carry outputs that add up to the word's number, under which its token ids stand.
The arrays go to the executors as one file, which every Python worker maps into memory. A batch's distinct words
walk the automaton in step, vectorised; a word that it does not accept is merged exactly, lowest rank first and
leftmost among equals. The lexicon only saves work: results do not depend on it.

Null texts are encoded as the empty text: no tokens, and the digests of the empty string. Special tokens written
out in a text get their ids. Repeated rows stay, an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import pieces, segment_sum, shared_dir, split_words, write_bytes, written

#: Words in the lexicon, and the length of the longest in bytes.
LEXICON = 200_000
LONGEST = 40
#: Pieces of text that a Python worker keeps resolved.
KEPT = 100_000
#: Words of pieces that are ASCII and in lower case: contractions, runs of letters, single digits, runs of anything else but white space.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
END = "</w>"
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Vocabulary:
    """Ids and merges of a tokenizer file, and the exact merge of one word."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ranks = {tuple(x) if isinstance(x, list) else tuple(x.split(" ")): i for i, x in enumerate(spec["model"]["merges"])}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.numbers = {i: str(i) for i in self.tokens}
        self.letters, self.rules = byte_letters(), Rules(text)
        #: Of two neighbouring ids, as one number, the merge's rank and result, as one number: the least comes first.
        self.pairs = {self.ids[a] << 32 | self.ids[b]: r << 32 | self.ids[a + b] for (a, b), r in self.ranks.items()}
        self.inner, self.last = [self.ids[x] for x in self.letters], [self.ids[x + END] for x in self.letters]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def symbols(self, word: str) -> list[str]:
        out = [self.letters[b] for b in word.encode()]
        out[-1] += END
        return out

    def merge(self, word: str) -> list[int]:
        """The token ids of one word: of all pairs the one of least rank is merged, the leftmost among equals, until none is left."""
        raw = word.encode()
        if len(raw) > 64:
            return [self.ids[x] for x in merge_long(self.symbols(word), self.ranks)]
        ids, get, none = [self.inner[x] for x in raw], self.pairs.get, 1 << 62
        ids[-1] = self.last[raw[-1]]
        found = [get(a << 32 | b, none) for a, b in pairwise(ids)]
        while found and (low := min(found)) < none:
            i = found.index(low)
            new = low & 0xFFFFFFFF
            ids[i : i + 2] = [new]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 32 | new, none)
            if i < len(found):
                found[i] = get(new << 32 | ids[i + 1], none)
        return ids


def merge_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same merges in n log n steps: a heap of pairs over a linked list."""
    after, before, live = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)], [True] * len(parts)
    heap = [(ranks[p], i, *p) for i, p in enumerate(pairwise(parts)) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not live[i] or j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], live[j], after[i] = a + b, False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (p := (parts[k], parts[after[k]])) in ranks:
                heapq.heappush(heap, (ranks[p], k, *p))
    return [x for x, ok in zip(parts, live, strict=True) if ok]


class Rules:
    """The vocabulary's own rules for what becomes of a text before its words are merged: normal form, letter case, and the pattern of words.

    They rest on Unicode tables, of which this Python, its regex module and an executor's Python may have others; so all but ASCII follows the tables of the tokenizers library.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        spec["model"] |= {"vocab": {}, "merges": []}
        spec |= {"added_tokens": [], "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][0]}
        rules = tokenizers.Tokenizer.from_str(json.dumps(spec))
        self.normal, self.cut = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str

    def words(self, piece: str) -> list[str]:
        """The words of a piece of text in order."""
        if not piece.isascii():
            return [w for w, _ in self.cut(self.normal(piece))]
        piece = piece.lower()
        if piece.isalpha():  # plain words need no pattern, nor do those before a full stop or comma
            return [piece]
        if piece[-1:] in (".", ",") and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return ASCII.findall(piece)


# The lexicon


def compile_lexicon(words: list[str], encode, token) -> dict[str, np.ndarray]:
    """A minimal acyclic transducer of the words: built from sorted words, states with equal futures shared.

    edge, to, out: transitions in the order of state * 256 + byte, their targets, and outputs; final: whether a word
    ends at a state. The outputs along a word's path, and 1 for each final state passed before its end, add up to its
    number in sorted order. Of each number ids and tokens, joined by spaces, are kept as text (offsets and bytes), and
    size, how many there are. encode gives the ids of a word, token the text of an id.
    """
    words = sorted({w.encode() for w in words})
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...))

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    open_: list[list] = [[False, []]]  # the path of the last word
    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(open_) > same + 1:
            child = freeze(open_.pop())
            open_[-1][1].append((last[len(open_) - 1], child))
        open_ += [[False, []] for _ in range(len(word) - same)]
        open_[-1][0] = True
        last = word
    while len(open_) > 1:
        child = freeze(open_.pop())
        open_[-1][1].append((last[len(open_) - 1], child))
    root = freeze(open_[0])
    below = np.zeros(len(states), np.int64)
    edge, to, out = [], [], []
    for s, (final, moves) in enumerate(states):  # targets come before their sources
        total = int(final)
        for byte, child in moves:
            edge.append(s << 8 | byte)
            to.append(child)
            out.append(total - int(final))
            total += int(below[child])
        below[s] = total
    lists = [encode(w.decode()) for w in words]
    texts = {}
    for name, rows in ("ids", [" ".join(map(str, x)) for x in lists]), ("tokens", [" ".join(map(token, x)) for x in lists]):
        raw = [x.encode() for x in rows]
        texts |= {f"{name}_at": np.cumsum([0, *map(len, raw)]).astype(np.int32), name: np.frombuffer(b"".join(raw), np.uint8)}
    return {
        "edge": np.array(edge, np.int64), "to": np.array(to, np.int32), "out": np.array(out, np.int32), "final": np.array([x[0] for x in states], np.int32),
        "root": np.array([root], np.int32), "size": np.array([*map(len, lists)], np.int64), **texts,
    }


def lexicon_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """What a lexicon's file holds: a line of JSON with places and kinds, then the arrays."""
    at, head = 0, {}
    for k, v in arrays.items():
        head[k] = (at, len(v), str(v.dtype))
        at += -(-v.nbytes // 8) * 8
    line = json.dumps(head).encode()
    return line + b" " * (-(len(line) + 1) % 8) + b"\n" + b"".join(v.tobytes() + b"\0" * (-v.nbytes % 8) for v in arrays.values())


def save_lexicon(arrays: dict[str, np.ndarray], path: str) -> None:
    """A lexicon's file on a local disk."""
    Path(path).write_bytes(lexicon_bytes(arrays))


class Lexicon:
    """The automaton, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            line = f.readline()
        data = np.memmap(path, np.uint8, "r", offset=0)
        for k, (at, n, kind) in json.loads(line).items():
            start = len(line) + at
            setattr(self, k, np.asarray(data[start : start + n * np.dtype(kind).itemsize].view(kind)))

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 where the lexicon has no such word. All words walk in step, byte by byte."""
        _, at, data = words.buffers()
        if not len(self.edge) or not data or not len(words):
            return np.full(len(words), -1)
        at = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        starts, sizes, flat = at[:-1], np.diff(at), np.frombuffer(data, np.uint8)
        state, number = np.full(len(words), self.root[0], np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(sizes <= LONGEST)
        state[sizes > LONGEST] = -1
        for j in range(int(sizes[live].max(initial=0))):
            live = live[sizes[live] > j]
            key = state[live] << 8 | flat[starts[live] + j]
            i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            ok = self.edge[i] == key
            number[live] += self.final[state[live]] + self.out[i]
            state[live] = np.where(ok, self.to[i], -1)
            live = live[ok]
        return np.where((state >= 0) & (self.final[state] == 1), number, -1)

    def texts(self, name: str) -> pa.Array:
        """ids or tokens of all words, as they lie in the file."""
        at, data = getattr(self, f"{name}_at"), getattr(self, name)
        return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


# Encoding and decoding


class Codec:
    """Encodes texts with a vocabulary and a lexicon.

    Texts are split at ASCII white space, which no word contains, and each distinct piece of a batch is resolved
    once. Pieces that are a word of the lexicon, with a full stop or comma behind or not, are looked up together; the
    others are cut into words, which are merged. A bounded number of the latter is kept from batch to batch.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, kept: int = KEPT):
        self.v, self.lexicon, self.kept = vocabulary, lexicon, kept
        self.pieces: dict[str, tuple[str, str, int]] = {}
        self.texts = [lexicon.texts(k) for k in ("ids", "tokens")] if lexicon else []
        self.stops = {stop: self.v.merge(stop)[0] for stop in ".,"}

    def split(self, pieces: list[str]) -> list[list[str]]:
        """The words of each piece; a special token stands as itself."""
        words = self.v.rules.words
        out = [words(p) for p in pieces]
        if self.v.cut:
            for k, p in enumerate(pieces):
                if "<|" in p and self.v.cut.search(p):
                    out[k] = [w for part in self.v.cut.split(p) for w in ([part] if part in self.v.special else words(part))]
        return out

    def merged(self, words: set[str]) -> dict[str, tuple[str, str, int]]:
        """Ids and tokens, each joined by spaces, and their number, of each word."""
        number, token, special, out = self.v.numbers, self.v.tokens, self.v.special, {}
        for w in words:
            ids = [special[w]] if w in special else self.v.merge(w)
            out[w] = (number[ids[0]], token[ids[0]], 1) if len(ids) == 1 else (" ".join([number[i] for i in ids]), " ".join([token[i] for i in ids]), len(ids))
        return out

    def spelled(self, distinct: list[str]) -> list[tuple[str, str, int]]:
        """The same of each piece, which are cut into words."""
        if len(self.pieces) > self.kept:
            self.pieces.clear()
        pieces = self.pieces
        new = [p for p in distinct if p not in pieces]
        lists = self.split(new)
        known = self.merged({w for x in lists for w in x})
        for p, x in zip(new, lists, strict=True):
            if len(x) == 1:
                pieces[p] = known[x[0]]
            else:
                ids, tokens, n = zip(*[known[w] for w in x], strict=True) if x else ((), (), ())
                pieces[p] = " ".join(ids), " ".join(tokens), sum(n)
        return [pieces[p] for p in distinct]

    def resolve(self, distinct: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """Of each piece the number of its tokens, and its ids and tokens, each joined by spaces."""
        n, parts = len(distinct), [[], []]
        low, where, sizes = pc.ascii_lower(distinct), [], []
        left = np.arange(n)
        for stop in ["", *self.stops] if self.lexicon and n else []:
            rows = left[pc.ends_with(low.take(pa.array(left)), stop).to_numpy(zero_copy_only=False)] if stop else left
            words = low.take(pa.array(rows))
            found = self.lexicon.find(pc.utf8_slice_codeunits(words, 0, -1) if stop else words)
            hit = found >= 0
            for k, name in enumerate((self.v.numbers, self.v.tokens)):
                got = self.texts[k].take(pa.array(found[hit]))
                parts[k].append(pc.binary_join_element_wise(got, name[self.stops[stop]], " ") if stop else got)
            where.append(rows[hit])
            sizes.append(self.lexicon.size[found[hit]] + len(stop))
            left = np.setdiff1d(left, rows[hit], assume_unique=True)
        rest = self.spelled(distinct.take(pa.array(left)).to_pylist()) if len(left) else []
        for k in (0, 1):
            parts[k].append(pa.array([x[k] for x in rest], pa.string()))
        back = np.empty(n, np.int64)
        back[np.concatenate([*where, left])] = np.arange(n)
        counts = np.concatenate([*sizes, np.fromiter([x[2] for x in rest], np.int64, len(rest))])[back]
        return counts, [pa.concat_arrays([x.cast(pa.string()) for x in p]).take(pa.array(back)) for p in parts]

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of each text the number of tokens, the ids joined by spaces, and the decoded text: what decoding joins by spaces for its ids."""
        flat, owner = split_words(texts)
        coded = flat.dictionary_encode()
        counts, parts = self.resolve(coded.dictionary)
        index = coded.indices.to_numpy()
        numbers = segment_sum(counts[index].astype(np.float64), owner, len(texts)).astype(np.int64)
        some = counts[index] > 0  # of some characters nothing is left
        index, owner = pa.array(index[some]), owner[some]
        ends = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
        ids, tokens = (pc.binary_join(pa.ListArray.from_arrays(ends, x.take(index)), " ") for x in parts)
        return numbers, ids, tokens

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text."""
        return [[int(i) for i in x.split()] for x in self.joined(pa.array(texts, pa.string()))[1].to_pylist()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.v.tokens.__getitem__, ids))


def digest(texts: pa.Array) -> pa.Array:
    return pa.array([sha256(x.as_buffer()).hexdigest() for x in texts], pa.string())


def letter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, n: words of letters in the texts' pieces, without the punctuation around them, and how often they occur in a batch."""
    for batch in pieces(batches):
        flat, _ = split_words(batch.column(0))
        coded = flat.dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        w = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=PUNCTUATION)
        some = pc.and_(pc.utf8_is_alpha(w), pc.and_(pc.greater(pc.utf8_length(w), 1), pc.less_equal(pc.binary_length(w), LONGEST)))
        yield pa.RecordBatch.from_arrays([w.filter(some), pa.array(n).filter(some)], names=["w", "n"])


def frequent_words(docs: DataFrame, most: int = LEXICON) -> list[str]:
    """The most frequent words of letters over all texts, at most `most`. A histogram of counts, in some hundred classes, gives the count from which on all words come to the driver."""
    words = docs.select(F.col("text").cast("string")).mapInArrow(letter_words, "w string, n long")
    counted = written(words.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1").withColumn("class", F.floor(8 * F.log2("n")).cast("int")), "words")
    least, have = None, 0
    for r in sorted(counted.groupBy("class").count().collect(), reverse=True):
        if (have := have + r["count"]) > most:
            break
        least = r["class"]
    top = counted.filter(F.col("class") >= (1 << 30 if least is None else least)).select("w")
    return [r["w"] for r in top.collect()]


def lexicon_file(docs: DataFrame, vocabulary: Vocabulary, most: int = LEXICON) -> str:
    """Compiles the lexicon of the texts into the shared folder, from where executors fetch it, later ones too; returns the name of the file."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(docs.sparkSession)}/{name}"
    write_bytes(docs.sparkSession, path, lexicon_bytes(compile_lexicon([w for w in frequent_words(docs, most) if vocabulary.rules.words(w) == [w]], vocabulary.merge, vocabulary.tokens.__getitem__)))
    docs.sparkSession.sparkContext.addFile(path)
    return name


_codecs: dict[str, Codec] = {}


def codec_in_task(spec, name: str) -> Codec:
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(Vocabulary(spec.value), Lexicon(SparkFiles.get(name)))
    return _codecs[name]


def prepared(docs: DataFrame, path: str, most: int):
    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    return spec, lexicon_file(docs, Vocabulary(spec.value), most)


def encode(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of each row."""
    spec, name = prepared(docs, path, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_in_task(spec, name)
        for batch in pieces(batches, most=1_000_000):
            _, ids, decoded = codec.joined(batch.column(1))
            lists = [[int(i) for i in x.split()] for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32())), decoded], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; what `encode` gives, as digests."""
    spec, name = prepared(docs, path, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_in_task(spec, name)
        for batch in pieces(batches, most=2_000_000):
            n, ids, decoded = codec.joined(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), digest(ids), digest(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
