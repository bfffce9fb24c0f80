"""Quality rules: counts of words, lines and symbols, and the fertility of public tokenizers.

Words are runs without \\x20 and \\x09-\\x0D. Each distinct word of a batch is encoded once by two public vocabularies;
a text then has characters per token for both, the share of byte-fallback tokens, and the entropy of its tokens in
bits. Rejection bands come from all texts that pass the base rules: for each language, or script where there is no
language, Tukey fences around the quartiles, on the sides that mark junk; the fewer texts a group has, the wider its
fences, as its quartiles say less. A text is kept if it passes the base rules and lies within its group's bands.
Quartiles are read off counts of measures rounded to thousandths, so they do not depend on how rows are dealt. Groups
are two- or three-letter codes and a fixed list of scripts, so that the bands are a table of bounded size.

Null and blank texts have no words and fail the base rules. Repeated rows and null ids stay.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import pieces, segment_sum, split_words, written

SYMBOLS = "#*$%&|<>"
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Devanagari", "Thai")
#: Words whose tokens a Python worker keeps.
KEPT = 200_000
#: Fences lie so many interquartile ranges beyond the quartiles, and further by the root of this number over that of a group's texts.
FENCE, FEW = 4.0, 50
#: Steps of a measure that are told apart.
STEPS = 1000
#: Measure, and the sides on which it is bounded: lower, upper.
BANDS = {"chars_per_token": (True, True), "bytes_chars_per_token": (True, True), "fallback_share": (False, True), "token_entropy": (True, False)}
#: Least width of a fence, for measures that hardly vary.
FLOORS = {"chars_per_token": 0.5, "bytes_chars_per_token": 0.5, "fallback_share": 0.25, "token_entropy": 1.5}


class Vocabularies:
    """A sentencepiece model with byte fallback and a tiktoken rank file, asked for single words."""

    def __init__(self, pieces_path: str, ranks_path: str, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(ranks_path).read_bytes().splitlines() if line)}
        self.bytes = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.known: dict[str, tuple[list[int], int]] = {}

    def learn(self, words: list[str]) -> list[tuple[list[int], int]]:
        """Of each word its pieces and its number of byte-level tokens."""
        if len(self.known) > KEPT:
            self.known.clear()
        if new := [w for w in words if w not in self.known]:
            self.known.update(zip(new, zip(self.pieces.encode(new, num_threads=1), map(len, map(self.bytes.encode_ordinary, new)), strict=True), strict=True))
        return [self.known[w] for w in words]


@lru_cache(1)
def vocabularies_in_task(pieces_path: str, ranks_path: str, pattern: str) -> Vocabularies:
    """One set a Python worker, whatever its number of tasks."""
    return Vocabularies(pieces_path, ranks_path, pattern)


def repeated_words(code: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each text the words that lie in a window of three words found twice or more in the text."""
    out = np.zeros(len(code), bool)
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(code) > 2 else np.empty(0, np.int64)
    if len(at):
        width = int(code.max()) + 1
        _, pair = np.unique(code[at] * width + code[at + 1], return_inverse=True)
        _, where, count = np.unique((owner[at] * (int(pair.max()) + 1) + pair) * width + code[at + 2], return_inverse=True, return_counts=True)
        twice = at[count[where] > 1]
        for i in range(3):
            out[twice + i] = True
    return np.bincount(owner[out], minlength=n)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """For each text the lines with a word that equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    lines, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    some = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    code = lines.dictionary_encode().indices.to_numpy()[some].astype(np.int64)
    owner = owner[some]
    distinct = np.unique(owner * (int(code.max(initial=0)) + 1) + code) // (int(code.max(initial=0)) + 1)
    return np.bincount(owner, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def token_entropy(code: np.ndarray, owner: np.ndarray, flat: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """The entropy in bits of each text's tokens. flat, sizes: the tokens of each distinct word, one word after the other."""
    starts, many = np.cumsum(sizes) - sizes, sizes[code]
    ends = np.cumsum(many)
    place = np.repeat(starts[code] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)
    keys = np.sort(np.repeat(owner, many) * 65536 + flat[place])
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(keys)]).astype(float)
    of = (keys[first] // 65536).astype(np.int64)
    total = segment_sum(count, of, n)
    return np.maximum(0, np.log2(np.maximum(total, 1)) - segment_sum(count * np.log2(np.maximum(count, 1)), of, n) / np.maximum(total, 1))


def script(text: str | None) -> str:
    """The script of most letters; of several the first listed."""
    if not text or text.isascii():
        return "Latin"
    counts = [len(regex.findall(rf"\p{{{s}}}", text)) for s in SCRIPTS]
    return SCRIPTS[int(np.argmax(counts))]


COLUMNS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, bytes_chars_per_token double, fallback_share double, token_entropy double"


def measures(docs: DataFrame, pieces_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """COLUMNS of every row of docs (doc_id, text, lang): its group in place of lang, counts, and what the tokenizers say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = vocabularies_in_task(pieces_path, ranks_path, pattern)
        for batch in pieces(batches):
            texts, n = batch.column(1), batch.num_rows
            flat, owner = split_words(texts)
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            chars = pc.utf8_length(coded.dictionary).to_numpy().astype(float)
            tokens = vocabularies.learn(coded.dictionary.to_pylist())
            sizes = np.fromiter((len(t) for t, _ in tokens), np.int64, len(tokens))
            ids = np.fromiter(chain.from_iterable(t for t, _ in tokens), np.int64, int(sizes.sum()))
            of_word = np.repeat(np.arange(len(tokens)), sizes)
            sums = lambda x: segment_sum(x[code], owner, n)
            word_chars, n_tokens = sums(chars), sums(sizes.astype(float))
            n_bytes = sums(np.fromiter((b for _, b in tokens), float, len(tokens)))
            fallback = sums(np.bincount(of_word, weights=vocabularies.fallback[ids], minlength=len(tokens)))
            symbols = sum(pc.fill_null(pc.count_substring(texts, s), 0).to_numpy(zero_copy_only=False) for s in SYMBOLS)
            group = [g if g else script(texts[i].as_py()) for i, g in enumerate(batch.column(2).to_pylist())]
            whole = [np.bincount(owner, minlength=n), word_chars, symbols, duplicate_lines(texts), repeated_words(code, owner, n)]
            parts = [word_chars / np.maximum(n_tokens, 1), word_chars / np.maximum(n_bytes, 1), fallback / np.maximum(n_tokens, 1), token_entropy(code, owner, ids, sizes, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group, pa.string()), *(pa.array(x.astype(np.int64)) for x in whole), *(pa.array(x) for x in parts)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    code = F.when(F.lower("lang").rlike(r"\A[a-z]{2,3}\z"), F.lower("lang"))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), code.alias("lang")).mapInArrow(run, COLUMNS)


def quartiles(measured: DataFrame) -> DataFrame:
    """lang, measure, n, low, high: quartiles of each measure over a group's texts, as the first values that a quarter and three quarters of them do not exceed."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(F.col(c) * STEPS).cast("long").alias("step")) for c in BANDS])).alias("m")
    counts = measured.select("lang", each).groupBy("lang", "m.measure", "m.step").count()
    group = Window.partitionBy("lang", "measure")  # one row for each step
    ranked = counts.select("*", F.sum("count").over(group).alias("n"), F.sum("count").over(group.orderBy("step")).alias("upto"))
    least = lambda share: (F.min(F.when(F.col("upto") >= F.col("n") * share, F.col("step"))) / STEPS)
    return ranked.groupBy("lang", "measure").agg(F.max("n").alias("n"), least(0.25).alias("low"), least(0.75).alias("high"))


def bands(measured: DataFrame) -> DataFrame:
    """lang, and lower and upper bounds of each measure: fences around the quartiles of a group's texts."""
    floor = F.create_map(*[x for c, v in FLOORS.items() for x in (F.lit(c), F.lit(v))])
    width = F.greatest(FENCE * (F.col("high") - F.col("low")), floor[F.col("measure")]) * (1 + F.sqrt(F.lit(FEW) / F.col("n")))
    sides = []
    for c, (lower, upper) in BANDS.items():
        of = lambda x, c=c: F.max(F.when(F.col("measure") == c, x))
        sides += [(of(F.col("low") - F.col("width")) if lower else F.lit(float("-inf"))).alias(f"low_{c}"), (of(F.col("high") + F.col("width")) if upper else F.lit(float("inf"))).alias(f"high_{c}")]
    return quartiles(measured).withColumn("width", width).groupBy("lang").agg(*sides)


def judge(docs: DataFrame, pieces_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the measures of every row of docs (doc_id, text, lang)."""
    measured = written(measures(docs, pieces_path, ranks_path, pattern).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "measures")
    within = F.lit(True)
    for c in BANDS:
        within &= F.col(c).between(F.col(f"low_{c}"), F.col(f"high_{c}"))
    known = measured.join(F.broadcast(bands(measured.filter("not base_failed"))), "lang", "left")  # at most 26**2 + 26**3 + 11 groups
    return known.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"), *BANDS)
