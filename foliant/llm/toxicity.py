"""Toxicity by multiple-instance learning: sentence scores that only documents' labels train.

A sentence's score is a logistic function of its words: of each word as a whole and of its four-letter parts, hashed.
A document is toxic unless all its sentences are clean, so its score is the noisy-or of its sentences' scores; the
gradient of the documents' likelihood flows to each sentence by its share. Sentences that score 0.5 or more are the
offending ones, found without any label of a sentence.

Training takes a bounded, seeded sample of labelled documents outside the held-out fifth, weighted back to the
labels' own share; texts of more than `LONGEST` characters are scored, not learned from, and of several texts with one
id the first in order is learned. Null and blank texts have no sentence: they score 0. Without labels of both kinds nothing is
learned and every score is 0. Repeated rows stay; a document labelled twice counts as toxic if any label says so.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import drawn, held_out, pieces, split_words

DIMENSIONS = 1 << 18
#: Bounds of the training sample: documents of each label, and the longest text in characters.
TOXIC, CLEAN, LONGEST = 2000, 4000, 20_000
ENDS = r"[.!?\n]+"
KEPT = 400_000
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def features(word: str) -> list[int]:
    """Hashes of a word and of its four-letter parts, ends marked."""
    bare = f"<{word.lower().strip(PUNCTUATION)}>".encode()
    return [crc32(bare) % DIMENSIONS, *(crc32(bare[i : i + 4], 1) % DIMENSIONS for i in range(max(1, len(bare) - 3)))]


@dataclass
class Model:
    weights: np.ndarray
    offset: float


def sentences(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The sentences of the texts, blank ones too, and for each the index of its text."""
    lists = pc.split_pattern_regex(texts, ENDS)
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)


def logits(scores: np.ndarray, code: np.ndarray, owner: np.ndarray, n: int, offset: float) -> np.ndarray:
    return np.clip(offset + np.bincount(owner, weights=scores[code], minlength=n), -20, 20)


def train(texts: list[str], toxic: list[int], weight: list[float], rounds: int = 120, rate: float = 0.1, decay: float = 0.1) -> Model:
    """Fits sentence weights to documents' labels by Adam on the noisy-or likelihood."""
    parts, doc = sentences(pa.array(texts, pa.string()))
    flat, sentence = split_words(parts)
    coded = flat.dictionary_encode()
    code, flat_features, sizes = coded.indices.to_numpy().astype(np.int64), array("q"), array("q")
    for w in coded.dictionary:  # numbers in flat arrays: the driver holds one word's list at a time
        some = features(w.as_py())
        flat_features.extend(some)
        sizes.append(len(some))
    n = len(sizes)
    feature, word = np.frombuffer(flat_features, np.int64) if n else np.empty(0, np.int64), np.repeat(np.arange(n), np.array(sizes, np.int64))
    used = np.flatnonzero(np.bincount(sentence, minlength=len(parts)))  # blank sentences say nothing
    number = np.full(len(parts), -1)
    number[used] = np.arange(len(used))
    sentence, doc = number[sentence], doc[used]
    y, share = np.array(toxic, float), np.array(weight, float)
    share /= share.sum()
    model = Model(np.zeros(DIMENSIONS), -5.0)
    first, second = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for step in range(1, rounds + 1):
        scores = np.bincount(word, weights=model.weights[feature], minlength=n)
        z = logits(scores, code, sentence, len(doc), model.offset)
        s = 1 / (1 + np.exp(-z))
        clean = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=len(y))
        p = np.clip(1 - np.exp(clean), 1e-9, 1)
        dz = s * (share * np.where(y == 1, -(1 - p) / p, 1.0))[doc]
        grad = np.append(np.bincount(feature, weights=np.bincount(code, weights=dz[sentence], minlength=n)[word], minlength=DIMENSIONS) + decay * model.weights / len(y), dz.sum())
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        model.weights -= move[:-1]
        model.offset -= float(move[-1])
    return model


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> tuple[list[str], list[int], list[float]]:
    """Texts, labels and weights to learn from: ids are drawn from the labels alone, so that only a bounded list of ids meets the documents."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    some = drawn(known.filter("toxic = 1"), toxic, total.get(1, 0), "doc_id").union(drawn(known.filter("toxic = 0"), clean, total.get(0, 0), "doc_id"))
    fit = docs.filter(F.col("text").isNotNull() & (F.length("text") <= LONGEST)).select("doc_id", "text")
    rows = fit.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()  # at most toxic + clean rows
    have = {k: max(1, sum(r["toxic"] == k for r in rows)) for k in (0, 1)}
    return [r["text"] for r in rows], [r["toxic"] for r in rows], [total.get(r["toxic"], 0) / have[r["toxic"]] for r in rows]


def fitted(docs: DataFrame, labels: DataFrame):
    texts, toxic, weight = sample(docs, labels)
    return docs.sparkSession.sparkContext.broadcast(train(texts, toxic, weight) if len(set(toxic)) == 2 else None)


class Scorer:
    """Scores sentences; keeps a bounded number of words' scores."""

    def __init__(self, model: Model | None):
        self.model, self.known = model, {}

    def __call__(self, parts: pa.Array) -> np.ndarray:
        """The score of each sentence; blank sentences score 0."""
        if not self.model:
            return np.zeros(len(parts))
        flat, owner = split_words(parts)
        coded = flat.dictionary_encode()
        if len(self.known) > KEPT:
            self.known.clear()
        words = coded.dictionary.to_pylist()
        for w in words:
            if w not in self.known:
                self.known[w] = sum(self.model.weights[f] for f in features(w))
        scores = np.fromiter(map(self.known.__getitem__, words), float, len(words))
        z = logits(scores, coded.indices.to_numpy().astype(np.int64), owner, len(parts), self.model.offset)
        return np.where(np.bincount(owner, minlength=len(parts)) > 0, 1 / (1 + np.exp(-z)), 0.0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, worst (number of the sentence that scores most, from 0; null without any) of every row of docs (doc_id, text)."""
    model = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in pieces(batches):
            n = batch.num_rows
            parts, doc = sentences(batch.column(1))
            s = scorer(parts)
            total = 1 - np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(s, 1 - 1e-12)), minlength=n))
            order = np.lexsort((np.arange(len(s)), -s, doc))
            top = order[np.flatnonzero(np.r_[True, doc[order][1:] != doc[order][:-1]])] if len(order) else order
            worst = np.full(n, -1)
            worst[doc[top]] = top - np.searchsorted(doc, doc[top])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(np.bincount(doc[s >= 0.5], minlength=n)), pa.array(worst, mask=worst < 0)], names=["doc_id", "score", "n_offending", "worst"])

    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, n_offending long, worst long")
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "worst")


def offending(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (number in its text, from 0), score, text of each sentence that scores `least` or more."""
    model = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in pieces(batches):
            parts, doc = sentences(batch.column(1))
            s = scorer(parts)
            at = np.flatnonzero(s >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[at])), pa.array(at - np.searchsorted(doc, doc[at])), pa.array(s[at]), parts.take(pa.array(at))], names=["doc_id", "sentence", "score", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, sentence long, score double, text string")
