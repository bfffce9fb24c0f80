"""Language identification by a byte convolutional network, written and trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length. Bytes are embedded, filters of widths 2, 3 and 4 run
over each window, each filter's largest response passes a ReLU, and a softmax layer gives the languages. A text's
logits are the mean over all its windows, weighted by their bytes. For a trained network the responses of a filter
depend on byte pairs only through sums of table rows, so that applying it is table look-ups and a maximum.

Training takes a bounded, seeded sample of labelled texts outside the held out fifth: for each language at most
`per_language` different ones, fewer where more than `ROWS` came of it, and of each `windows` windows. At most
`LANGUAGES` languages are learned, more than there are codes for. Null and blank languages are not learned. A text that is null or has
no letter is `und` with score 0, as is any text where nothing was learned. Repeated rows and null ids stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import held_out, order_key, pieces

WINDOW = 192
WIDTHS = (2, 3, 4)
#: Bounds of the training sample.
PER_LANGUAGE = 800
ROWS = 160_000
LANGUAGES = 8_000
WINDOWS = 2


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256, D
    filters: dict[int, np.ndarray]  # width: (width, D, F)
    bias: np.ndarray  # widths * F
    head: np.ndarray  # widths * F, L
    offset: np.ndarray  # L

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """For each width the responses' parts by byte or by byte pair: filters of width w add rows of them."""
        out = []
        for k in self.filters.values():
            single = [self.embed @ part for part in k]
            pair = lambda a, b: (single[a][:, None, :] + single[b][None, :, :]).reshape(65536, -1).astype(np.float32)
            out.append(tuple(pair(i, i + 1) if i + 1 < len(single) else single[i].astype(np.float32) for i in range(0, len(single), 2)))
        return out


def cut(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, zero-padded at each text's end, the text of each window, and its number of bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(1, -(-sizes // window))
    buffer = np.zeros(int(counts.sum()) * window, np.uint8)
    starts = (np.cumsum(counts) - counts) * window
    for at, text in zip(starts, texts, strict=True):
        buffer[at : at + len(text)] = np.frombuffer(text, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return buffer.reshape(-1, window), owner, np.clip(sizes[owner] - step * window, 1, window)


def pooled(windows: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Each filter's largest response in each window."""
    wide = windows.astype(np.int32)
    pair, out = wide[:, :-1] << 8 | wide[:, 1:], []
    for width, parts in zip(WIDTHS, tables, strict=True):
        span = windows.shape[1] - width + 1
        total = None
        for i, part in enumerate(parts):
            at = (pair if len(part) > 256 else wide)[:, 2 * i : 2 * i + span]
            got = np.take(part, at, axis=0, mode="clip")
            total = got if total is None else np.add(total, got, out=total)
        out.append(total.max(axis=1))
    return np.concatenate(out, axis=1)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(texts: list[bytes], languages: list[str], size: int = 8, filters: int = 8, epochs: int = 6, rate: float = 0.01, seed: int = 5) -> Network:
    """Fits the network to windows and their languages: Adam on the cross entropy, the gradient flowing through each filter's maximum."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    net = Network(names, rng.normal(0, 0.5, (256, size)), {w: rng.normal(0, 1 / np.sqrt(w * size), (w, size, filters)) for w in WIDTHS}, np.zeros(len(WIDTHS) * filters), rng.normal(0, 0.1, (len(WIDTHS) * filters, len(names))), np.zeros(len(names)))
    x, owner, _ = cut(texts)
    y = y[owner]
    weights = [net.embed, *net.filters.values(), net.bias, net.head, net.offset]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at : at + 64]
            wide, most, where = x[rows].astype(np.int64), [], []
            for w, k in net.filters.items():
                span = WINDOW - w + 1
                r = sum((net.embed @ k[o])[wide[:, o : o + span]] for o in range(w))
                where.append(r.argmax(axis=1))
                most.append(np.take_along_axis(r, where[-1][:, None, :], 1)[:, 0, :])
            z = np.concatenate(most, axis=1) + net.bias
            h = np.maximum(z, 0)
            d = np.exp(log_softmax(h @ net.head + net.offset))
            d[np.arange(len(rows)), y[rows]] -= 1
            d /= len(rows)
            dz = (d @ net.head.T) * (z > 0)
            grads = [np.zeros_like(net.embed), *[np.zeros_like(k) for k in net.filters.values()], dz.sum(axis=0), h.T @ d, d.sum(axis=0)]
            for i, (w, k) in enumerate(net.filters.items()):
                g = dz[:, i * filters : (i + 1) * filters]
                for o in range(w):
                    b = wide[np.arange(len(rows))[:, None], where[i] + o]
                    grads[1 + i][o] += np.einsum("nf,nfd->df", g, net.embed[b])
                    np.add.at(grads[0], b.ravel(), (g[:, :, None] * k[o].T[None]).reshape(-1, size))
            step += 1
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def apply(net: Network, tables: list[tuple[np.ndarray, ...]], texts: list[bytes], block: int = 128) -> np.ndarray:
    """Probabilities of the languages for each text, over all its windows."""
    windows, owner, sizes = cut(texts)
    logits = np.concatenate([np.maximum(pooled(windows[at : at + block], tables) + net.bias, 0) @ net.head + net.offset for at in range(0, len(windows), block)])
    total = np.stack([np.bincount(owner, weights=log_softmax(logits)[:, k] * sizes, minlength=len(texts)) for k in range(len(net.languages))], axis=1)
    mean = total / np.maximum(np.bincount(owner, weights=sizes, minlength=len(texts)), 1)[:, None]
    return np.exp(log_softmax(mean))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS) -> tuple[list[bytes], list[str]]:
    """Windows and languages to learn from: a bounded number of texts of each language in a seeded order; of each, evenly spread windows."""
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.trim("lang") != "") & F.col("text").rlike(r"\p{L}")).select("lang", order_key("doc_id", "text").alias("o"), "text")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("o", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    most = max(1, min(per_language, ROWS // max(1, len(counts))))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * most / max(1, r["n"]))) for r in counts], "lang string, share double")
    width = F.greatest(F.lit(1), F.ceil(F.length("text") / windows)).cast("int")
    some = (
        labelled.join(F.broadcast(share), "lang")  # at most LANGUAGES rows
        .filter(F.pmod("o", F.lit(1_000_000)) < F.col("share") * 1_000_000)
        .select("lang", "o", F.array(*[F.substring("text", 1 + i * width, F.lit(WINDOW)) for i in range(windows)]).alias("cuts"))
        .dropDuplicates(["lang", "o"])  # a copy says nothing new
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("o")))
    )
    rows = some.filter(F.col("place") <= most).orderBy("lang", "o").collect()  # at most ROWS, or one for each language
    pairs = [(cut_.encode()[:WINDOW], r["lang"]) for r in rows for cut_ in r["cuts"] if cut_]
    return [x for x, _ in pairs], [y for _, y in pairs]


def classify(net: Network | None, tables: list[tuple[np.ndarray, ...]], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    rows = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False))
    if net and len(rows):
        p = apply(net, tables, [x.encode() for x in texts.take(pa.array(rows)).to_pylist()])
        lang[rows], score[rows] = np.array(net.languages, object)[p.argmax(axis=1)], p.max(axis=1)
    return lang, score


def fitted(docs: DataFrame, per_language: int):
    texts, languages = sample(docs, per_language)
    return docs.sparkSession.sparkContext.broadcast(train(texts, languages) if texts else None)


def predict(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang), learned from the rows that are not held out."""
    net = fitted(docs, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.value.tables() if net.value else []
        for batch in pieces(batches, most=1_000_000):
            lang, score = classify(net.value, tables, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, least: float, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs, all columns, whose language is told: `least` is the part of the way from a blind guess among the learned languages (0) to certainty (1) that the score must have gone."""
    net, at = fitted(docs, per_language), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.value.tables() if net.value else []
        for batch in pieces(batches, most=1_000_000):
            lang, score = classify(net.value, tables, batch.column(at))
            guess = 1 / len(net.value.languages) if net.value else 0.0
            yield batch.filter(pa.array((lang != "und") & (score >= guess + least * (1 - guess))))

    return docs.mapInArrow(run, docs.schema)
