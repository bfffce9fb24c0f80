"""Quality classifier: evidence of a document's text, and hierarchical empirical Bayes over its site.

A logistic model over binned text measures gives each document a log-likelihood ratio of good to bad; it never learns
from a held-out fifth. Labelled documents are summed by host and by path under it; the prior's strength at either level
is estimated by the method of moments from how much groups differ beyond chance. A host's posterior shrinks toward
the share of all, a path's toward its host's, so that sparse sites fall back on the level above. A document's
posterior adds its evidence to its path's log odds.

Texts are read once; only measures, sites and counts are joined. Null and blank texts have measures of zero;
documents without a host take the posterior of all. Documents without labels are scored like others; without labels
of both kinds the evidence is zero. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import drawn, held_out, hot_join, pieces, segment_sum, sized, split_words, written

MEASURES = ["words", "word_length", "symbols", "capitals", "digits", "distinct_words", "top_word", "duplicate_lines", "bars", "shouts", "stops"]
#: Bound of the labelled sample that the logistic model is fitted to; bins of each measure.
ROWS, BINS = 20_000, 10
LEAST = 0.5


def measures(texts: pa.Array) -> np.ndarray:
    """A row of MEASURES for each text."""
    n = len(texts)
    flat, owner = split_words(texts)
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    lengths = pc.utf8_length(coded.dictionary).to_numpy().astype(float)
    count = np.bincount(owner, minlength=n)
    some = np.maximum(count, 1)
    chars = segment_sum(lengths[code], owner, n)
    width = int(code.max(initial=0)) + 1
    keys, times = np.unique(owner * width + code, return_counts=True)
    of = keys // width
    top = np.zeros(n)
    np.maximum.at(top, of, times)
    has = lambda pattern: segment_sum(pc.count_substring_regex(coded.dictionary, pattern).to_numpy().astype(float)[code], owner, n)
    lists = pc.split_pattern(texts, "\n")
    line, of_line = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    line_code = line.dictionary_encode().indices.to_numpy().astype(np.int64)
    lines = np.maximum(np.bincount(of_line, minlength=n), 1)
    distinct = np.bincount(np.unique(of_line * (int(line_code.max(initial=0)) + 1) + line_code) // (int(line_code.max(initial=0)) + 1), minlength=n)
    full = np.maximum(chars, 1)
    return np.stack([np.log1p(count), chars / some, has(r"[#*$%&<>]") / full, has("[A-Z]") / full, has("[0-9]") / full, np.bincount(of, minlength=n) / np.sqrt(some), top / some, 1 - distinct / lines, has(r"\|") / some, has("!") / some, has(r"[.,;:]") / some], axis=1)


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` of docs and x, the array of MEASURES."""
    schema = docs.select(*keep).schema.add("x", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            x = measures(batch.column(batch.num_columns - 1))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(MEASURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows], names=[*keep, "x"])

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


# The text's evidence


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = 400, ridge: float = 3e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Edges (measures, bins - 1), the weight of each bin (measures, bins) and an offset: a logistic model by gradient descent with momentum. The offset is the log-likelihood ratio's: prior odds are taken off."""
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    edges[:, -1] = np.quantile(x, 0.97, axis=0)
    place = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1) + np.arange(x.shape[1]) * bins
    w, b, vw, vb = np.zeros(x.shape[1] * bins), 0.0, 0.0, 0.0
    for _ in range(rounds):
        d = 1 / (1 + np.exp(-(w[place].sum(axis=1) + b))) - y
        vw = 0.9 * vw - (np.bincount(place.ravel(), weights=np.repeat(d, x.shape[1]), minlength=len(w)) / len(y) + ridge * w)
        vb = 0.9 * vb - d.mean()
        w, b = w + vw, b + vb
    return edges, w.reshape(-1, bins), float(b - np.log(y.mean() / (1 - y.mean())))


def evidence(x: Column, model: tuple[np.ndarray, np.ndarray, float] | None) -> Column:
    """The log-likelihood ratio of good to bad of an array of measures."""
    if model is None:
        return F.lit(0.0)
    edges, weights, total = model
    out = F.lit(float(total))
    for k in range(len(MEASURES)):
        term = F.lit(float(weights[k, 0]))
        for edge, weight in zip(edges[k], weights[k, 1:], strict=True):
            term = F.when(x[k] >= float(edge), F.lit(float(weight))).otherwise(term)
        out = out + term
    return out


# The site's posteriors


def strength(groups: DataFrame, share: float) -> float:
    """How many labelled documents the prior counts as, from groups (n, good): beta-binomial moments, within 2 and 10,000."""
    n, good = F.col("n").cast("double"), F.col("good")
    got = groups.agg(F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count("*").alias("groups"), F.sum(n * F.pow(good / n - share, 2)).alias("spread")).first()
    if not got["n"] or got["groups"] < 2 or not 0 < share < 1:
        return 50.0
    chance = share * (1 - share)
    between = (got["spread"] - (got["groups"] - 1) * chance) / max(got["n"] - got["nn"] / got["n"], 1e-9)
    return float(min(10_000.0, max(2.0, chance / between - 1))) if between > 0 else 10_000.0


def site_counts(labelled: DataFrame) -> tuple[float, float, float, DataFrame, DataFrame]:
    """Of labelled rows (host, path, good) the share of all, how many labelled documents the priors of hosts and of paths count as, and the counts of hosts (host, host_n, host_good) and of paths (host, path, path_n, path_good)."""
    paths = written(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good")), "paths")
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    share = ((total["good"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    paths = paths.filter("host is not null")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    named = lambda d, by, name: d.select(*by, F.col("n").alias(f"{name}_n"), F.col("good").alias(f"{name}_good"))
    return share, strength(hosts, share), strength(paths, share), named(hosts, ["host"], "host"), named(paths, ["host", "path"], "path")


def shrunk(name: str, strength: float, toward: Column, own: Column) -> Column:
    """A site's share of good documents, shrunk toward another; of a labelled document (own not null) without its own label."""
    n, good = (F.coalesce(F.col(f"{name}_{x}"), F.lit(0)) for x in ("n", "good"))
    mine = F.when(own.isNotNull() & F.col(f"{name}_n").isNotNull(), 1).otherwise(0)
    return (good - F.coalesce(own * mine, F.lit(0)) + strength * toward) / (n - mine + strength)


def posteriors(labelled: DataFrame) -> tuple[float, DataFrame, DataFrame]:
    """The share of all, hosts (host, host_share) and paths (host, path, path_share) of labelled rows (host, path, good)."""
    share, host_strength, path_strength, hosts, paths = site_counts(labelled)
    none = F.lit(None).cast("int")
    host = shrunk("host", host_strength, F.lit(float(share)), none)
    return share, hosts.select("host", host.alias("host_share")), paths.join(hosts, "host").select("host", "path", shrunk("path", path_strength, host, none).alias("path_share"))


def classify(docs: DataFrame, labels: DataFrame, sites: DataFrame, least: float = LEAST, counted: bool = True) -> DataFrame:
    """Sites count all labels but a document's own; unless `counted`, as for a measurement, those of the held-out fifth stay out. Evidence never learns from that fifth. doc_id, host, path, evidence, prior, score, kept of every row of docs (doc_id, text, source). labels: doc_id, quality (1: good). sites: doc_id (each once), host, path; a document without a site has its source for host."""
    read = written(measured(docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string")), "doc_id", "source"), "measured")
    total = read.count()
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(counted) | ~held_out())).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("good"))
    sited = hot_join(hot_join(read, sites, ["doc_id"], total), known, ["doc_id"], total)
    each = written(sited.select("doc_id", F.coalesce("host", "source").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "x", "good"), "sited")
    labelled = each.filter("good is not null")
    fit_to = labelled.filter(~held_out()).select("doc_id", "x", "good")
    rows = drawn(fit_to, ROWS, fit_to.count(), "doc_id", "x").toPandas().sort_values("doc_id", kind="stable")
    y = rows["good"].to_numpy(float)
    model = fit(np.stack(rows["x"].to_numpy()), y) if len(rows) and 0 < y.mean() < 1 else None
    share, host_strength, path_strength, hosts, paths = site_counts(labelled.select("doc_id", "host", "path", "good").distinct())
    prior = shrunk("path", path_strength, shrunk("host", host_strength, F.lit(float(share)), F.col("good")), F.col("good"))
    found = hot_join(each.withColumn("evidence", evidence(F.col("x"), model)), sized(hosts), ["host"], total)
    found = hot_join(found, sized(paths), ["host", "path"], total)
    odds = F.log(prior / (1 - prior)) + F.col("evidence")
    return found.select("doc_id", "host", "path", F.round("evidence", 9).alias("evidence"), prior.alias("prior"), (1 / (1 + F.exp(-odds))).alias("score")).withColumn("kept", F.col("score") >= least)
