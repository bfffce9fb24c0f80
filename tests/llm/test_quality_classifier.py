import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import quality_classifier as q

WORDS = [a + b for a in ("ra", "te", "mo", "li", "su", "ne", "ka") for b in ("ver", "ton", "lia", "rest", "min", "dor", "s")]


def corpus(n):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(WORDS) for _ in range(80)] if good else [rng.choice(WORDS[:4]).upper() + "!!" for _ in range(80)]
        rows.append((i, " ".join(words) + ".", f"s{i % 5}", int(good)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    sites = spark.createDataFrame([(r[0], f"h{r[0] % 3}", "p") for r in rows if r[0] % 2], "doc_id long, host string, path string")
    return docs, labels, sites


def test_held_out_accuracy(spark):
    docs, labels, sites = frames(spark, corpus(500))
    got = q.classify(docs, labels, sites, counted=False).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in got]) > 0.97


def test_posteriors_shrink(spark):
    rows = [("big", "a", 1)] * 180 + [("big", "a", 0)] * 20 + [("bad", "a", 1)] * 20 + [("bad", "a", 0)] * 180 + [("tiny", "b", 0)] + [(None, "", 1)] * 10
    share, hosts, paths = q.posteriors(spark.createDataFrame(rows, "host string, path string, good int"))
    host = {r["host"]: r["host_share"] for r in hosts.collect()}
    assert share == pytest.approx(211 / 413)
    assert 0.85 < host["big"] < 0.9 and 0.1 < host["bad"] < 0.15
    assert 0.2 < host["tiny"] < share  # one bad label moves it only part of the way
    assert {r["host"]: r["path_share"] for r in paths.collect()}["tiny"] < host["tiny"]


def test_evidence_in_columns_is_the_model(spark):
    x = np.random.default_rng(1).normal(size=(200, len(q.MEASURES)))
    y = (x[:, 0] > 0).astype(float)
    edges, weights, offset = q.fit(x, y)
    place = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)
    want = weights[np.arange(len(edges)), place].sum(axis=1) + offset
    got = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>").select("i", q.evidence(F.col("x"), (edges, weights, offset)).alias("e")).orderBy("i").toPandas()["e"]
    assert np.allclose(got, want)


def test_measures_of_blank_texts():
    assert np.abs(q.measures(pa.array([None, "", "\n"]))[:, [0, 1, 2, 3]]).sum() == 0


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (9, 0)], "doc_id long, quality int")
    sites = spark.createDataFrame([(1, "h", None), (9, None, None)], "doc_id long, host string, path string")
    got = q.classify(odd, labels, sites)
    assert got.count() == odd.count()
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
    assert q.classify(none, labels, sites).count() == 0
    assert q.classify(odd, labels.limit(0), sites.limit(0)).filter("evidence <> 0").count() == 0


def test_own_label_counts_not(spark):
    """A labelled document is judged as if it were not; a document of another name with the same text and site is not."""
    rows = [(i, "same text", f"h{i % 4}", int(i % 3 > 0)) for i in range(80)]
    docs = spark.createDataFrame([(*r[:2], "s") for r in rows] + [(1000 + h, "same text", "s") for h in range(4)], "doc_id long, text string, source string")
    sites = spark.createDataFrame([(r[0], r[2], f"p{r[0] % 8}") for r in rows] + [(1000 + h, f"h{h}", "other") for h in range(4)], "doc_id long, host string, path string")
    labels = [(r[0], r[3]) for r in rows]
    got = {r["doc_id"]: r["prior"] for r in q.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), sites).collect()}
    share, kh, kp, _, _ = q.site_counts(spark.createDataFrame([(r[2], f"p{r[0] % 8}", r[3]) for r in rows], "host string, path string, good int"))
    for i, _, h, good in rows:
        host = [r[3] for r in rows if r[2] == h and r[0] != i]
        path = [r[3] for r in rows if r[2] == h and r[0] % 8 == i % 8 and r[0] != i]
        assert got[i] == pytest.approx((sum(path) + kp * (sum(host) + kh * share) / (len(host) + kh)) / (len(path) + kp)), i
    for h in range(4):
        host = [r[3] for r in rows if r[2] == f"h{h}"]
        assert got[1000 + h] == pytest.approx((sum(host) + kh * share) / (len(host) + kh))


def test_sites_separate_held_out_documents(spark):
    """Texts tell nothing; two hosts of five are bad: with sites held-out documents are told apart, with all labels but their own."""
    rng = random.Random(2)
    rows = [(i, "the same words", f"h{i % 5}", int(rng.random() < (0.15 if i % 5 < 2 else 0.9))) for i in range(600)]
    docs, labels, _ = frames(spark, rows)
    sites = spark.createDataFrame([(r[0], r[2], "p") for r in rows], "doc_id long, host string, path string")
    for counted in (True, False):
        got = q.classify(docs, labels, sites, least=0.5, counted=counted).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
        assert np.mean([r["kept"] == (r["quality"] == 1) for r in got]) > 0.8
