import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliant.llm import toxicity as t

PLAIN = [a + b for a in ("ra", "te", "mo", "li", "su", "ne") for b in ("ver", "ton", "lia", "rest", "min", "dor")]
BAD = ["grumblefool", "snotwit", "crudhead"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        sentences = [[rng.choice(PLAIN) for _ in range(8)] for _ in range(rng.randint(1, 8))]
        if toxic:
            rng.choice(sentences)[3] = rng.choice(BAD)
        rows.append((i, ". ".join(map(" ".join, sentences)) + ".", int(toxic)))
    return rows


def test_held_out_and_places(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = t.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97
    found = t.offending(docs, labels).collect()
    assert np.mean([any(b in r["text"] for b in BAD) for r in found]) > 0.95
    texts = {i: x for i, x, _ in rows}
    for r in found[:20]:
        assert r["text"] == texts[r["doc_id"]].replace("\n", ".").split(".")[r["sentence"]] or r["text"] in texts[r["doc_id"]]


def test_noisy_or():
    """A document's score is what its sentences' scores leave of being clean."""
    model = t.train(["aa bb. cc dd.", "aa bb.", "ee ff. gg hh."], [1, 0, 0], [1, 1, 1], rounds=5)
    parts, doc = t.sentences(pa.array(["aa bb. cc dd.", ""]))
    s = t.Scorer(model)(parts)
    assert doc.tolist() == [0, 0, 0, 1]
    assert s[2] == s[3] == 0
    assert 0 < 1 - (1 - s[0]) * (1 - s[1]) < 1


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = t.score(odd, labels)
    assert got.count() == odd.count()
    assert got.filter("doc_id in (3, 4, 5)").agg(F.max("score")).first()[0] == 0
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert t.score(none, labels).count() == 0
    assert t.score(odd, labels.limit(0)).agg(F.max("score")).first()[0] == 0
    assert t.offending(none, labels).count() == 0
