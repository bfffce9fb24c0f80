import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import language_id as g

WORDS = {
    "en": "the of and with that have this from which their would there about other these thing".split(),
    "fr": "les des être où déjà après château même très leçon garçon élève forêt peut était".split(),
    "de": "und der über schön größe straße mädchen können würde natürlich zwischen außer für".split(),
}


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[lang], 60)), lang) for i, lang in enumerate(rng.choice(list(WORDS), n))]


def test_held_out_accuracy(spark):
    rows = corpus(400)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = g.predict(df).join(df, "doc_id").filter("held_out")
    assert got.count() > 40
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97


def test_tables_are_the_convolution():
    """Look-ups by pairs give what the filters give written out."""
    rng = np.random.default_rng(1)
    net = g.Network(["a"], rng.normal(size=(256, 4)), {w: rng.normal(size=(w, 4, 3)) for w in g.WIDTHS}, np.zeros(9), np.zeros((9, 1)), np.zeros(1))
    x = rng.integers(0, 256, (5, g.WINDOW)).astype(np.uint8)
    want = [max(sum(net.embed[row[i + o]] @ k[o][:, f] for o in range(w)) for i in range(g.WINDOW - w + 1)) for row in x for w, k in net.filters.items() for f in range(3)]
    assert np.allclose(g.pooled(x, net.tables()).ravel(), want, atol=1e-4)


def test_windows_cover_whole_texts():
    texts = [b"", b"a", b"b" * g.WINDOW, b"c" * (3 * g.WINDOW + 1)]
    windows, owner, sizes = g.cut(texts)
    assert owner.tolist() == [0, 1, 2, 3, 3, 3, 3]
    assert sizes.tolist() == [1, 1, g.WINDOW, g.WINDOW, g.WINDOW, g.WINDOW, 1]
    assert (windows != 0).sum() == sum(map(len, texts))


def test_odd_rows(spark, odd, none):
    rows = {r["doc_id"]: r for r in g.predict(odd).collect()}
    assert g.predict(odd).count() == odd.count()
    for i in (3, 4, 5, 7):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0
    assert rows[None]["held_out"]
    assert g.predict(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in g.predict(unlabelled).collect()} == {"und"}
    kept = g.keep(odd, 0.0)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 8, 9}
    assert g.keep(none, 0.0).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_training_is_repeatable(seed):
    rows = corpus(60)
    a, b = (g.train([t.encode() for _, t, _ in rows], [x for *_, x in rows], epochs=1, seed=seed) for _ in range(2))
    assert np.array_equal(a.head, b.head)


def test_repeated_ids_and_rare_languages_are_learned(spark):
    rows = [(3, f"the quick brown fox number {i} jumps over the lazy dog", "en") for i in range(3000)] + [(3, f"le renard brun {i} saute par dessus le chien", "fr") for i in range(5)]
    df = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id long, text string, lang string").repartition(5)
    texts, languages = g.sample(df, per_language=100)
    assert languages.count("en") == 200 and languages.count("fr") == 10
    assert (texts, languages) == g.sample(df.repartition(3), per_language=100)
