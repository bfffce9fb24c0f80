import random
import time

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import decontaminate as d


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[1:]


@pytest.mark.parametrize("seed", range(20))
def test_bit_vectors(seed):
    rng = random.Random(seed)
    p, t = ([rng.randint(0, 3) for _ in range(rng.randint(1, n))] for n in (90, 60))
    assert d.distances(p, t) == brute_distance(p, t)


VOCABULARY = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def damaged(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        how = rng.random()
        if how < 0.34:
            words[i] = rng.choice(VOCABULARY)
        elif how < 0.67:
            words.insert(i, rng.choice(VOCABULARY))
        elif len(words) > 1:
            del words[i]
    return words


def test_recall_and_precision_against_brute_force():
    rng = random.Random(7)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(1, 60)))) for i in range(120)]
    docs = []
    for i, text in items * 3:
        w = text.split()
        docs.append(" ".join([*rng.choices(VOCABULARY, k=40), *damaged(w, rng.randint(0, len(w) // 4), rng), *rng.choices(VOCABULARY, k=40)]))
    index = d.build(items)
    got = {(a, b) for a, b, *_ in d.matches(index, pa.array(docs))}
    want = set()
    for k, doc in enumerate(docs):
        words = [index.words.get(w, 0) for w in doc.split()]
        want |= {(k, index.ids[i]) for i, item in enumerate(index.items) if min(d.distances(item, words)) <= len(item) // d.ONE_IN}
    assert got <= want
    assert len(got & want) / len(want) >= 0.97


def test_places_and_distances():
    index = d.build([(5, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa.")])
    doc = "one two ALPHA beta gamma wrong epsilon zeta eta theta iota kappa three"
    assert d.matches(index, pa.array([doc, None, "", "alpha beta"])) == [(0, 5, 2, 12, 1)]


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "château est là"), (4, "日本語のテキスト")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in d.leaks(odd, bench).collect()}
    assert got == {(1, 1, 0), (2, 1, 0), (None, None, 0), (9, 4, 0)}
    kept = d.without_leaks(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 7, 8]
    assert d.leaks(none, bench).count() == d.leaks(odd, bench.limit(0)).count() == 0
    assert d.without_leaks(odd, bench.limit(0)).count() == odd.count()


def test_walks_are_repeatable():
    a, b = (d.build([(1, "a b c d e f g h i j")]) for _ in range(2))
    assert all(np.array_equal(x[0], y[0]) for (_, t), (_, u) in zip(a.tables.values(), b.tables.values(), strict=True) for x, y in zip(t, u, strict=True))


@pytest.mark.parametrize("n", [5, 9, 10, 14, 19, 25, 40, 60, 100, 150, 250, 400])
@pytest.mark.parametrize("how", ["random", "even", "insert", "delete"])
def test_target_recall_at_the_full_distance(n, how):
    """Exactly n // 5 edits, by item length and kind of edit."""
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(5000)]
    items, docs = [], []
    for i in range(60):
        words, edits = rng.sample(vocabulary, n), n // d.ONE_IN
        items.append((i, " ".join(words)))
        places = [(2 * j + 1) * n // (2 * edits) for j in range(edits)] if how == "even" else rng.sample(range(n), edits)
        for p in sorted(places, reverse=True):
            words[p : p + 1] = {"insert": ["new", words[p]], "delete": []}.get(how, ["new"])
        docs.append(" ".join([*rng.choices(vocabulary, k=40), *words, *rng.choices(vocabulary, k=40)] if i % 3 else words))
    index = d.build(items)
    got = {(a, b) for a, b, *_ in d.matches(index, pa.array(docs))}
    want = {(i, i) for i in range(60) if d.nearest(index.items[i], [index.words.get(w, 0) for w in docs[i].split()], n // d.ONE_IN)}
    assert len(want) == 60
    assert len(want & got) / len(want) >= 0.95


def test_windows_are_item_sized_while_walks_reach_the_target():
    assert [d.windows_of(n)[0] for n in (1, 4, 5, 8, 10, 12, 14, 16, 19)] == [1, 4, 5, 8, 10, 12, 14, 16, 19]
    for n in range(1, 420):
        size, edits, repeats, offsets = d.windows_of(n)
        assert edits == n // d.ONE_IN // len(offsets) and repeats <= d.MOST
        assert all(b - a >= size for a, b in zip(offsets, [*offsets[1:], n], strict=True))


def test_blocks_of_items(spark, odd):
    bench = spark.createDataFrame([(i, f"quick brown fox jumps over {x}") for i, x in enumerate(["the lazy dog", "a wall", "the fence", "château est là"])] + [(9, "château est là")], "item_id long, text string").coalesce(1)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(d.leaks(odd, bench, items=2)) == rows(d.leaks(odd, bench)) != []
    assert rows(d.without_leaks(odd, bench, items=2).select("doc_id")) == rows(d.without_leaks(odd, bench).select("doc_id"))


def test_blocks_are_cut_by_what_their_windows_hold():
    rows = [(i, " ".join(VOCABULARY[:n])) for i, n in enumerate([10, 40, 40, 3, 120, 5, 0])] + [(9, None)]
    hashes = lambda b: sum(d.windows_of(len(t.split()))[2] * len(d.windows_of(len(t.split()))[3]) for _, t in b if t)
    cut = list(d.blocks(iter(rows), hashes=200))
    assert [r for b in cut for r in b] == rows and len(cut) > 2
    assert all(len(b) == 1 or hashes(b) <= 200 for b in cut)
    assert [len(b) for b in d.blocks(iter(rows), items=3)] == [3, 3, 2] and list(d.blocks(iter([]))) == [[]]


def test_long_passages_that_are_common():
    """A fifth of the texts hold a passage of 300 words: under 20 ms for each of those that match, candidates once each."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=300))) for i in range(40)]
    index, docs = d.build(items), []
    for i in range(200):
        words = rng.choices(vocabulary, k=300)
        if i % 5 == 0:
            inner = items[i // 5 % 40][1].split()
            words[100:100] = inner if i % 2 else [w if rng.random() > 0.08 else "new" for w in inner]
        docs.append(" ".join(words))
    texts = pa.array(docs)
    d.matches(index, texts[:1])
    began = time.process_time()
    got = d.matches(index, texts)
    spent = time.process_time() - began
    assert {(a, b) for a, b, *_ in got} == {(i, i // 5 % 40) for i in range(0, 200, 5)}
    plain = pa.array([" ".join(rng.choices(vocabulary, k=360)) for _ in range(200)])
    began = time.process_time()
    assert not d.matches(index, plain)
    assert spent - (time.process_time() - began) < 40 * 0.02
