import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from foliant.llm import simhash_dedup as s


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, most=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(root)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    groups = defaultdict(set)
    for f in known:
        groups[find(f)].add(f)
    return {frozenset(g) for g in groups.values()}


def fixture_fps(n, seed=1, apart=3):
    """Random fingerprints, a tight cluster and chains, so that components have many shapes."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    centre = rng.getrandbits(64)
    for _ in range(n // 3):
        out.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, apart))))
    x = rng.getrandbits(64)
    for _ in range(20):
        x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 5])))
        out.append(x)
    return sorted(set(out))


def components_of(spark, fps, **kw):
    df = spark.createDataFrame([(s.signed(f),) for f in fps], "fp long")
    got = s.components(s.links(df, **kw))
    root = {f: f for f in fps} | {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in got.collect()}
    groups = defaultdict(set)
    for f, r in root.items():
        groups[r].add(f)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "A b C d E f g", "ÄÖ äö straße x y z w", "w " * 500])
def test_fingerprint(text):
    assert s.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("block", [20_000, 10])
def test_components_are_all_links(spark, block):
    """Against all pairs; with a small block the hot groups are split over tasks."""
    fps = fixture_fps(300)
    assert components_of(spark, fps, block=block) == brute_components(fps)


def test_plans_keep_the_pigeonhole():
    """Whatever the thresholds, any two fingerprints within 4 bits meet in a key."""
    rng = random.Random(4)
    fps = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
    for n in (10, 10_000, 10_000_000):
        parts = s.plan(fps, n)
        assert sum(t + 1 for _, t in parts) >= 5
        bits = [b for p, _ in parts for b in p]
        assert len(bits) == len(set(bits))
        for _ in range(200):
            apart = sum(1 << b for b in rng.sample(range(64), 4))
            assert any((apart & s.mask_of(p)).bit_count() <= t for p, t in parts)


def test_odd_rows(spark, odd, none):
    got = s.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fp"], r["component_id"]))
    assert by[1] == by[2] and len(by[1]) == 1
    assert {x for i in (3, 4, 5) for x in by[i]} == {(0, 3)}
    assert all(c is None for _, c in by[None])
    assert s.near_duplicates(none).count() == 0


def test_keep_one(odd, none):
    kept = s.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == [1, 3, 7, 8, 9]
    assert s.keep_one(none).count() == 0


def test_keep_one_decides_by_row(spark):
    """Null and reused ids: every component keeps exactly one row, and what is near nothing stays."""
    text = lambda k: " ".join(f"{k}{w}" for w in range(60))
    rows = [(5, text("a"), "x"), (7, text("a"), "x"), (7, text("b"), "x"), (9, text("b"), "x"), (3, text("c"), "x"), (3, text("d"), "x"), (None, text("e"), "x"), (None, text("f"), None), (None, text("f"), None), (None, text("c"), "x"), (4, text("g"), None), (4, text("g"), None), (4, text("g"), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = [(r["doc_id"], r["text"][0]) for r in s.keep_one(docs, unnamed=True).collect()]
    assert sorted(kept, key=lambda x: x[1]) == [(5, "a"), (7, "b"), (3, "c"), (3, "d"), (None, "e"), (None, "f"), (4, "g")]
    assert sorted(r["text"][0] for r in s.keep_one(docs).collect()) == list("abcdg")


def test_row_key_counts_nulls(spark):
    docs = spark.createDataFrame([("x", None), (None, "x")], "text string, lang string")
    assert docs.select(s.row_key(docs)).distinct().count() == 2


def test_hot_fingerprints_and_leftover_tables(spark, odd, tmp_path):
    key = lambda r: str(tuple(r))
    assert sorted(s.near_duplicates(odd, hot=1).collect(), key=key) == sorted(s.near_duplicates(odd).collect(), key=key)
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)], "src long, dst long")
    assert {(r["node"], r["root"]) for r in s.components(edges).collect()} == {(i, 0) for i in range(51)} | {(i, 100) for i in range(100, 140)}


def test_keep_one_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e", 1, 2), (2, "a b c d e", 1, 2)], "doc_id long, text string, `a.b` int, row int")
    assert [tuple(r) for r in s.keep_one(df).collect()] == [(1, "a b c d e", 1, 2)]


def test_hubs_of_stars(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(300 + i, 301 + i) for i in range(30)], "src long, dst long")
    want = {(i, 0) for i in range(200)} | {(i, 300) for i in range(300, 331)}
    assert {(r["node"], r["root"]) for r in s.components(edges, hot=10).collect()} == want


def test_keep_one_with_maps_and_repeats(spark):
    rows = [(1, "a b c d e", {"x": 1, "y": 2}), (1, "a b c d e", {"y": 2, "x": 1}), (2, "a b c d e", None), (3, "other words are here now", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>")
    got = s.keep_one(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]
    keys = df.select(s.row_key(df).alias("k")).distinct()
    assert keys.count() == 3 and len(keys.first()["k"]) == 2
