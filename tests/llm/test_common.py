import random

import pytest

from foliant.llm import common, url_filter


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_meet_their_facts(spark, how):
    rng = random.Random(2)
    rows = spark.createDataFrame([(None if rng.random() < 0.05 else 1 if rng.random() < 0.5 else rng.randrange(30), i) for i in range(200)], "k int, i int")
    facts = spark.createDataFrame([(k, f"f{k}") for k in range(20)], "k int, f string")
    want = sorted(map(str, rows.join(facts, ["k"], how).collect()))
    got = common.hot_join(rows, facts, ["k"], 200, how, hot=10)
    assert got.columns == ["k", "i", "f"] and sorted(map(str, got.collect())) == want
    assert sorted(map(str, common.hot_join(rows, facts, ["k"], 200, how, hot=190).collect())) == want


def test_templates_of_hot_hosts_are_the_same(spark):
    rng = random.Random(3)
    urls = [("hot" if i % 2 else f"h{i % 5}", f"/a/{rng.choice('xyz')}{rng.choice('pqrstuvw')}/{rng.choice('mn')}") for i in range(400)]
    df = spark.createDataFrame(urls, "host string, path string")
    labels = spark.createDataFrame([(h, p, rng.random() < 0.5) for h, p in urls[:200]], "host string, path string, good boolean")
    shapes = url_filter.templates(df, labels)
    assert sorted(map(str, url_filter.purity(shapes, hot=5).collect())) == sorted(map(str, url_filter.purity(shapes).collect()))
    for level in (1, 2, 3):
        assert sorted(map(str, url_filter.generalised(shapes, level, hot=5).collect())) == sorted(map(str, url_filter.generalised(shapes, level).collect()))


def test_hot_nulls_stay_and_meet_nothing(spark):
    rows = spark.createDataFrame([(None, i) for i in range(300)] + [(1, i) for i in range(20)], "k int, i int")
    facts = spark.createDataFrame([(1, "a"), (None, "b")], "k int, f string")
    got = common.hot_join(rows, facts, ["k"], 320, hot=10)
    assert got.groupBy("f").count().collect() and {r["f"]: r["count"] for r in got.groupBy("f").count().collect()} == {None: 300, "a": 20}
