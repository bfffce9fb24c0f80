import io
import json
import random
import re
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from foliant.operators import audit, dedup, evaluation, merge, ordered, relational
from foliant.sources import readers, sinks
from foliant.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    sets = {i: [f"{'stem' * 6}{rng.randint(0, 12)}" for _ in range(rng.randint(1, 12))] for i in range(60)}
    for i in range(60, 75):
        sets[i] = [*sets[i - 60]]
        if i % 2:
            sets[i][0] = "x" * 30
    df = spark.createDataFrame([(k, s) for k, v in sets.items() for s in v], "key int, text string")
    known = dedup.classes(dedup.stems(df, "key", "text"))
    got = {(r["x"], r["y"]) for r in dedup.similar_pairs(known).collect()}
    reps = {r["key"]: r["rep"] for r in known.collect()}
    want = set()
    for x in sets:
        for y in sets:
            if x < y and abs(len(sets[x]) - len(sets[y])) <= 3 and len({*sets[x]} & {*sets[y]}) / max(len({*sets[x]}), len({*sets[y]})) >= 0.85:
                want.add((x, y))
    alike = {k: min(x for x in sets if set(sets[x]) == set(sets[k]) and len(sets[x]) == len(sets[k])) for k in sets}
    assert reps == alike
    assert got == {(x, y) for x, y in want if reps[x] == x and reps[y] == y} and got
    assert {(min(reps[x], reps[y]), max(reps[x], reps[y])) for x, y in want if reps[x] != reps[y]} == got  # no link between different texts is lost


@pytest.mark.parametrize("policy", [merge.merge_printed, merge.merge_new_first, merge.merge_old_first, merge.merge_blank])
def test_merges_are_idempotent(spark, policy):
    values = [None, "", "v"]
    old = spark.createDataFrame([(i, *[values[(i // 3**k) % 3] for k in range(4)], None) for i in range(81)], "id int, answer string, solution string, topic string, difficulty string, answer_source string")
    new = spark.createDataFrame([(i, *[[None, "", "n"][(i * 7 // 3**k) % 3] for k in range(4)]) for i in range(0, 81, 2)], "id int, answer string, solution string, topic string, difficulty string")
    once = policy(old, new, ["id"])
    assert sorted(once.columns) == sorted(old.columns) and once.count() == 81
    assert rows(once.select(*old.columns), "id") == rows(policy(once, new, ["id"]).select(*old.columns), "id")


def test_merge_precedence(spark):
    old = spark.createDataFrame([(1, "o", "o", "o", "o", None), (2, "o", "o", "o", "o", "x")], "id int, answer string, solution string, topic string, difficulty string, answer_source string")
    new = spark.createDataFrame([(1, "", "n", "", "n")], "id int, answer string, solution string, topic string, difficulty string")
    cols = ["id", "answer", "solution", "topic", "difficulty", "answer_source"]
    assert rows(merge.merge_printed(old, new, ["id"]).select(cols), "id") == [(1, None, "n", "o", "n", None), (2, "o", "o", "o", "o", "x")]
    assert rows(merge.merge_new_first(old, new, ["id"]).select(cols), "id")[0] == (1, "o", "n", "o", "n", None)


def test_solved(spark):
    schema = "id int, answer string, solution string, answer_source string"
    old = spark.createDataFrame([(1, None, None, None), (2, "", None, None), (3, "kept", None, None), (4, None, None, None), (5, None, None, None)], schema)
    side = "id int, answer string, solution string, confidence string"
    long = "x" * 61
    a = spark.createDataFrame([(1, "(x+1)(x+2)", "", "high"), (2, "3", "s", "low"), (3, "1", "s", "high"), (4, long, "essay", "high"), (5, "7", "s", "high")], side)
    b = spark.createDataFrame([(1, "(x+2)(x+1)", "t", None), (2, "4", "s", "low"), (3, "1", "s", "high"), (4, long, "essay", "high")], side)
    got = rows(merge.merge_solved(old, a, b, ["id"]).select("id", "answer", "solution", "answer_source"), "id")
    assert got == [(1, "(x+1)(x+2)", "t", "computed:medium"), (2, "", None, None), (3, "kept", None, None), (4, None, "essay", None), (5, None, None, None)]


def test_reading_order_and_boxes(spark):
    boxes = spark.createDataFrame([("p", 1, 50.0, 0.0, 90.0, 10.0), ("p", 2, 0.0, 1.0, 40.0, 11.0), ("p", 3, 0.0, 20.0, 40.0, 30.0), ("p", 4, 5.0, 2.0, 10.0, 3.0)], "page string, box int, x0 double, y0 double, x1 double, y1 double")
    got = ordered.reading_order(boxes.withColumnRenamed("box", "id"), "page")
    assert [r["id"] for r in got.orderBy("place").collect()] == [2, 4, 1, 3]
    assert sorted(r["box"] for r in ordered.outer_boxes(boxes, "page").collect()) == [1, 2, 3]


def test_accepted_renumbered_tail(spark):
    df = spark.createDataFrame([([3, 1, 1, 2, 5, 3, 9, 4],)], "n array<int>")
    assert df.select(ordered.accepted(F.col("n"))).first()[0] == [1, 2, 3, 4]
    labels = spark.createDataFrame([("a", 1, "1"), ("a", 2, "1"), ("b", 1, "1"), ("b", 2, None)], "g string, o int, label string")
    assert [r["label"] for r in ordered.renumbered(labels, "g", "o", "label").orderBy("g", "o").collect()] == ["1", "2", "1", None]
    tail = spark.createDataFrame([("a", i, i > 3) for i in range(1, 6)] + [("b", i, i > 1) for i in range(1, 6)], "g string, o int, f boolean")
    assert rows(ordered.tail_trimmed(tail, "g", "o", F.col("f")).groupBy("g").count(), "g") == [("a", 3), ("b", 5)]


def test_gate(spark):
    def exam(i, **kw):
        base = {"n": 15, "first": 1, "choices": 5, "unresolved": False, "printed": 4.0, "score": 4.0} | kw
        return [(i, base["first"] + k, base["choices"], base["unresolved"], [base["printed"]] if base["printed"] else [], base["score"]) for k in range(base["n"])]

    data = exam(1) + exam(2, n=14) + exam(3, first=2) + exam(4, unresolved=True) + exam(5, choices=4) + exam(6, printed=5.0) + exam(7, printed=None, score=None)
    got = dict(rows(audit.gate(spark.createDataFrame(data, "exam_id int, number int, n_choices int, unresolved boolean, printed array<double>, score double")), "exam_id"))
    assert got == {1: None, 2: "few questions", 3: "numbering", 4: "unresolved glyphs", 5: "choices", 6: "scores", 7: None}


def test_question_findings(spark, tmp_path):
    text = lambda v: [{"type": "text", "value": v}]
    choices = lambda n, blank=False: [{"number": i, "contents": text("" if blank and not i else "c")} for i in range(n)]
    questions = [
        {"number": 1, "type": "mcq", "contents": text("ok {x}"), "choices": choices(5), "answer": "③", "score": "3.0"},
        {"number": 2, "type": "mcq", "contents": text("ok"), "choices": choices(4, True), "answer": "⑤"},
        {"number": 3, "type": "essay", "contents": text(" {"), "choices": choices(2)},
        {"number": 4, "type": "essay", "contents": text(""), "subquestions": [{"number": 1, "contents": text("x")}]},
        {"number": 5, "type": "essay", "contents": []},
    ]
    (tmp_path / "7.json").write_text(json.dumps({"questions": questions}))
    (tmp_path / "8.json").write_text('{"questions": [')
    (tmp_path / "9.answers.json").write_text("{}")
    read = readers.json_files(spark, str(tmp_path), readers.EXAM, without="*.answers.json")
    good, broken = readers.split_corrupt(read.cache())
    assert [r["file"] for r in broken.collect()] == ["8.json"]
    q = good.select("exam_id", F.explode("questions").alias("q")).select("exam_id", "q.*")
    got = {r["number"]: r["findings"] for r in audit.question_findings(q).collect()}
    assert got == {2: ["choices", "empty choice", "answer beyond choices"], 3: ["choices without MCQ", "unbalanced markup"], 5: ["empty stem"]}
    assert {r["exam_id"] for r in q.collect()} == {7}


def test_scores_and_mining(spark):
    a, b = "tide " * 60, "diet " * 60
    df = spark.createDataFrame([("s", a, b), ("t", "", None)], "id string, a string, b string")
    got = dict(rows(df.select("id", evaluation.seq_ratio("a", "b")), "id"))
    assert got == {"s": SequenceMatcher(None, a, b).ratio(), "t": 1.0}
    pairs = spark.createDataFrame([("s", "값은 12.345 이다", "값은 12.35 이다"), ("s", "same", "same")], "sample_id string, g_text string, c_text string")
    assert [(r["category"]) for r in evaluation.mined(pairs).collect()] == ["DECIMAL"]
    cells = spark.createDataFrame([([["a", "b"], ["c"]], [["a", "x"], ["c", "d"]])], "c array<array<string>>, g array<array<string>>")
    assert cells.select(evaluation.cell_accuracy(F.col("c"), F.col("g"))).first()[0] == 0.5


def test_sample_scores(spark):
    schema = "sample_id string, c_text string, g_text string, c_equations string, g_equations string, c_n_choices int, g_n_choices int, c_types array<string>, g_types array<string>, c_number int, g_number int"
    pairs = spark.createDataFrame([("a", "x y", "xy", "", "", 5, 5, ["text"], ["text"], 1, 1), ("b", "x", "y", "1", "2", 4, 5, ["text"], ["table"], 2, 1)], schema)
    counts = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 0, 0)], "sample_id string, c_n int, g_n int")
    got = {r["sample_id"]: r["regressions"] for r in evaluation.sample_scores(pairs, counts).collect()}
    assert got == {"a": [], "b": ["QUESTION_COUNT", "CHOICE_COUNT", "CONTENT_TYPE_DRIFT", "NUMBER_MISMATCH", "EQUATION_DRIFT"], "c": []}


def test_surrogate_ids_and_matches(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(100)], "k int, i int")
    got = audit.surrogate_ids(df, ["k", "i"]).orderBy("k").collect()
    assert [r["id"] for r in got] == list(range(1, 101))
    stable = audit.stable_ids(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, g int"), spark.createDataFrame([(1, "a", None), (2, "a", 1), (3, "z", 1), (4, None, None)], "id int, s string, g int"), "id", ["s", "g"])
    assert dict(rows(stable, "id")) == {1: "ok", 2: "shifted", 3: "mislabeled", 4: "weak"}
    wild = relational.wildcard_match(spark.createDataFrame([(1, "a", None), (2, None, None)], "key int, s string, g int"), spark.createDataFrame([(7, "a", 1), (8, "b", 1)], "id int, s string, g int"), ["s", "g"], "key")
    assert rows(wild, "key") == [(1, 7)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "inv.tsv").write_text("﻿/a/b.pdf\t10\t2024-01-01\n\n/c \"d.hwp\t5\t2023-01-01\n", encoding="utf-8")
    assert rows(readers.inventory(spark, str(tmp_path / "inv.tsv")).select("path", "size"), "path") == [("/a/b.pdf", 10), ('/c "d.hwp', 5)]
    with zipfile.ZipFile(tmp_path / "x.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", "<a/>")
        z.writestr("other.txt", "no")
    assert [tuple(r)[1:] for r in readers.zipped_xml(spark, str(tmp_path / "x.hwpx")).collect()] == [("Contents/section0.xml", "<a/>")]
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    batch = spark.createDataFrame([(1, "z")], "id int, v string")
    loaded = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(sinks.reloaded(table, batch, "id", loaded), "id") == [(1, "z")]
    sinks.export_jsonl(spark.createDataFrame([(1, None)], "id int, v string"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"id": 1, "v": None}


def test_publish_halves_failing_chunks(spark, tmp_path):
    path = str(tmp_path)

    def send(batch):
        if len(batch) > 3:
            raise ConnectionError
        with open(f"{path}/{batch[0]['id']}", "w") as f:
            f.write(",".join(str(r["id"]) for r in batch))

    sinks.publish(spark.range(25), send, chunk=10)
    assert sorted(int(x) for p in tmp_path.iterdir() for x in p.read_text().split(",")) == list(range(25))


def test_streams(spark, tmp_path):
    source, state, sent = (str(tmp_path / x) for x in ("in", "state", "sent"))
    schema = "id int, o int, v string"
    for k, data in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 1, "a"), (2, 1, "c")], [(1, 1, "a"), (2, 1, "c")], [(1, 1, "d"), (2, 1, "c")], [(1, 1, "d"), (2, 1, "c")]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.publish_changes(stream, "id", "o", ["v"], state, lambda d: d.write.mode("append").parquet(sent), str(tmp_path / "checkpoint"), compact=2).awaitTermination()
        assert spark.read.parquet(sent).count() == (2, 3, 3, 4, 4)[k]
    assert sorted(x.name for x in (tmp_path / "state").iterdir() if x.name.startswith("gen")) == ["gen=2"]
    events = spark.createDataFrame([("2024-01-01 00:01:00", "x", 1.0), ("2024-01-01 00:04:00", "x", 2.0), ("2024-01-01 00:06:00", "x", 4.0)], "ts string, kind string, value double")
    assert [(r["n"], r["total"]) for r in incremental.windowed(events, "ts", "kind").orderBy("start").collect()] == [(2, 3.0), (1, 4.0)]
    meta = spark.createDataFrame([("ready", "a/b.pdf", None), ("draft", None, "")], "status string, reference_pdf string, ref_pdf string")
    assert [r["reasons"] for r in incremental.readiness(meta).collect()] == [[], ["status", "no reference"]]


def test_hot_groups_in_ranges(spark):
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.1 else 1 if rng.random() < 0.7 else rng.randrange(4), i, rng.choice(["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int, v string").repartition(5)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(ordered.carried(df, "g", "i", "v", "x", most=20), ordered.carried(df, "g", "i", "v", "x"))
    assert same(ordered.islands(df, "g", ["i"], "v", most=20), ordered.islands(df, "g", ["i"], "v"))
    right = df.filter("i % 3 = 0").select("g", "i", F.col("i").alias("w"))
    assert same(ordered.last_before(df, right, "g", "i", "w", most=20), ordered.last_before(df, right, "g", "i", "w"))
    assert ordered.carried(df.limit(0), "g", "i", "v", "x", most=20).count() == 0


def test_vocabulary_of_any_size_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcABé ") for _ in range(rng.randint(0, 5)))
    entries = sorted({word() for _ in range(400)} | {"only", "a b", "Ab"})
    names = [word() for _ in range(500)] + [None, "", " ", "xonlyx", "ONLY"] + ["abc"] * 200
    bare = lambda x: re.sub(r"\s+", "", x or "").lower()
    want = []
    for i, n in enumerate(names):
        if n in entries:
            want.append((i, n, 0))
        elif bare(n) and (same := [e for e in entries if bare(e) == bare(n)]):
            want.append((i, same[0], 1))
        elif bare(n) and (near := [e for e in entries if bare(e) and (bare(e) in bare(n) or bare(n) in bare(e))]):
            want.append((i, near[0], 2))
        else:
            want.append((i, None, None))
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = relational.found_in_order(rows, spark.createDataFrame([(e,) for e in entries] + [("only",)], "entry string"), "i", "name")
    assert sorted(map(tuple, got.collect())) == want


def test_counts_go_on_after_a_restart(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    for k, n in enumerate([7, 5, 9, 1, 8]):
        spark.range(n).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        incremental.counted_batches(stream, lambda b, total: seen.append((b, total)), str(tmp_path / "checkpoint"), 10).awaitTermination()
        assert seen == [(1, 12), (2, 21), (4, 30)][: [0, 1, 2, 2, 3][k]]


def test_keys_in_many_batches_are_published_once(spark, tmp_path):
    source, state, sent, checkpoint = (str(tmp_path / x) for x in ("in", "state", "sent", "checkpoint"))
    schema = "k string, o int, v string, key int"
    steps = [
        ([[("a", 1, "x", 1), ("b", 1, "x", 1)], [("a", 2, "y", 1)], [(None, 1, "n", 1)]], {"a": 2, "b": 1, None: 1}),
        ([[("a", 2, "y", 1)]], {}),  # the same again
        ([[("b", 1, "z", 1)], [("b", 1, "x", 1)]], {}),  # there and back
        ([[("a", 1, "w", 1)], [("c", 1, None, 1)]], {"a": 4, "c": 1}),
        ([[("c", 1, "", 1)]], {"c": 2}),  # null is not empty
    ]
    for files, want in steps:
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.watched(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "k", "o", ["v"], state, checkpoint)
        incremental.published(spark.read.schema(schema).parquet(source), "k", state, lambda d: d.write.mode("overwrite").parquet(sent))
        incremental.published(spark.read.schema(schema).parquet(source), "k", state, lambda d: pytest.fail("sent again"))
        got = {r["k"]: r["n"] for r in spark.read.schema(schema).parquet(sent).groupBy("k").agg(F.count("*").alias("n")).collect()}
        assert got == want


def test_signatures_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(5), i % 40, str(i % 40)) for i in range(200)]
    found = []
    for name, cut in (("one", [rows]), ("many", [rows[i::7] for i in range(7)])):
        for part in cut:
            spark.createDataFrame(part, "k int, o int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema("k int, o int, v string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / name / "in"))
        incremental.watched(stream, "k", "o", ["v"], str(tmp_path / name / "state"), str(tmp_path / name / "checkpoint"))
        noted = spark.read.parquet(str(tmp_path / name / "state" / "changed"))
        found.append({r["key"]: r["s"] for r in noted.groupBy("key").agg(F.max_by("signature", "batch").alias("s")).collect()})
    assert found[0] == found[1] and len(found[0]) == 5


def test_order_dependent_operators_on_hot_groups(spark):
    """Cut into ranges or not, with an unknown group, and columns named like helpers."""
    rng = random.Random(11)
    rows = [(None if rng.random() < 0.1 else 1 if rng.random() < 0.7 else rng.randrange(4), i, rng.randint(1, 4), rng.choice(["1", "2", None]) if i % 9 else "3", rng.choice([" ", "x", "y"]), rng.random() < 0.5, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int, n int, label string, c string, m boolean, __p int").repartition(6)
    same = lambda f: sorted(map(str, f(20).collect())) == sorted(map(str, f(10**6).collect()))
    assert same(lambda most: ordered.numbered(df, "g", ["i"], "k", most))
    assert same(lambda most: ordered.segments(df, "g", "i", most))
    assert same(lambda most: ordered.reordered(df, "g", "i", "n", most))
    assert same(lambda most: ordered.renumbered(df, "g", "i", "label", most))
    assert same(lambda most: ordered.spaced_islands(df, "g", ["i"], "m", "c", most=most))
    lines = df.select("g", "i", F.concat(F.col("n").cast("string"), F.lit(". "), "c").alias("t"))
    assert same(lambda most: ordered.skeleton(lines, "g", "i", "t", most=most))
    by = {}
    for g, i, n, *_ in sorted(rows, key=lambda r: r[1]):
        by.setdefault(g, []).append((i, n))
    want = {(g, i): {m for j, m in by[g] if j < i and j % 2} for g in by for i, _ in by[g]}
    got = ordered.earlier_essays(df, "g", "i", "n", F.col("i") % 2 == 1).collect()
    assert {(r["g"], r["i"]): set(r["earlier"]) for r in got} == want and df.columns == [c for c in got[0].asDict() if c != "earlier"]
    kept = {(r["g"], r["i"]) for r in ordered.tail_trimmed(df, "g", "i", F.col("m")).collect()}
    for g, own in by.items():
        flags = {r[1]: r[5] for r in rows if r[0] == g}
        tail = 0
        while tail < len(own) and flags[own[-1 - tail][0]]:
            tail += 1
        gone = tail if tail <= 0.5 * len(own) else 0
        assert {i for h, i in kept if h == g} == {i for i, _ in own[: len(own) - gone]}
