"""What grows with the tables: how rows reach Python, how many tasks share them, and joins on keys that repeat."""

import io
import math
import random
import zipfile
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import fragments as fr
from foliant.functions import equations, glyphs, shapes, splitting
from foliant.functions import text as tx
from foliant.operators import audit, ordered, relational
from foliant.plans import registry
from foliant.sources import readers
from foliant.sources.readers import BLOCK

DATA = Path("/root/testdata/sf0.01")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_reach_python_as_text_and_whole(spark):
    """Columns of blocks cost 300 microseconds a row of eight blocks, texts 30; nothing may be lost on the way."""
    rows = [(1, [("table", "v", [["a", None], None], [1.5, math.inf, None], 3, True, False, None), ("figure", None, [], [], None, None, None, True), None]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, f"i int, b array<{BLOCK}>")
    got = df.select("i", "b", fr.fragments_merged(F.col("b"), "signs").alias("m"))
    assert "StructsToJson" in plan(got)
    for r in got.collect():
        assert r["m"] == (None if r["b"] is None else [b for b in r["b"] if b is not None])
    nan = spark.createDataFrame([([("text", "v", None, [math.nan], None, None, None, None)],)], f"b array<{BLOCK}>")
    assert math.isnan(nan.select(fr.fragments_merged(F.col("b"), "signs").alias("m")).first()["m"][0]["bbox"][0])


def test_points_and_boxes_in_few_places(spark):
    """400 million pairs before: copies of a box and points of one place met each other; rows of one id each keep their own box."""
    points = spark.range(40_000).selectExpr("id div 2 as id", "id % 4 as page", "double(id % 10) as x", "double(id % 7) as y")
    boxes = spark.range(40_000).selectExpr("id + 5 as box", "id % 4 as page", "double(id % 2) * 3 as x0", "double(id % 2) * 3 + 4 as x1", "0d as y0", "5d as y1")
    got = ordered.point_in_box(points, boxes, "page")
    first = {}
    for i in range(40_000):
        first.setdefault((i % 4, i % 2 * 3.0), i + 5)
    want = lambda r: min((b for (page, x0), b in first.items() if page == r["page"] and x0 <= r["x"] <= x0 + 4 and r["y"] <= 5), default=None)
    rows = got.collect()
    assert len(rows) == 40_000 and all(r["box"] == want(r) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_parts_beyond_a_million(spark, tmp_path):
    """The SQL orders an order's lines by one number, in which such a part comes behind the next line."""
    con = duckdb.connect()
    con.sql(f"copy (select * replace(l_partkey * 613 % 1300000 as l_partkey) from '{DATA}/lineitem.parquet' where l_orderkey < 3000) to '{tmp_path}/lineitem.parquet'")
    con.sql(f"create view lineitem as from '{tmp_path}/lineitem.parquet'")
    got = registry.queries()["signs_joined"](spark, str(tmp_path)).select("order_id", "place", "type", "value").collect()
    want = con.sql(f"select order_id, place, type, value from ({registry.oracle_sql()['signs_joined']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_ids_lost_among_many_of_one_value(spark):
    """900 million pairs before, of rows whose first field is one value; a first field that is not known leaves the second to look by."""
    now = spark.range(30_000).selectExpr("id", "'a' as s", "id % 100 as g")
    then = spark.range(30_000).selectExpr("id + 1 as id", "if(id % 3 = 0, null, 'a') as s", "if(id % 7 = 0, 100, id % 100) as g")
    got = {r["id"]: r["verdict"] for r in audit.stable_ids(now, then, "id", ["s", "g"]).collect()}
    assert got == {i + 1: "mislabeled" if i % 7 == 0 else "shifted" for i in range(30_000)}


def test_windows_of_long_texts_in_one_pass(spark):
    """Each window was counted out from the text's start: minutes for these texts; signs beyond the basic plane and line ends are characters."""
    texts = ["ab\n" * 100_000, "가😀나\r\n" * 20_000, "x" * 12, "x" * 13, "y" * 18, "", None]
    df = spark.createDataFrame(list(enumerate(texts * 4)), "i int, x string")
    for r in df.select("i", "x", tx.windows(F.col("x")).alias("w"), relational.grams(F.substring("x", 1, 500), 2, 3).alias("g")).collect():
        x = r["x"]
        assert r["w"] == (None if x is None else [] if not x else [x] if len(x) <= 12 else [x[k : k + 12] for k in range(0, len(x) - 11, 6)])
        assert x is None or r["g"] == list(dict.fromkeys(x[:500][k : k + n] for n in (2, 3) for k in range(len(x[:500]) - n + 1)))


def test_zips_and_spans_leave_python_in_pieces(spark):
    """More than one piece of each batch, the same rows."""
    def packed(n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k in range(3):
                z.writestr(f"section{k}.xml", str(n) * 300_000)
        return out.getvalue()

    files = spark.createDataFrame([(str(n), bytearray(packed(n) if n % 5 else b"broken")) for n in range(10)], "path string, content binary").coalesce(1)
    got = sorted((r["path"], r["entry"], r["n"]) for r in readers.unzipped(files).select("path", F.coalesce("entry", F.lit("")).alias("entry"), F.length("xml").alias("n")).collect())
    assert [g for g in got if g[1]] == [(str(n), f"section{k}.xml", 300_000) for n in range(10) if n % 5 for k in range(3)] and len(got) == 26
    texts = [None if i % 50 == 3 else f"값은 x_{i % 90}=3이다." for i in range(splitting.FEW * 3 + 5)]
    spans = spark.createDataFrame(list(enumerate(texts)), "i int, x string").coalesce(1).select("i", splitting.split(F.col("x")).alias("s")).collect()
    assert [(r["i"], "".join(s["raw"] for s in r["s"])) for r in spans] == [(i, t or "") for i, t in enumerate(texts)]


def test_many_pairs_in_few_bytes(spark, tmp_path):
    """0.53 bytes a pair before, and more the more ids there are; a known row's empty field matches no field that is given."""
    rows = spark.range(5_000).selectExpr("id as key", "if(id % 3 = 0, null, id % 2) as g", "if(id % 3 = 1, null, 'a') as s")
    known = spark.range(4_000).selectExpr("id", "int(if(id % 5 = 0, null, id % 2)) as g", "if(id % 4 = 0, null, 'a') as s")
    relational.wildcard_match(rows, known, ["g", "s"], "key").write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    con.sql("create view r as select range as key, if(range % 3 = 0, null, range % 2) as g, if(range % 3 = 1, null, 'a') as s from range(5000)")
    con.sql("create view k as select range as id, if(range % 5 = 0, null, range % 2) as g, if(range % 4 = 0, null, 'a') as s from range(4000)")
    con.sql(f"create view o as from '{tmp_path}/out/*.parquet'")
    want = con.sql("select count(*), sum(hash(key::bigint, id::bigint)::hugeint) from r join k on (r.g is null or r.g = k.g) and (r.s is null or r.s = k.s)").fetchall()
    got = con.sql("select count(*), sum(hash(key, id)::hugeint) from o").fetchall()
    assert got == want
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * got[0][0]


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["letters_styled", "relations_joined", "lists_cut", "formulas_found", "choices_read", "equation_depth", "equation_scripts", "equation_latex"])
def test_rows_are_dealt_out_before_python(spark, name):
    """A file of one row group went through Python in one task."""
    assert "RepartitionByExpression" in plan(registry.queries()[name](spark, str(DATA)))


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_orders_are_dealt_out_before_their_glyphs(spark):
    """All glyphs of a row group were laid out in one task, and they, not the orders, were shuffled."""
    made = plan(registry.queries()["glyph_equations"](spark, str(DATA)))
    assert made.index("RepartitionByExpression") > made.index("posexplode")


def test_glyphs_are_read_by_columns():
    """As read one by one, whatever is null, in slices too; half a millisecond a run went into dictionaries."""
    g = {"c": "a", "x0": 0.0, "x1": 1.0, "y0": 0.0, "y1": 1.0, "size": 1.0}
    lists = [[g], None, [], [g, None, {**g, "size": None}, {**g, "c": "{"}], [{**g, "c": None}], [{**g, "x0": 3.0, "x1": 4.0}, g]] * 2
    x = pa.array(lists, pa.list_(pa.struct([("c", pa.string()), *[(n, pa.float64()) for n in ("x0", "x1", "y0", "y1", "size")]])))
    for part in (x, x[3:], x[1:8], x[:0]):
        want = [[glyphs.glyph(**v) for v in r or [] if v and None not in v.values()] for r in part.to_pylist()]
        assert list(glyphs.runs(part)) == want


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_names_are_parsed_once_a_row(spark):
    """The filter on what was parsed held every pattern again, for each of its columns; one row group was one task."""
    made = plan(registry.queries()["file_names"](spark, str(DATA)))
    assert "RepartitionByExpression" in made and made.count("학기(중간|기말)_") < 20


def test_equations_of_one_shape_are_read_once(spark):
    """Every equation was read token by token, half a millisecond each way, and its spellings took fifteen patterns in Spark."""
    met = []
    nested = [(f"{c} over {{" * (n := 1 + k % 5)) + f"sqrt {{x_{k}}}" + "}" * n + f" LEQ x^2 over {n}" for k, c in zip(range(3_000), range(10_000, 13_000))]
    assert shapes.worked(lambda s: met.append(s) or equations.latex_of(s), pa.array(nested)).to_pylist() == [equations.latex_of(s) for s in nested]
    assert len(met) < 200
    df = spark.createDataFrame([(s,) for s in nested], "x string").select(equations.to_script(equations.to_latex(F.col("x"))).alias("s"))
    assert "regexp_replace" not in plan(df)
    assert [r["s"] for r in df.collect()] == [equations.any_script_of(equations.latex_of(s)) for s in nested]


def test_digits_that_move_repeat_or_go(monkeypatch):
    """Of shapes shared or not, known from a batch before or not, long or not; marks in circles go by their value; in slices and beside nulls."""
    monkeypatch.setattr(shapes, "AT_ONCE", 40)
    rng = random.Random(3)
    backwards = lambda s: s[::-1] + s[:1]
    fs = [equations.latex_of, equations.any_script_of, equations.inline_latex_of, backwards, lambda s: "7" + s[2:4] + "0"]
    forms = ["LEFT 1 LEFT 23 x RIGHT 4 y RIGHT", "x²³ over 2", "root 3 of {1} $4 over 5$ 가6", "٣4 over 5", r"\frac12^{3}", r"\textcircled{13} \textcircled{ 2}", r"\textcircled{1}" + "2" * 90, "12" * 400 + "가" * 200, "x", ""]
    varied = lambda s: "".join(rng.choice("0123456789") if "0" <= c <= "9" else c for c in s)
    for _ in range(3):
        texts = [None, *(varied(s) for s in forms for _ in range(rng.choice([1, 5, 30]))), None]
        rng.shuffle(texts)
        for f in fs:
            got = shapes.worked(f, pa.array(["before", *texts], pa.string())[1:], r"\textcircled")
            assert got.type == pa.string() and got.to_pylist() == [None if t is None else f(t) for t in texts]
    assert shapes.worked(len, pa.array([], pa.string())).to_pylist() == [] and shapes.worked(len, pa.array([None], pa.string())).to_pylist() == [None]


def test_few_shapes_are_remembered(monkeypatch):
    monkeypatch.setattr(shapes, "REMEMBERED", 20)
    monkeypatch.setattr(shapes, "KNOWN", {})
    texts = [f"{'a' * (k % 50)}{k}" for k in range(2_000)]
    for _ in range(2):
        assert shapes.worked(str.upper, pa.array(texts)).to_pylist() == [t.upper() for t in texts]
    assert len(shapes.KNOWN) == 20


def shuffled(spark, made):
    """The most bytes that a stage of made() read from shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    rows = made().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    after = stages()
    return rows, max(s.shuffleReadBytes() for s in map(after.apply, range(after.size())) if s.stageId() not in known)


def test_percentiles_of_many_different_values(spark):
    """All different values of a group met in one task, twice: 7.3 MB of shuffle for these, and the more the larger the table."""
    rows = spark.range(0, 600_000, 1, 4).selectExpr("'g' as g", "double(id * 7919 % 600000) as v")
    (got,), read = shuffled(spark, lambda: relational.robust(rows, "v", "g"))
    assert (got["g"], got["mean"], got["median"], got["most"], got["n"]) == ("g", 299999.5, 299999.5, 599999.0, 600_000)
    assert got["p95"] == pytest.approx(599_999 * 0.95, abs=1e-6)
    assert read < 400_000


@pytest.mark.parametrize("edges", ["sketched", "least", "reversed", "null"])
def test_percentiles_in_stretches(spark, monkeypatch, edges):
    """As Spark's own percentile of all values at once, wherever the edges lie: ties, few values, nulls, NaN and infinity, groups of null and of nothing."""
    sketch = F.approx_percentile
    bad = {"least": lambda v, *_: F.array(*[F.min(v)] * 4), "reversed": lambda v, *a: F.reverse(sketch(v, *a)), "null": lambda v, *_: F.array(*[F.lit(None).cast("double")] * 4)}
    odd = "case when g = 'ties' then id % 3 when g = 'one' then 7 when g = 'none' then null when g = 'odd' and id % 4 = 0 then double('NaN') when g = 'odd' and id % 4 = 1 then double('-inf') when id % 11 = 0 then null else pow(id * 7919 % 3001, 3) / 7 end"
    rows = spark.range(0, 9_000, 1, 3).selectExpr("id", "element_at(array('ties', 'one', 'none', 'odd', 'plain', null), int(id % 6) + 1) as g", "int(id % 2) as h").selectExpr("g", "h", f"double({odd}) as v")
    rows = rows.unionByName(spark.createDataFrame([("two", 0, 1.0), ("two", 0, 2.0), ("single", 1, 5.0)], rows.schema))
    cases = [(["g"], rows, 0), (["g", "h"], rows, 500), ([], rows, 0), ([], rows.filter("g = 'absent'"), 0)]
    for by, some, many in cases if edges == "sketched" else cases[:1]:
        v = F.col("v")
        want = some.groupBy(*by).agg(F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("most"), F.count(v).alias("n")).collect()
        with monkeypatch.context() as m:
            m.setattr(relational.F, "approx_percentile", bad.get(edges, sketch))
            got = relational.robust(some, "v", *by, many=many)
        assert got.columns == [*by, "mean", "median", "p95", "most", "n"]
        assert sorted(map(str, map(tuple, got.drop("mean").collect()))) == sorted(map(str, map(tuple, want)))
