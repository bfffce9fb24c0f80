import subprocess
import sys
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pytest

from foliant.plans import registry

DATA = Path("/root/testdata/sf0.001")
#: Rows that differ only now and then show on more of them.
SIZES = ["sf0.001", "sf0.01"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple("%.9g" % r[i] if isinstance(r[i], float) else None if r[i] is None else str(r[i]) for i in order) for r in rows), key=str)


def views(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con():
    return views(DATA)


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_as_sql(spark, name, size):
    data = DATA.parent / size
    df = registry.queries()[name](spark, str(data))
    got = df.collect()
    if sql := registry.oracle_sql().get(name):
        r = views(data).sql(sql)
        assert sorted(r.columns) == sorted(df.columns)
        assert shown(got, df.columns) == shown(r.fetchall(), r.columns)


def test_library_stands_without_the_training_data_part():
    root = Path(__file__).parent.parent
    code = "import sys; sys.modules['foliant.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 50; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_seq_ratio_against_brute_force(spark, con):
    turns = con.sql("select conv_id, turn, text, coalesce(lead(text) over (partition by conv_id order by turn), '') from conversations").fetchall()
    want = {(c, t): 1.0 if not a and not b else SequenceMatcher(None, a or "", b or "").ratio() for c, t, a, b in turns}
    got = {(r["conv_id"], r["turn"]): r["ratio"] for r in registry.queries()["seq_ratio"](spark, str(DATA)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
