import random
import re
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from foliant.llm import fill_middle as f
from foliant.llm import queries


def plainly(doc_id, text):
    """The contract, written out for one row."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest, n = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(units)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    return doc_id, n, *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def rows():
    rng = random.Random(5)
    parts = ["word", "Zé", " ", "\n", "漢", "😀", "x", "1", "\x00", "", "<", "P>", "<P>", "'s"]
    made = [(i, "".join(rng.choice(parts[:12]) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    return [*made, (1000, "a"), (1001, "<M> here"), (1002, "letters" * 5_000), (1003, ""), (1004, None), (None, "no number"), (7, "again"), (7, "again")]


def test_same_as_plain_python(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    got = sorted(map(tuple, f.transform(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=str)
    assert got == sorted((plainly(*r) for r in rows()), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = f.transform(df).select("doc_id", f.restored(f.F.col("output"), f.F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in rows()), key=str)


@pytest.mark.parametrize("window", [1, 2, 3, 7, 50, 1 << 20])
def test_windows_change_nothing(window):
    rng = random.Random(window)
    texts = ["".join(rng.choice(["ab", "c", "é", " ", "漢", "Q", "1"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    flat, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    draws = np.array([[rng.randrange(1 << 32) for _ in texts] for _ in range(2)])
    n, where, chars = f.cuts(flat, at, draws, window)
    for i, t in enumerate(texts):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)
        assert n[i] == len(units)
        for k, c in enumerate(sorted(int(d) % (len(units) + 1) for d in draws[:, i])):
            before = "".join(units[:c])
            assert where[k, i] - at[i] == len(before.encode()) and chars[k, i] == len(before)


def test_odd_rows(odd, none):
    got = sorted(map(tuple, f.transform(odd).collect()), key=str)
    assert got == sorted((plainly(r["doc_id"], r["text"]) for r in odd.collect()), key=str)
    assert f.digests(none).count() == 0


def test_same_as_sql(spark):
    df = spark.createDataFrame([r for r in rows() if "\x00" not in (r[1] or "")], "doc_id long, text string")
    documents = df.toArrow()  # noqa: F841  read by DuckDB
    sql = duckdb.sql(queries.oracle_sql()["op12_fill_middle"])
    got = f.digests(df).select(*sql.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(sql.fetchall(), key=str)
