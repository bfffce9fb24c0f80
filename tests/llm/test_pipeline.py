from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as c

BASE = "The ships of the old harbour left in the morning and they came back with the evening tide while people waited on the wall".split()


@pytest.fixture
def sf(spark, tmp_path):
    """Documents of which each stage has something to drop or change."""
    words = lambda i: " ".join(f"{w}{'' if j % 7 else i}" for j, w in enumerate(BASE * 3))
    rows = [(i, words(i), "en", "s", 1) for i in range(1, 41)] + [(100 + i, " ".join(f"größe{i} und der über schön straße mädchen {j}" for j in range(9)), "de", "s", 1) for i in range(20)]
    rows += [(50, words(1), "en", "s", 1), (51, words(2) + " the first leaked question of a benchmark asks for its capital", "en", "s", 1), (52, None, "en", "s", 1), (53, "12 34", "en", "s", 1), (54, words(99) + " token=abcdefghijklmnop", "en", "s", 1), (54, words(99) + " token=abcdefghijklmnop", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "The first leaked question of a benchmark asks for its capital")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_stages(spark, sf):
    path, rows = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = docs
    for name, stage in c.STAGES[:-1]:
        kept = stage(spark, kept, path)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 2, 54, 100} <= set(ids)
    assert not {50, 51, 52, 53} & set(ids)


def test_run(spark, sf):
    path, rows = sf
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {i: t for i, t, *_ in rows}
    got = c.run(spark, path).collect()
    for r in got:
        e = library.encode(texts[r["doc_id"]].replace("token=abcdefghijklmnop", "[SECRET]"), add_special_tokens=False)
        assert r["n_tokens"] == len(e.ids)
        assert r["decoded_sha256"] == sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark, sf, tmp_path):
    path, _ = sf
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert c.run(spark, f"{tmp_path}/none").count() == 0


def test_near_dedup_keeps_rows_without_an_id(spark, sf):
    path, rows = sf
    docs = spark.createDataFrame([(None, "a clean text that no other row has, without an id", "en", "s", 1), *rows[:3]], spark.read.parquet(f"{path}/documents.parquet").schema)
    assert None in {r["doc_id"] for r in c.near_dedup(spark, docs, path).collect()}
