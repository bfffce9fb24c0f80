import math
import random
import re
from collections import Counter

import public_tokenizers as p
import pytest
from pyspark.sql import functions as F

from foliant.llm import quality_rules as q

ARGS = (p.path("piece_bpe_32k.model"), p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "b", "cé", "#x|", "\n", "\n\n", "\t", "\r\n", "\x85", "\xa0", "日本", "<>", "d"]
    texts = [None, "", "\n\n", "a b a b a b", *("".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(150))]
    got = {r["doc_id"]: r for r in q.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), *ARGS).collect()}
    for i, text in enumerate(texts):
        r, want = got[i], brute(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_entropy_and_fertility(spark):
    text = "hello hello world and the rest"
    v = q.Vocabularies(*ARGS)
    ids = [i for w in text.split() for i in v.pieces.encode(w)]
    n = Counter(ids)
    want = -sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values())
    r = q.measures(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), *ARGS).first()
    assert r["token_entropy"] == pytest.approx(want)
    assert r["chars_per_token"] == pytest.approx(sum(len(w) for w in text.split()) / len(ids))


def test_bands_reject_junk_and_keep_prose(spark):
    rng = random.Random(2)
    vocabulary = ["river", "stone", "garden", "people", "written", "morning", "answer", "question", "little", "number", "water", "language", "because", "before", "house"]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", "", "s", ","]) for _ in range(80)), "en") for i in range(300)]
    rows += [(1000 + i, " ".join("".join(rng.choice("☃☂♞♜⚔⚖⚙") for _ in range(5)) for _ in range(80)), "en") for i in range(3)]
    got = {r["doc_id"]: r for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *ARGS).collect()}
    assert not any(got[1000 + i]["kept"] for i in range(3))
    clean = [got[i] for i in range(300) if not got[i]["base_failed"]]
    assert sum(r["kept"] for r in clean) == len(clean) > 100


def test_odd_rows(odd, none):
    got = q.judge(odd, *ARGS)
    assert got.count() == odd.count()
    assert got.filter(F.col("kept")).count() == 0  # all are short or one word again and again
    assert q.judge(none, *ARGS).count() == 0


def test_quartiles_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["en", "fr", "th"]), *(rng.random() * 5 for _ in q.BANDS)) for _ in range(500)] + [("ka", 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "lang string, " + ", ".join(f"{c} double" for c in q.BANDS))
    got = {(x["lang"], x["measure"]): (x["n"], x["low"], x["high"]) for x in q.quartiles(df.repartition(7)).collect()}
    assert len(got) == 16
    for (lang, c), (n, low, high) in got.items():
        values = sorted(round(v * q.STEPS) / q.STEPS for x in rows if x[0] == lang for v in [x[1 + list(q.BANDS).index(c)]])
        assert n == len(values) and abs(low - values[-(-n // 4) - 1]) < 2e-3 and abs(high - values[-(-3 * n // 4) - 1]) < 2e-3


def test_few_texts_of_another_kind_are_kept(spark):
    rows = [("en", 5.0, 5.0, 0.0, 7.0)] * 300 + [("ka", 0.8 + i / 1000, 0.9, 0.2, 6.5) for i in range(12)]
    df = spark.createDataFrame(rows, "lang string, " + ", ".join(f"{c} double" for c in q.BANDS))
    within = df.join(q.bands(df), "lang").filter(" and ".join(f"{c} between low_{c} and high_{c}" for c in q.BANDS))
    assert within.count() == len(rows)
