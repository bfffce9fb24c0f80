import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foliant.llm import token_counts as t

PATH = public_tokenizers.path("word_bpe_49k.json")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def spec(name):
    return open(public_tokenizers.path(name), encoding="utf-8").read()


def made(rng, n):
    """Prose, runs, marks, special strings, accents that compose, scripts without spaces."""
    parts = ["the ", "quick", " ", "\n\n", "'re", "x'", "<|endoftext|>", "<|endof", "é", "é", "́", "İ", "Σ", "漢字", "かな", "한국", "ᄒ", "ᅡ", "ᆫ", "😀", "≠", "12", "...", "a" * 9, " ", "ẛ̣", "مرحبا", "ً", "שלום", "ֹ", "नमस्ते", "ำ", "ไทย", "ग़"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("sizes", [(16, 1), (24, 5), (40, 30), (64, 20), (300, 40)])
def test_counts_do_not_depend_on_chunks(name, sizes):
    library, counter, rng = Tokenizer.from_str(spec(name)), t.Counter(spec(name), *sizes), random.Random(str(sizes))
    texts = [made(rng, rng.randint(1, 120)) for _ in range(400)] + ["a" * 1_000, "ab" * 700 + " c", " " * 900, "é" * 500, "é" * 400, "x" + "́" * 600 + "y", "<|endoftext|>" * 60, "漢" * 500, "=" * 800]
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(pa.array(texts)).tolist() == want
    assert counter.widened > 0  # some overlaps were too short


def test_prose_is_spliced_without_widening():
    counter = t.Counter(spec(FILES[0]), 4_096, 256)
    text = "Some words of prose, and then some more of them. " * 4_000
    assert counter.long(memoryview(text.encode())) == len(Tokenizer.from_str(spec(FILES[0])).encode(text, add_special_tokens=False).ids)
    assert counter.widened == 0


def test_no_boundary_inside_what_a_chunk_cuts():
    """Of a special string that is cut, and of a contraction, the shorter chunk sees other words."""
    library, counter = Tokenizer.from_str(spec(FILES[0])), t.Counter(spec(FILES[0]), 32, 24)
    for tail in ("<|endoftext|>", "'re", "é", "<|startoftext|>x"):
        for k in range(1, 40):
            text = "w " * k + tail + " w" * 60
            assert counter.long(memoryview(text.encode())) == len(library.encode(text, add_special_tokens=False).ids), (tail, k)


def test_texts_of_other_scripts_are_spliced():
    library, counter = Tokenizer.from_str(spec(FILES[0])), t.Counter(spec(FILES[0]), 1_024, 128)
    for text in ("مرحبا بالعالم " * 600, "שלום עולם, " * 600, "नमस्ते दुनिया " * 600, "สวัสดีชาวโลก " * 600, "漢字かな交じり文。" * 600):
        counter.widened = 0
        assert counter.long(memoryview(text.encode())) == len(library.encode(text, add_special_tokens=False).ids)
        assert counter.widened == 0


def test_long_word_in_one_piece():
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(300_000)) + " end"
    assert t.Counter(spec(FILES[0])).long(memoryview(text.encode())) == len(Tokenizer.from_str(spec(FILES[0])).encode(text, add_special_tokens=False).ids)


def test_odd_rows(odd, none):
    library = Tokenizer.from_str(spec(FILES[0]))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 2048) for r in odd.collect()), key=str)
    for sizes in ({}, {"chunk": 64, "overlap": 8}):
        got = t.count(odd, PATH, **sizes)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert t.count(none, PATH).count() == 0
    with pytest.raises(ValueError):
        t.Counter(spec(FILES[0]), 4, 1)
