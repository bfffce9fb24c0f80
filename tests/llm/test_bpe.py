import random
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foliant.llm import bpe_codec as b

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "Hello, World!", "it's we'll 'RE", "<|endoftext|>", "x<|startoftext|>y", "<|<|endoftext|>|>", "é é Ǆ İstanbul ΣΑΣ", "12345 ½ Ⅷ", "日本語 한국어 العربية", "a" * 500, "ab" * 400, "\x85\xa0 ", "😀👍🏽", "\x00\x1c"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return b.Vocabulary(open(PATH, encoding="utf-8").read())


def lexicon(tmp_path, vocabulary, words):
    b.save_lexicon(b.compile_lexicon(words, vocabulary.merge, vocabulary.tokens.__getitem__), str(tmp_path / "lexicon"))
    return b.Lexicon(str(tmp_path / "lexicon"))


def test_lexicon_is_minimal_and_right(tmp_path, vocabulary):
    words = ["tap", "taps", "top", "tops", "straße", "naïve", "a"]
    lex = lexicon(tmp_path, vocabulary, words)
    found = lex.find(pa.array([*words, "ta", "tapsx", "x", "stra"]))
    assert (found[-4:] == -1).all() and sorted(found[:-4]) == list(range(len(words)))
    for w, i in zip(words, found, strict=False):
        assert lex.texts("ids")[int(i)].as_py() == " ".join(map(str, vocabulary.merge(w))) and lex.size[i] == len(vocabulary.merge(w))
        assert lex.texts("tokens")[int(i)].as_py() == " ".join(vocabulary.tokens[x] for x in vocabulary.merge(w))
    small = b.compile_lexicon(["tap", "taps", "top", "tops"], vocabulary.merge, vocabulary.tokens.__getitem__)
    assert len(small["final"]) == 5  # of states with equal futures one is left


def test_empty_lexicon(tmp_path, vocabulary):
    assert (lexicon(tmp_path, vocabulary, []).find(pa.array(["a", "b"])) == -1).all()


@pytest.mark.parametrize("seed", range(3))
def test_same_as_the_library(tmp_path, vocabulary, library, seed):
    rng = random.Random(seed)
    letters = " \n\t .,.,ababcdeéÉñßΣσİ'sStTre123$%<|endoftext|>ＡAáó한국ẛ̣"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    codec = b.Codec(vocabulary, lexicon(tmp_path, vocabulary, ["abc", "the", "hello", "ab", "bé", "é", "ñß"]), kept=50)
    ids = codec.encode(texts)
    for text, got, want in zip(texts, ids, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == want.ids, text
        assert codec.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_long_words_merge_alike(vocabulary):
    word = "".join(random.Random(2).choice("abcde") for _ in range(64))
    by_heap = [vocabulary.ids[x] for x in b.merge_long(vocabulary.symbols(word), vocabulary.ranks)]
    assert by_heap == vocabulary.merge(word)


def test_odd_rows(odd, none, library):
    rows = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in b.digests(odd, PATH).collect()}
    for r in odd.collect():
        e = library.encode(r["text"] or "", add_special_tokens=False)
        d = library.decode(e.ids, skip_special_tokens=False)
        assert (r["doc_id"], len(e.ids), sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), sha256(d.encode()).hexdigest()) in rows
    assert b.digests(odd, PATH).count() == odd.count()
    assert b.digests(none, PATH).count() == 0
    whole = b.encode(odd, PATH).filter("doc_id = 7").first()
    assert whole["decoded"] == library.decode(whole["ids"], skip_special_tokens=False)


@pytest.mark.parametrize("form", ["{}", "a{}b", "{}́", "a{}́", "ẹ{}", "́{}a", "{}̣́"])
def test_all_code_points_as_the_library_has_them(tmp_path, vocabulary, library, form):
    """Alone, in a word, before marks and after them; beyond the assigned planes every 16th."""
    points = [c for c in [*range(0x32400), *range(0x32400, 0x110000, 16)] if not 0xD800 <= c < 0xE000]
    codec = b.Codec(vocabulary, lexicon(tmp_path, vocabulary, []), kept=5000)
    for at in range(0, len(points), 5000):
        text = "\n".join(form.format(chr(c)) for c in points[at : at + 5000])
        got, want = codec.encode([text])[0], library.encode(text, add_special_tokens=False).ids
        if got != want:
            one = [c for c in points[at : at + 5000] if codec.encode([form.format(chr(c))])[0] != library.encode(form.format(chr(c)), add_special_tokens=False).ids]
            raise AssertionError([hex(c) for c in one[:20]])
