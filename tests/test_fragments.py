import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import fragments as f
from foliant.functions import splitting as s


def blocks(*pairs):
    return [f.block({"t": "text", "e": "equation", "d": "equation_block", "i": "image"}[k], v) for k, v in pairs]


def shown(bs):
    return [("_" if b["underline"] else "") + b["type"][0] + ":" + (b["value"] or "") for b in bs]


CASES = [
    ("signs", [("e", "x"), ("t", "= -"), ("e", "2y"), ("t", " < "), ("e", "3")], ["e:x = - 2y < 3"]),
    ("signs", [("e", "x"), ("t", "이고"), ("e", "y"), ("t", "="), ("t", "="), ("e", "z")], ["e:x", "t:이고", "e:y", "t:=", "t:=", "e:z"]),
    ("relations", [("t", "-1 ≤ "), ("e", "x"), ("t", " ≤ 1에서")], ["e:-1 \\leq x \\leq 1", "t:에서"]),
    ("relations", [("t", "값이 3 < "), ("e", "x"), ("t", "<"), ("e", "y")], ["t:값이 ", "e:3 < x", "t:<", "e:y"][:2] + ["e:< y"]),
    ("relations", [("t", "값이3 <"), ("e", "x")], ["t:값이3 ", "e:< x"]),
    ("calls", [("t", "함수 f(x)-g(2) "), ("e", "=3"), ("t", "한글f(x)"), ("e", "=3"), ("t", "f(x)"), ("e", "3")], ["t:함수 ", "e:f(x)-g(2)=3", "t:한글f(x)", "e:=3", "t:f(x)", "e:3"]),
    ("groups", [("t", "값 {}"), ("e", "_2C"), ("t", " {} "), ("e", "^3"), ("t", "{}"), ("e", "x")], ["t:값 ", "e:{}_2C", "e:{}^3", "t:{}", "e:x"]),
    ("degrees", [("e", "6"), ("t", "°"), ("e", "C"), ("t", "°"), ("e", "A")], ["e:6°\\mathrm{C}", "t:°", "e:A"]),
    ("ranges", [("e", "a_n=2"), ("t", " "), ("e", "(n=1,2,\\cdots)"), ("e", "(1,2)")], ["e:a_n=2 ~ (n=1,2,\\cdots)", "e:(1,2)"]),
    ("domains", [("e", r"P(X=r)=1 \quad (r=0, 1, \cdots, 9)"), ("e", "f (3, 2)")], ["e:P(X=r)=1", "t: (", "e:r=0", "t:, ", "e:1", "t:, ", "e:\\cdots", "t:, ", "e:9", "t:)", "e:f (3, 2)"]),
    ("commas", [("e", "(a, b_1)"), ("e", "(3, 2)"), ("e", "A=2, B=f(1,2)"), ("e", r"20\,m"), ("e", r"x=\frac{1}{2}, \frac{a}{b}, 3")], ["t:(", "e:a", "t:, ", "e:b_1", "t:)", "e:(3,~2)", "e:A=2", "t:, ", "e:B=f(1,2)", r"e:20\,m", r"e:x=\frac{1}{2} \frac{a}{b} 3"]),
    ("underlines", [("t", "가 __나"), ("e", "x"), ("t", "다__ 라 __마")], ["t:가 ", "_t:나", "e:x", "_t:다", "t: 라 __마"]),
    ("displays", [("t", "점"), ("d", "a, b"), ("t", "를 지나는"), ("d", "a=1, b"), ("t", "끝.")], ["t:점", "e:a, b", "t:를 지나는", "e:a=1, b", "t:끝."]),
]


@pytest.mark.parametrize(("name", "given", "want"), CASES)
def test_passes(name, given, want):
    assert shown(f.merged(blocks(*given), name)) == want


def test_merges_cascade_like_a_search_for_the_first():
    """The fold against merging the first three blocks that fit, again and again."""
    rng = random.Random(5)
    for _ in range(300):
        bs = blocks(*[rng.choice([("e", "x"), ("e", "y+1"), ("t", "="), ("t", " < "), ("t", "글"), ("t", ""), ("i", None)]) for _ in range(rng.randint(0, 12))])
        slow = list(bs)
        while True:
            at = next((i for i in range(len(slow) - 2) if slow[i]["type"] == slow[i + 2]["type"] == "equation" and slow[i + 1]["type"] == "text" and set(slow[i + 1]["value"].strip()) <= f.JOINING and slow[i + 1]["value"].strip()), None)
            if at is None:
                break
            slow[at : at + 3] = [f.block("equation", f"{slow[at]['value']} {slow[at + 1]['value'].strip()} {slow[at + 2]['value']}")]
        assert shown(f.merged(bs, "signs")) == shown(slow)


def test_no_pass_drops_what_stands_there():
    rng = random.Random(6)
    parts = ["x", "3 < ", " ≤ 1에서", "= -", "f(x)", "=2", "{}", "_2C", "°", "C", "(n=1,2,⋯)", "a, b", "(3, 2)", "__가", "나__", "", None, "한글 f(x) "]
    for _ in range(500):
        bs = blocks(*[(rng.choice("teed"), rng.choice(parts)) for _ in range(rng.randint(0, 9))])
        bare = lambda xs: sorted("".join(f.value(b) for b in xs).replace(r"\leq", "≤").replace("mathrm", "").translate(str.maketrans("", "", " ~\\{}_,()")))
        assert bare(f.merged(bs)) == bare(bs)


def test_columns_keep_nulls_and_other_blocks(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [("equation", "x"), ("text", "="), ("equation", "y"), None, ("table", None)])], "i int, b array<struct<type:string,value:string>>")
    typed = F.expr(f"from_json(to_json(b), 'array<{f.BLOCK}>')")
    got = {r["i"]: r["g"] for r in df.select("i", f.fragments_merged(typed, "signs").alias("g")).collect()}
    assert got[1] is None and got[2] == [] and [(b["type"], b["value"]) for b in got[3]] == [("equation", "x = y"), ("table", None)]


SPLITS = [
    ("mixed", "(a > 0, b는 정수)에서", ["t:(", "e:a > 0", "t:, ", "e:b", "t:는 정수)에서"]),
    ("mixed", "ㄷ. -5x+6=6-5x", ["t:ㄷ. ", "e:-5x+6=6-5x"]),
    ("mixed", "2a_{n+1}=a_n+a_{n+2} 이다", ["e:2a_{n+1}=a_n+a_{n+2}", "t: 이다"]),
    ("mixed", "(i) x의 값", ["e:(i)", "t: ", "e:x", "t:의 값"]),
    ("mixed", "hello world test", ["t:hello world test"]),
    ("mixed", "가 (f(x))^5\n나 3.5", ["t:가 ", "e:(f(x))^5", "t:\n나 ", "e:3.5"]),
    ("commands", r"ㄱ. \sqrt{2}+\sqrt{2}", ["t:ㄱ. ", r"e:\sqrt{2}+\sqrt{2}"]),
    ("commands", r"\sqrt{24} \div \sqrt{3} 의 값은", [r"e:\sqrt{24} \div \sqrt{3}", "t: 의 값은"]),
    ("commands", r"조합 {}_{n}\mathrm{C}_{r} 의 값", ["t:조합 ", r"e:{}_{n}\mathrm{C}_{r}", "t: 의 값"]),
    ("commands", r"(가) \alpha, \beta (나) 값", ["t:(가) ", r"e:\alpha, \beta", "t: (나) 값"]),
    ("commands", r"f \begin{cases} x \\ 가 \end{cases}이다", ["t:f ", r"e:\begin{cases} x \\ 가 \end{cases}", "t:이다"]),
    ("commands", r"무게 y=\frac{가}{2}", ["t:무게 ", r"e:y=\frac{가}{2}"]),
    ("inline", "값 $x+1$ 과 $$y$$ 는 $z$", ["t:값 ", "e:x+1", "t: 과 $$y$$ 는 ", "e:z"]),
    ("underline", "옳지 __않은__ 것 __xy__ ____", ["t:옳지 ", "u:않은", "t: 것 ", "e:xy", "t: ____"]),
]


@pytest.mark.parametrize(("by", "given", "want"), SPLITS)
def test_splitters(by, given, want):
    assert [f"{x.type[0]}:{x.value}" for x in s.SPLITTERS[by](given)] == want


@pytest.mark.parametrize("by", sorted(s.SPLITTERS))
def test_pieces_joined_are_the_text(by):
    rng = random.Random(7)
    parts = ["값", " ", "x", "3", "+", "=", "-", "(", ")", "{", "}", "[", "_", "^", "\\frac", "\\sqrt{", "\\,", "$", "__", "•", "\n", "(가)", "(i)", ".", ",", "a_{n}", "\\begin{cases}", "\\end{cases}", "  ", "…", "b"]
    for _ in range(1_500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        spans = s.SPLITTERS[by](text)
        assert "".join(x.raw for x in spans) == text
        assert all(x.raw and (x.type != "text" or x.value == x.raw) for x in spans)


def test_depth_and_commas():
    assert s.top_level_parts(r"a,(b,c),{d,[e,f]},20\,m") == ["a", "(b,c)", "{d,[e,f]}", r"20\,m"]
    assert s.top_level_parts("") == [""] and s.top_level_parts("),a(") == [")", "a("]
    assert s.is_wrapped("(a(b))") and not s.is_wrapped("(a)(b)") and not s.is_wrapped("") and not s.is_wrapped("(a")
    assert s.has_relation("a=b") and not s.has_relation("f(a=b)") and s.has_relation(r"x \leq y") and not s.has_relation(r"\left")
