import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import answers, jsonfix, names
from foliant.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (r"x\ge5", r"x \geq 5", True), (r"\dfrac{1}{2}", r"\frac{1}{2}", True), ("$x^{2}$", "x^2", True), ("(x+1)(x-2)", "(x-2)(x+1)", True),
        ("(1) (b)(a) (2) c", "(1) (a)(b) (2) c", True), ("P(2)=6", "6", True), ("x=3", "y=3", True), ("x<3", "3", False), ("-24 (최댓값 0)", "-24", True),
        ("(x+1)^2 (즉 x^2+2x+1)", "x^2+2x+1", True), (r"P(-\sqrt3,-1)", r"(-\sqrt3,-1)", True), ("5", "6", False), ("", None, True), ("(1) 2 (2) 3", "(1) 2 (2) 4", False), ("((a", "((b", False),
    ],
)
def test_same_answer(spark, a, b, same):
    assert one(spark, answers.same_answer(F.col("a"), F.col("b")), a=a, b=b) is same


def test_factors():
    assert answers.factors_sorted("(b)(a)+(d)(c)") == "(a)(b)+(c)(d)"
    assert answers.factors_sorted("(2)(b)(a)(1)(d)(c)") == "(2)(a)(b)(1)(c)(d)"
    assert answers.factors_sorted("((x)(y)") == "((x)(y)"


@pytest.mark.parametrize(("a", "b", "worst"), [("high", "high", "high"), ("high", "low", "low"), (None, "high", "medium"), ("?", "low", "low")])
def test_confidence(spark, a, b, worst):
    assert one(spark, answers.worst_confidence(F.col("a"), F.col("b")), a=a, b=b) == worst


NAMES = [
    ("/d/[가람고][2][수학1][24-1-기말][저자](완료).pdf", ("A", "가람고", 2, "고", "수1", 2024, 1, "기말", "저자", "완료")),
    ("/d/[가람중][1][25-중간-2].hwp", ("A", "가람중", 1, "중", "수학", 2025, 2, "중간", None, None)),
    ("/d/[22][고1][1학기중간][수학상][나래여고].hwp", ("B", "나래여고", 1, "고", "수상", 2022, 1, "중간", None, None)),
    ("/d/나래여자고등학교_1학년_2021_1학기기말_수학(상)_공통.pdf", ("C", "나래여고", 1, "고", "수상", 2021, 1, "기말", None, None)),
    ("/d/[x][y].pdf", ("unparsed", *[None] * 9)),
    ("/d/plain.pdf", ("nobracket", *[None] * 9)),
    ("/d/[가람고][2][수학1][24-1-기말]교사용.pdf", ("notexam", *[None] * 9)),
    (None, ("nobracket", *[None] * 9)),
]


def test_file_names(spark):
    got = names.parsed(spark.createDataFrame([(p,) for p, _ in NAMES], "path string")).collect()
    for r, (path, want) in zip(got, NAMES, strict=True):
        assert tuple(r[c] for c in ("fmt", "school", "grade", "level", "subject", "year", "semester", "round", "publisher", "status"))[: len(want)] == want, path
    assert names.valid(names.parsed(spark.createDataFrame([(p,) for p, _ in NAMES], "path string"))).count() == 4


@pytest.mark.parametrize(
    ("broken", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1,}\n```', {"a": 1}), ('{"a": "\\frac{1}{2} \\underset x"}', {"a": "\x0crac{1}{2} \\underset x"}), ('{"a": "\\lim"}', {"a": "\\lim"}),
        ('{"a": "say "hi" now"}', {"a": 'say "hi" now'}), ('{"a": [1, {"b": 2}', {"a": [1, {"b": 2}]}), ('{"a": 1}} tail', {"a": 1}), ('{"a": "x\ny"}', {"a": "x\ny"}), ("no object", None), ("[1]", None), (None, None), ("", None),
    ],
)
def test_json_repair(spark, broken, want):
    got = one(spark, jsonfix.json_object(F.col("x")), x=broken)
    assert (json.loads(got) if got else None) == want


def test_braces():
    assert jsonfix.escaped_braces(r"a{b}c}\{ {") == r"a{b}c\}\{ \{"
    assert jsonfix.escaped_braces(None) is None


@pytest.mark.parametrize(("x", "ok"), [("{a}$b$", True), ("}{", False), ("$", False), (r"\{ \$", True), (None, True), ("{{}", False)])
def test_balance(spark, x, ok):
    assert one(spark, tx.balanced(F.col("x")), x=x) is ok


def test_text(spark):
    assert one(spark, tx.norm_latex(F.col("x")), x=r"a \quad b\, c") == "abc"
    assert one(spark, tx.windows(F.col("x")), x="abcdefghijklmnopqrs") == ["abcdefghijkl", "ghijklmnopqr"]
    assert one(spark, tx.windows(F.col("x")), x="short") == ["short"] and one(spark, tx.windows(F.col("x")), x="") == []
    got = one(spark, tx.risk_tokens(F.col("x"), "low"), x="홀수 12.345 그리고 홀수 x^{2} <= 5 cm 100%")
    assert [(r["category"], r["token"]) for r in got] == [("HOL_JJAK", "홀수"), ("DECIMAL", "12.345"), ("INEQUALITY", "<"), ("EXPONENT", "^{2"), ("PERCENT", "100%"), ("UNIT", "5 cm"), ("NUMBER", "345"), ("NUMBER", "100")]
    assert one(spark, tx.printed_scores(F.col("x")), x="가 [4점] 나 [3.5점] (총 10점)") == [4.0, 3.5, 10.0]
    assert one(spark, tx.markdown_rows(F.col("x")), x="| a | b |\n|---|---|\n| 1 | 2 |") == [["a", "b"], ["1", "2"]]
    assert one(spark, tx.single_backslashes(F.col("x")), x=r"\\\\frac \\") == "\\frac \\\\"
    assert [one(spark, tx.single_choice(F.col("x")), x=x) for x in ("③", " ① ", "①②", "", None)] == [True, True, False, False, False]
    assert one(spark, tx.decoded(F.col("x"), {"": "1/2"}), x="a") == "a1/2"


def test_flatten(spark):
    row = spark.sql("select array(named_struct('type','text','value','a','rows',cast(null as array<array<string>>)), named_struct('type','equation','value','x^2','rows',null), named_struct('type','table','value',null,'rows',array(array('p','q'),array('r')))) as b")
    assert row.select(tx.flatten_blocks(F.col("b"))).first()[0] == "a $x^2$ p q r"
