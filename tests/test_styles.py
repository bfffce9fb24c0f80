import pytest
from pyspark.sql import functions as F

from foliant.functions import fragments as fr
from foliant.functions import styles as s


def raws(*pairs):
    return [fr.block({"t": "text", "e": "equation", "d": "equation_block"}[k], v) for k, v in pairs]


CASES = [
    ([("t", "점 "), ("e", "A"), ("t", "와 "), ("e", "P(1, 2)"), ("t", ", "), ("e", "B(3)"), ("e", "f(x)")], [r"\mathrm{A}", r"\mathrm{P}\mathit{(1, 2)}", r"\mathrm{B}\mathit{(3)}", "f(x)"]),
    ([("t", "확률변수 "), ("e", "X"), ("t", "의 "), ("e", r"\mathrm{P}(X=1)"), ("e", r"{}_5\mathrm{P}_2"), ("e", r"\mathrm{C}")], ["X", "P(X=1)", r"{}_5\mathrm{P}_2", r"\mathrm{C}"]),
    ([("t", "점수는 번호"), ("e", "X"), ("e", "AB")], ["X", r"\mathrm{AB}"]),
    ([("t", "행렬 "), ("e", "AB"), ("t", "와 "), ("e", "ABC=AX+B"), ("e", r"\mathrm{AB}")], [r"\mathit{AB}", r"\mathit{ABC}=\mathit{AX}+B", r"\mathrm{AB}"]),
    ([("t", "삼각형의 넓이를 "), ("e", "S_{1}"), ("t", "이라 하고 "), ("e", "T"), ("t", ", "), ("e", "S_1")], ["S_{1}", r"\mathrm{T}", "S_1"]),
    ([("t", "두 원 "), ("e", "O"), ("t", ", "), ("e", r"\mathrm{O'}"), ("t", "의 교점 "), ("e", "A")], ["O", "O'", r"\mathrm{A}"]),
    ([("e", r"\angle A=\angle \mathrm{B}"), ("e", r"\sin \mathrm{A}"), ("t", "∠"), ("e", r"\mathrm{A}=45°")], [r"\angle \mathrm{A}=\angle \mathrm{B}", r"\sin A", "A=45°"]),
    ([("t", "단위는 "), ("e", "g"), ("t", " "), ("e", "m"), ("t", "이다"), ("e", "g")], [r"\mathrm{g}", r"\mathrm{m}", "g"]),
    ([("t", "선분 "), ("e", "A B C"), ("e", "A'B"), ("d", "AB")], [r"\mathrm{A B C}", r"\mathrm{A'B}", "AB"]),
]


@pytest.mark.parametrize(("given", "want"), CASES)
def test_letters(given, want):
    assert [b["value"] for b in s.styled(raws(*given)) if b["type"] != "text"] == want


def test_geometry_of_the_question_holds_for_its_choices():
    assert [b["value"] for b in s.styled(raws(("e", "A(2,3)")), geometry=True)] == [r"\mathrm{A}\mathit{(2,3)}"]
    assert [b["value"] for b in s.styled(raws(("e", "A(2,3)")))] == ["A(2,3)"]


def test_scores():
    got = s.styled(raws(("t", "값은? [4점]"), ("t", "이다 [총 "), ("e", "3.5"), ("t", "점, 부분점수] 끝"), ("t", "[3점]"), ("t", "<조건> [1점]"), ("t", "[2점]")))
    assert [b["value"] for b in got] == ["값은? ", "이다", "끝", "<조건> [1점]", "[2점]"]


def test_columns(spark):
    df = spark.createDataFrame([(1, [("text", "점 [3점]"), ("equation", "A"), None]), (2, None)], "i int, x array<struct<type:string,value:string>>")
    got = {r["i"]: r["s"] for r in df.select("i", s.letters_styled(F.expr(f"from_json(to_json(x), 'array<{fr.BLOCK}>')")).alias("s")).collect()}
    assert [b["value"] for b in got[1]] == ["점 ", r"\mathrm{A}"] and got[2] is None
