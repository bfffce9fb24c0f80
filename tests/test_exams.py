import pytest
from pyspark.sql import functions as F

from foliant.functions import equations, exams


def one(spark, column, x):
    return spark.createDataFrame([(x,)], "x string").select(column.alias("y")).first()["y"]



@pytest.mark.parametrize(
    ("column", "x", "want"),
    [
        (lambda: exams.maths_inline(F.col("x")), r"a \( x \) b $$y" + "\n" + "z$$", "a $x$ b $y z$"), (lambda: exams.answer_text(F.col("x"), F.lit(True)), "17. ④", "④"), (lambda: exams.answer_text(F.col("x"), F.lit(True)), "정답: 4", "④"), (lambda: exams.answer_text(F.col("x"), F.lit(False)), "[서술형 1] 12", "12"),
        (lambda: exams.answer_text(F.col("x"), F.lit(True)), "[보기 오류] 9", "[보기 오류] $9$"), (lambda: exams.answer_text(F.col("x"), F.lit(True)), None, ""), (lambda: exams.solution_text(F.col("x")), "```tex\n step1) a \n\n step2) b\n```", "step1) a\nstep2) b"),
        (lambda: exams.difficulty(F.col("x")), " 상 ", "상"), (lambda: exams.difficulty(F.col("x")), "x", ""), (lambda: exams.topic(F.col("x")), "[ 이차  함수 ]", "이차 함수"), (lambda: exams.graded(F.lit("③"), F.col("x"), F.lit(True)), "답 ③", True), (lambda: exams.graded(F.lit("③"), F.col("x"), F.lit(True)), "③④", False),
        (lambda: exams.graded(F.lit(r"\frac{π}{2}"), F.col("x"), F.lit(False)), "pi2", True), (lambda: exams.year_of(F.col("x")), "24년", 2024), (lambda: exams.old_curriculum(F.lit("고1"), F.col("x")), "2024", True), (lambda: exams.old_curriculum(F.lit("고1"), F.col("x")), "2025", False), (lambda: exams.old_curriculum(F.lit("고"), F.col("x")), "2020", False),
        (lambda: exams.term_key(F.col("x")), "[가람고][2][24-1-기말].pdf", "가람고|24-1-기말"), (lambda: exams.display_width(F.col("x")), "ab가나", 6), (lambda: exams.recoverable_prose(F.col("x")), "독수리는 하늘을 난다", True), (lambda: exams.recoverable_prose(F.col("x")), "(1) 독수리는", False),
        (lambda: exams.recoverable_prose(F.col("x")), "a | b", False), (lambda: exams.recoverable_prose(F.col("x")), "x^2+1", False), (lambda: exams.markup_findings(F.col("x")), "<hp:t>ㄷ</hp:t>", ["lone letter", "no answers"]), (lambda: exams.markup_findings(F.col("x")), "정답 [3점] [3점]", ["score twice"]),
        (lambda: exams.number_text(F.col("x")), "3.0", "3"), (lambda: equations.to_script(F.col("x")), r"\dfrac{\sqrt{x^{2}}}{2} \times y", "{sqrt {x^{2}}} over {2} TIMES y"), (lambda: equations.to_latex(F.col("x")), "{1} over {sqrt {2}} TIMES x", r"\frac{1}{\sqrt{2}} \times x"),
        (lambda: equations.inline_to_latex(F.col("x")), "a ${1} over {2}$ b over", r"a $\frac{1}{2}$ b over"), (lambda: equations.leaks(equations.to_script(F.col("x"))), r"\weird{x}", True), (lambda: equations.unstamped(equations.stamped(F.col("x"), "~~"), "~~"), "x", "x"),
    ],
)
def test_values(spark, column, x, want):
    assert one(spark, column(), x) == want


def test_crops(spark):
    got = one(spark, exams.crop_boxes(F.col("x")), '```json\n{"items": [{"cropBox": [100, 0, 500, 1200], "class": "figure", "number": 3}, {"cropBox": [1, 1, 2, 2]}, {"cropBox": [1]}]}\n```')
    assert [tuple(b) for b in got] == [(0.0, 0.1, 1.0, 0.5, "figure", "3")]
    assert [tuple(b) for b in one(spark, exams.crop_boxes(F.col("x")), '{"crops": [{"bbox": [0.1, 0.2, 0.5, 0.6]}]}')] == [(0.1, 0.2, 0.5, 0.6, "problem", None)]
    assert one(spark, exams.crop_boxes(F.col("x")), "broken") == []


def test_pages(spark):
    df = spark.createDataFrame([(["a" * 150, " " * 500, "b" * 51, "c" * 900],), (["a"],)], "p array<string>")
    assert [r[0] for r in df.select(exams.born_digital(F.col("p"))).collect()] == [True, False]
    q = spark.createDataFrame([(100, 900, 10.0, 0.1, 99.0), (900, 900, 160.0, 5.0, 30.0), (900, 900, 160.0, 5.0, 10.0)], "w int, h int, s double, i double, c double").select(exams.page_quality(F.col("w"), F.col("h"), F.col("s"), F.col("i"), F.col("c")).alias("q")).collect()
    assert [(r["q"]["score"], r["q"]["reasons"]) for r in q] == [(0.0, ["small", "blurred", "blank"]), (100.0, []), (75.0, ["faded"])]
