from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from foliant.operators import scoring
from foliant.sources.readers import QUESTION


def block(type_, value=None, rows=None):
    return {"type": type_, "value": value, "rows": rows}


def question(number, contents=(), choices=(), score=None, subs=()):
    return {"number": number, "contents": list(contents), "choices": [{"number": i, "contents": list(c)} for i, c in enumerate(choices, 1)], "score": score, "sub_questions": [{"number": i, "contents": list(c)} for i, c in enumerate(subs, 1)]}


def scored(spark, candidate, golden):
    make = lambda qs: spark.createDataFrame([(1, qs)], f"sample_id int, questions array<{QUESTION}>")
    return scoring.score_crops(make(candidate), make(golden)).first().asDict()


PROSE = block("text", "a long passage of prose that stands in a box")
CASES = {
    "equal": ([question(1, [PROSE], [[block("text", "x")]], "3")], [question(1, [PROSE], [[block("text", "x")]], "3.0")], []),
    "none": ([], [], []),
    "count": ([question(1)], [question(1), question(2)], ["QUESTION_COUNT"]),
    "choices": ([question(1, choices=[[], []])], [question(1, choices=[[], [], []])], ["CHOICE_COUNT"]),
    "order of types": ([question(1, [block("text", "a"), block("equation", "x")])], [question(1, [block("equation", "x"), block("text", "a")])], ["CONTENT_TYPE_DRIFT"]),
    "number": ([question(2)], [question(1)], ["NUMBER_MISMATCH"]),
    "capitals": ([question(1, [block("text", "ABC")])], [question(1, [block("text", "abc")])], []),
    "equation": ([question(1, [block("equation", "x^{2}")])], [question(1, [block("equation", "x^{3}")])], ["EQUATION_DRIFT"]),
    "box": ([question(1, [block("text", "else")])], [question(1, [PROSE])], ["BOX_PROSE_DROP"]),
    "table gone": ([question(1, [block("text")])], [question(1, [block("table", rows=[["a"]])])], ["CONTENT_TYPE_DRIFT", "TABLE_MISSING"]),
    "table larger": ([question(1, [block("table", rows=[["a", "b"], ["c"]])])], [question(1, [block("table", rows=[["a"]])])], ["CONTENT_TYPE_DRIFT"]),
    "parts": ([question(1, subs=[[block("equation", "y")]])], [question(1, subs=[[block("equation", "y")]])], []),
}


@pytest.mark.parametrize("name", CASES)
def test_what_regressed(spark, name):
    candidate, golden, tags = CASES[name]
    assert scored(spark, candidate, golden)["regressions"] == tags


def test_measures(spark):
    got = scored(spark, *CASES["order of types"][:2])
    assert got["content_type_score"] == SequenceMatcher(None, "text\0equation", "equation\0text").ratio()
    assert scored(spark, *CASES["capitals"][:2])["text_ratio"] == 0.0
    assert scored(spark, *CASES["equal"][:2])["struct_score"] == 1.0
    got = scored(spark, [question(None), question(7), question(2)], [question(2), question(2), question(None)])
    assert got["number_score"] == pytest.approx(1 / 3) and got["question_count_score"] == 1.0  # 2 met by number, then null with the second 2, 7 with null
    got = scored(spark, [question(1, [block("table", rows=[["a", "x"], ["c"]])])], [question(1, [block("table", rows=[["a", "b"], ["c", "d"]])])])
    assert got["table_cell_acc"] == 0.5 and got["regressions"] == []
    assert scored(spark, *CASES["parts"][:2])["table_cell_acc"] is None


def test_summary(spark):
    make = lambda qs: spark.createDataFrame([(1, qs), (2, qs)], f"sample_id int, questions array<{QUESTION}>")
    got = scoring.aggregated_crops(scoring.score_crops(make([question(1)]).filter("sample_id = 1"), make([question(1)]))).first()
    assert (got["n_samples"], got["n_regressions"], got["regression_rate"], got["mean_table_cell_acc"]) == (2, 1, 0.5, None)
    empty = scoring.aggregated_crops(scoring.score_crops(make([]), make([])).filter(F.lit(False))).first()
    assert (empty["n_samples"], empty["mean_text_ratio"], empty["regression_rate"]) == (0, 1.0, 0.0)
