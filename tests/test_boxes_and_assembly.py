import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import boxes as b
from foliant.functions import fragments as fr
from foliant.operators import assembly


def raws(*pairs):
    return [fr.block({"t": "text", "e": "equation", "d": "equation_block", "i": "image", "g": "figure", "b": "table"}[k], v) for k, v in pairs]


BOUNDS = [
    ([("t", "물음")], None),
    ([("t", "물음"), ("t", "<조건> 하나이다."), ("t", "구하시오.")], 2),
    ([("t", "<보기> ㄱ. 하나"), ("t", "• ㄴ. 둘"), ("t", "고르면?")], None),
    ([("t", "<보기> ㄱ. "), ("e", "x=1"), ("t", "• ㄴ. "), ("e", "y"), ("t", "옳은 것은?")], None),
    ([("t", "<보기> ㄱ. "), ("e", "x=1"), ("t", "• ㄴ. "), ("e", "y=2"), ("t", "옳은 것은?")], 4),
    ([("t", "<보기> ㄱ."), ("e", "x"), ("t", "• ㄴ. 참이다."), ("t", "이어서")], None),
    ([("t", "<보기> ㄱ. 값"), ("e", "x"), ("t", "• ㄴ. 참이다."), ("t", "이어서")], 3),
    ([("t", "<보기> ㄱ. 값"), ("e", "x"), ("t", "• ㄴ. 참"), ("t", "이어서")], None),
    ([("t", "<상자> • 하나"), ("e", "x"), ("t", " • 둘"), ("t", "끝")], None),
    ([("t", "<상자> 하나, 둘,"), ("e", "x"), ("t", "끝이다.")], None),
    ([("t", "<상자> 모든 수"), ("e", "n"), ("t", "에 대하여"), ("t", "끝이다.")], None),
    ([("t", "<상자> 모든 수"), ("e", "n"), ("t", "이다."), ("t", "끝")], 1),
    ([("t", "<상자>"), ("e", "n=1"), ("t", "값은?")], 2),
    ([("t", "<조건>"), ("t", "• (가) "), ("e", "f(2)=6"), ("e", "f(7)"), ("t", "의 값은?")], 3),
    ([("t", "<보기> 중에서 고르면"), ("t", "x")], None),
]


@pytest.mark.parametrize(("given", "want"), BOUNDS)
def test_bounds(given, want):
    assert b.box_end(raws(*given)) == want


def searched(blocks):
    """The first place p such that what stands before it is a whole box and something follows: all places tried, by the rules as they are stated."""
    texts = [(x["value"] or "") if x["type"] == "text" else None for x in blocks]
    i = next((k for k, t in enumerate(texts) if t is not None and b.MARK.match(t)), None)
    if i is None:
        return None
    rest, n = texts[i][b.MARK.match(texts[i]).end() :].strip(), len(blocks)
    ends = lambda t: bool(re.search(r"[.?!。．？！]\s*\Z", t.strip()))
    whole = bool(rest) and not b.BARE.fullmatch(rest)
    for p in range(i + 1, n):
        equation_next = blocks[i + 1]["type"] == "equation"
        labels = [j for j in range(i + 2, n) if texts[j] is not None and b.INSIDE.search(texts[j])]
        by_labels = whole and equation_next and b.AHEAD.match(rest) and labels
        if whole:
            if texts[i + 1] is not None and b.NEXT.match(texts[i + 1]):
                return None
            if by_labels:
                if p == labels[-1] + 1 and texts[p - 1][[*b.INSIDE.finditer(texts[p - 1])][-1].end() :].strip().endswith((".", "．")):
                    return p
                continue
            goes_on = equation_next and ((b.BULLET.match(rest) and any(t is not None and b.BULLET_INSIDE.search(t) for t in texts[i + 2 :])) or rest.endswith((",", "，")) or not (ends(rest) or any(t is not None and ends(t) for t in texts[i : n - 1])))
            if p == i + 1 and not goes_on:
                return p
            continue
        marks = [j for j in range(i + 1, n) if texts[j] is not None and b.AFTER_BULLET.search(texts[j])] or ([i] if b.AHEAD.match(rest) else [])
        asks = [j for j in range(n) if texts[j] is not None and b.ASKED.search(texts[j])]
        if not marks:
            if p == n - 1 and p > i + 1 and p in asks:
                return p
            continue
        last = [j for j in asks if j > marks[-1]]
        if last and p <= last[-1] and p > marks[-1] + 1 and all(x["type"] in ("equation", "equation_block") and not b.own_relation(x["value"] or "") for x in blocks[p : last[-1]]):
            return p
        if last and p == marks[-1] + 1 and all(x["type"] in ("equation", "equation_block") and not b.own_relation(x["value"] or "") for x in blocks[p : last[-1]]):
            return None
    return None


def test_bounds_against_a_search_of_all_places():
    rng = random.Random(2)
    pool = [("t", "물음"), ("t", "<조건>"), ("t", "<보기> ㄱ. 값"), ("t", "<보기> ㄱ."), ("t", "<상자> • 하나"), ("t", "<상자> 둘,"), ("t", "<상자> 셋이다."), ("t", "• ㄴ. 참이다."), ("t", "• ㄷ. "), ("t", " • 둘"), ("t", "값은?"), ("t", "이다."), ("t", "(가) 수"), ("e", "x"), ("e", "f(2)=6"), ("d", "y"), ("i", None), ("t", "")]
    for _ in range(6_000):
        blocks = raws(*[rng.choice(pool) for _ in range(rng.randint(0, 7))])
        assert b.box_end(blocks) == searched(blocks), [(x["type"], x["value"]) for x in blocks]


def shown(blocks):
    return [f"{x['type']}{'_' if x['underline'] else ''}{'#' if x['box_member'] else ''}:{x['value']}" for x in blocks]


def test_contents():
    given = raws(("t", "함수 f(x) __아닌__ 것"), ("t", "<조건> ● x + 1 이다."), ("g", "그림"), ("t", ""), ("i", None), ("d", r"\begin{cases} a \end{cases}"), ("t", r"\(y\)의 값"))
    assert shown(b.contents(given)) == [
        "text:함수 ", "equation:f(x)", "text: ", "text_:아닌", "text: 것", "text#:<조건> ○ ", "equation#:x + 1", "text#: 이다.", "image:None", r"equation:\begin{cases} a \end{cases}", "equation:y", "text:의 값",
    ]
    table = fr.block("table", '[["1", ["a", {"value": "b"}]], 2]')
    assert b.read(table)[0]["rows"] == [["1", "a b"], ["2"]] and b.read(fr.block("table", "")) == [] and b.read(fr.block("strange", "x 가"))[0]["type"] == "equation"


def test_choices():
    own = lambda n, *pairs: {"number": n, "contents": raws(*pairs)}
    got = b.read_choices([own(1, ("t", "① (가) 1, (나) 짧은 글")), own(2, ("t", "(가)  "), ("e", "x,"), ("t", " (나) 3")), own(0, ("t", "x")), None])
    assert got["heads"] == ["(가)", "(나)"] and [shown(c["contents"]) for c in got["choices"]] == [["equation:1", "text:\t", "text:짧은 글"], ["equation:x", "text:\t", "equation:3"]]
    plain = b.read_choices([own(1, ("t", "①")), own(2, ("t", "② a, b 값")), own(3)])
    assert plain["heads"] == [] and [shown(c["contents"]) for c in plain["choices"]] == [["text:①"], ["equation:a", "text:, ", "equation:b", "text: 값"], []]


def test_columns(spark):
    df = spark.createDataFrame([(1, [("text", "<조건> 하나이다."), ("text", "구하시오.")]), (2, None)], "i int, x array<struct<type:string,value:string>>")
    full = F.expr(f"from_json(to_json(x), 'array<{fr.BLOCK}>')")
    got = {r["i"]: r for r in df.select("i", b.box_bounds(full).alias("end"), b.question_blocks(full).alias("blocks")).collect()}
    assert got[1]["end"] == 1 and shown([x.asDict() for x in got[1]["blocks"]]) == ["text#:<조건> 하나이다.", "text:구하시오."] and got[2]["end"] is None and got[2]["blocks"] is None


def documents(rng):
    """Pieces on pages and what they make."""
    pieces, want = [], {}
    for doc in [None, "a", "b", "hot", "c"]:
        want[doc] = []
        for page in range(1, 4 if doc != "hot" else 60):
            for place in range(rng.randint(0, 4)):
                number = rng.choice([None, place + 1])
                texts = [f"{doc}-{page}-{place}-{k}" for k in range(rng.randint(0, 2))]
                pieces.append((doc, page, place, number, texts or None))
                if number is None and want[doc] and want[doc][-1][2] is not None:
                    want[doc][-1][3].extend(texts)
                else:
                    want[doc].append((page, place, number, list(texts)))
    return pieces, want


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_pages_dealt_in_any_order_make_one_document(spark, most):
    rng = random.Random(3)
    pieces, want = documents(rng)
    schema = "d string, page int, place int, number int, contents array<string>"
    for seed in range(2):
        random.Random(seed).shuffle(pieces)
        got = {}
        for r in assembly.stitched(spark.createDataFrame(pieces, schema).repartition(5), "d", most).orderBy("page", "place").collect():
            got.setdefault(r["d"], []).append((r["page"], r["place"], r["number"], r["contents"]))
        assert got == {d: q for d, q in want.items() if q}
    assert assembly.stitched(spark.createDataFrame([], schema), "d").count() == 0


def test_titles(spark):
    rows = [("a", 2, "Later"), ("a", 1, " First "), ("b", 1, None), ("b", 2, " "), ("b", 3, "Third"), ("c", 1, "")]
    got = {r["d"]: r["title"] for r in assembly.titles(spark.createDataFrame(rows, "d string, page int, header string"), "d").collect()}
    assert got == {"a": "First", "b": "Third", "c": None}


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_essays(spark, most):
    rows = [
        ("same", 1, 0, ["[단답형 1] x"], 0), ("same", 1, 1, ["[서술형 1] y (서답형)"], 0), ("same", 2, 0, ["【 서답형 1 】z", "[서답형 1]"], 0), ("same", 1, 2, ["[서술형 1]"], 5), ("same", 3, 0, ["[서술형 9]"], 0),
        ("apart", 1, 0, ["[서답형 2] x"], 0), ("apart", 1, 1, ["[서답형(서술형) 1]", None], 0), ("none", 1, 0, ["[서술형 1]"], 0), ("none", 1, 1, ["x"], 0), ("none", 1, 2, ["[서술형 1]"], 0), (None, 1, 0, ["[서술형 4]"], 0), (None, 1, 1, ["[서술형 4]"], 0), ("e", 1, 1, [], 0),
    ]
    df = spark.createDataFrame(rows, "d string, page int, place int, contents array<string>, n_choices int")
    got = {(r["d"], r["page"], r["place"]): r["contents"] for r in assembly.essays_unified(df, "d", F.col("n_choices") == 0, most).collect()}
    assert got == {
        ("same", 1, 0): ["[서술형 1] x"], ("same", 1, 1): ["[서술형 2] y (서술형)"], ("same", 2, 0): ["【 서술형 3 】z", "[서술형 1]"], ("same", 1, 2): ["[서술형 1]"], ("same", 3, 0): ["[서술형 4]"],
        ("apart", 1, 0): ["[서술형 2] x"], ("apart", 1, 1): ["[서술형(서술형) 1]", None], ("none", 1, 0): ["[서술형 1]"], ("none", 1, 1): ["x"], ("none", 1, 2): ["[서술형 1]"], (None, 1, 0): ["[서술형 1]"], (None, 1, 1): ["[서술형 2]"], ("e", 1, 1): [],
    }
