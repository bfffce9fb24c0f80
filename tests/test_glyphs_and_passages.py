import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from foliant.functions import glyphs as g
from foliant.operators import passages as p

# Glyphs laid out from a tree: a tree is a list of letters, ("frac", above, below) and ("^" or "_", script).


def width(tree, size):
    return sum(size if isinstance(x, str) else max(width(x[1], size), width(x[2], size)) + size if x[0] == "frac" else width(x[1], size * 0.7) for x in tree)


def reach(tree, size, part):
    """How far a row reaches above (1) or below (2) its middle line."""
    return max([0.8 * size, *(size / 4 + reach(x[part], size, 1) + reach(x[part], size, 2) for x in tree if x[0] == "frac")])


def laid(tree, x, y, size):
    """Glyphs with the middle line at y, in reading order."""
    out = []
    for t in tree:
        if isinstance(t, str):
            out.append({"c": t, "x0": x + 0.05 * size, "x1": x + 0.95 * size, "y0": y - size / 2, "y1": y + size / 2, "size": size})
            x += size
        elif t[0] == "frac":
            wide = max(width(t[1], size), width(t[2], size)) + size
            out += laid(t[1], x + size / 2, y - size / 4 - reach(t[1], size, 2), size)
            out.append({"c": g.BAR, "x0": x + 0.2 * size, "x1": x + wide - 0.2 * size, "y0": y - size / 2, "y1": y + size / 2, "size": size})
            out += laid(t[2], x + size / 2, y + size / 4 + reach(t[2], size, 1), size)
            x += wide
        else:
            out += laid(t[1], x, y + (-0.4 if t[0] == "^" else 0.4) * size, size * 0.7)
            x += width(t[1], size * 0.7)
    return out


def latex(tree):
    return "".join(t if isinstance(t, str) else f"\\frac{{{latex(t[1])}}}{{{latex(t[2])}}}" if t[0] == "frac" else f"{t[0]}{{{latex(t[1])}}}" for t in tree)


def grown(rng, depth):
    out = []
    for _ in range(rng.randint(3, 5)):
        out.append(rng.choice("abxyn12+"))
        if depth and rng.random() < 0.4:
            out.append(("frac", grown(rng, depth - 1), grown(rng, depth - 1)))
        elif rng.random() < 0.15:
            out += [(rng.choice("^_"), [rng.choice("ij2")]), "z"]
    return out


def test_layouts_are_read_back():
    rng = random.Random(3)
    for depth in [0, 1, 2, 3, 4] * 30:
        tree = grown(rng, depth)
        assert g.equation_of(laid(tree, 0.0, 0.0, 10.0)) == latex(tree)


def test_deep_fractions():
    tree = ["x", "y", "z"]
    for _ in range(60):  # what the layout of the test can do; see below for more
        tree = ["a", "b", ("frac", ["1"], tree), "c"]
    assert g.equation_of(laid(tree, 0.0, 0.0, 10.0)) == latex(tree)


def test_far_deeper_than_recursion_goes():
    n = 3_000
    run = [{"c": "a", "x0": 0.0, "x1": 1.0, "y0": 0.0, "y1": 1.0, "size": 1.0}]
    for k in range(n):
        run += [{"c": g.BAR, "x0": -float(k), "x1": 1.0 + k, "y0": 2.0 * k + 1, "y1": 2.0 * k + 2, "size": 1.0}, {"c": "b", "x0": 0.0, "x1": 1.0, "y0": 2.0 * k + 2, "y1": 2.0 * k + 3, "size": 1.0}]
    assert g.equation_of(run) == "\\frac{" * n + "a" + "}{b}" * n


def test_bars_without_both_sides_and_braces():
    base = laid(["a", "{", "b"], 0.0, 0.0, 10.0)
    lone = {"c": g.BAR, "x0": 0.0, "x1": 30.0, "y0": 5.0, "y1": 15.0, "size": 10.0}
    assert g.equation_of([*base, lone]) == r"a\{b" and g.equation_of([lone]) == "" and g.equation_of([]) == ""


def test_glyph_columns(spark):
    rows = [(1, laid(["x", ("^", ["2"]), "y", "z"], 0.0, 0.0, 10.0)), (2, None), (3, [{"c": "a", "x0": None, "x1": 1.0, "y0": 0.0, "y1": 1.0, "size": 1.0}])]
    df = spark.createDataFrame(rows, f"i int, g array<{g.GLYPH}>")
    assert {r["i"]: r["e"] for r in df.select("i", g.equation(F.col("g")).alias("e")).collect()} == {1: "x^{2}yz", 2: "", 3: ""}


def heaviest(found):
    """The weight of the heaviest of all choices that never fall."""
    best = 0
    for pick in product(*[[None, *x] for x in found]):
        got = [x for x in pick if x is not None]
        if got == sorted(got):
            best = max(best, sum(f[x] for f, x in zip(found, pick, strict=True) if x is not None))
    return best


def test_chains_against_all_choices():
    rng = random.Random(4)
    for _ in range(400):
        found = [{x: rng.randint(1, 4) for x in rng.sample(range(5), rng.randint(0, 3))} for _ in range(rng.randint(0, 6))]
        got = p.chain(found)
        chosen = [x for x in got if x is not None]
        assert chosen == sorted(chosen) and all(x is None or x in f for x, f in zip(got, found, strict=True))
        assert sum(f[x] for f, x in zip(found, got, strict=True) if x is not None) == heaviest(found)


WORD = "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허"


def passage(rng, n=40):
    return "".join(rng.choice(WORD) for _ in range(n))


def test_lost_passages_stand_where_they_were():
    rng = random.Random(5)
    for _ in range(200):
        texts = [passage(rng) for _ in range(rng.randint(2, 9))]
        lost = {i for i in range(len(texts)) if rng.random() < 0.4}
        kept = [t for i, t in enumerate(texts) if i not in lost]
        at = p.places(texts, kept)
        out = []
        for i in range(len(kept) + 1):
            out += [t for t, x in zip(texts, at, strict=True) if x == i] + kept[i : i + 1]
        assert out == texts


@pytest.mark.parametrize("swap", [True, False])
def test_paragraphs_out_of_order_move_nothing(swap):
    rng = random.Random(6)
    a, b, c, d, new = (passage(rng) for _ in range(5))
    blocks = [a, b, c, d]
    said = [d, a, b, new, c] if swap else [a, b, new, c, d]
    assert p.places(said, blocks) == [2 if x == new else None for x in said]


def test_restored_columns(spark):
    rng = random.Random(7)
    a, b, c = (passage(rng, 50) for _ in range(3))
    rows = [
        (1, [a, c], f"{a}\n\n{b}\n \n{c}"), (2, [a, c], f"{a}\n{b}\n{c}"), (3, [a], f"{a}\n\n<조건> {b}\n\n(1) {c}"), (4, [a], f"{a}\n\n| {b} |\n\nenglish words only here and more of them"),
        (5, [], f"{a}\n\n{b}"), (6, [None, "..."], f"{a}\n\n{b}"), (7, None, a), (8, [a], None), (9, [a, None], f"{b}\n\n{a}\n\n짧은 글"),
    ]
    df = spark.createDataFrame(rows, "i int, c array<string>, t string")
    got = {r["i"]: r["r"] for r in p.restored(df, "c", "t", "r").select("i", "r").collect()}
    assert got == {1: [a, f"<상자> {b}", c], 2: [a, f"<상자> {b}", c], 3: [a, f"<조건> {b}"], 4: [a], 5: [], 6: [None, "..."], 7: None, 8: [a], 9: [f"<상자> {b}", a, None]}
