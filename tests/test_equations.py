import random
import sys

import pytest
from pyspark.sql import functions as F

from foliant.functions import equations as eq

SCRIPTS = [
    (r"\dfrac{1}{2}", "{1} over {2}"), ("2²³", "2^{23}"), (r"a \le b", "a LEQ b"), ("a ≤ b", "a LEQ b"), (r"x \not\in A", "x NOTIN A"), (r"\left( \frac{a}{b} \right)", "LEFT ( {a} over {b} RIGHT )"),
    (r"\binom{n}{k}", "LEFT ( {n} atop {k} RIGHT )"), (r"\overline{AB}", "bar {AB}"), (r"\vec{a}+\hat{b}", "VEC {a}+ HAT {b}"), (r"\sum\limits_{k=1}^{n} a_k", "SUM _{k=1}^{n} a_{k}"), (r"\lim_{x \to 0} f(x)", "lim _{x -> 0} f(x)"),
    (r"\begin{pmatrix} 1 & 2 \\ 3 & 4 \end{pmatrix}", "PMATRIX { 1 & 2 # 3 & 4 }"), (r"\textcircled{3} \textcircled{ㄴ}", "③ ㉡"), (r"5\text{kg}", "5kg"), (r"\sqrt[3]{x}", "root {3} of {x}"), (r"90^{\circ}", "90°"),
    (r"\left\{ 1, 2 \right\}", "LEFT { 1, 2 RIGHT }"), (r"\Delta \geq \theta", "Delta GEQ theta"), ("", ""), (None, ""),
]


def test_to_script(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(SCRIPTS)], "i int, x string").select("i", eq.to_script(F.col("x")).alias("s"), eq.leaks(eq.to_script(F.col("x"))).alias("leaks"))
    for r in df.collect():
        assert r["s"] == SCRIPTS[r["i"]][1], SCRIPTS[r["i"]]
        assert not r["leaks"]


@pytest.mark.parametrize(
    ("script", "latex"),
    [("{1} over {2}", r"\frac{1}{2}"), ("a LEQ b", r"a \leq b"), ("bar {AB}", r"\overline{AB}"), ("VEC {a}", r"\vec{a}"), ("LEFT ( {n} atop {k} RIGHT )", r"\binom{n}{k}"), ("LEFT ( x RIGHT )", r"\left( x \right)"), ("x -> 0", r"x \rightarrow 0"), ("a != b", r"a \neq b")],
)
def test_to_latex(spark, script, latex):
    assert spark.createDataFrame([(script,)], "x string").select(eq.to_latex(F.col("x"))).first()[0] == latex


FOLDS = [
    ("a=b", "a=b"), ("abc=def=ghi", "abc # &=def # &=ghi"), ("abc=def=1", "abc # &=def =1"), ("f(a=b)=ccc=ddd", "f(a=b) # &=ccc # &=ddd"), ("aaa=bbb=ccc=ddd=eee=fff", "aaa # &=bbb # &=ccc # &=ddd =eee =fff"),
    ("LEFT | a=b RIGHT | =ccc=ddd", "LEFT | a=b RIGHT | # &=ccc # &=ddd"), ("a & b = c = ddd", "a & b = c = ddd"), ("aaa<=bbb=ccc", "aaa<=bbb=ccc"), ("", ""),
]


def test_folds(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(FOLDS)], "i int, x string").select("i", eq.folded(F.col("x")).alias("s"))
    assert {r["i"]: r["s"] for r in df.collect()} == {i: b for i, (_, b) in enumerate(FOLDS)}


def tree(rng, depth):
    """A formula as LaTeX and as a script, of the given depth."""
    if not depth:
        return rng.choice([("x", "x"), ("12", "12"), (r"\alpha", "alpha"), ("AB", "AB"), ("y", "y")])
    a, b = tree(rng, depth - 1), tree(rng, rng.randrange(min(depth, 3)))
    kind = rng.randrange(7)
    one = [(r"\frac{%s}{%s}", "{%s} over {%s}"), (r"\sqrt[%s]{%s}", "root {%s} of {%s}"), (r"\binom{%s}{%s}", "LEFT ( {%s} atop {%s} RIGHT )"), ("{%s}^{%s}", "{%s}^{%s}"), (r"\left[ %s+%s \right]", "LEFT [ %s+%s RIGHT ]")]
    if kind < 5:
        return one[kind][0] % (a[0], b[0]), one[kind][1] % (a[1], b[1])
    return (r"\overline{%s}" % a[0], "bar {%s}" % a[1]) if kind == 5 else (r"\sqrt{%s}" % a[0], "sqrt {%s}" % a[1])


def bare(x):
    return "".join(x.split())


def test_trees_of_any_depth_both_ways():
    rng = random.Random(6)
    for depth in [*range(1, 31)] * 4:
        latex, script = tree(rng, depth)
        assert bare(eq.latex_of(script)) == bare(latex)
        assert bare(eq.script_of(eq.latex_of(script))) == bare(script), latex
    for n in (5_000, 20_000):  # far beyond what recursion could read
        assert n > sys.getrecursionlimit() and eq.latex_of("sqrt {" * n + "x" + "}" * n) == r"\sqrt{" * n + "x" + "}" * n


@pytest.mark.parametrize(
    ("script", "latex"),
    [
        ("a over b", r"\frac{a}{b}"), ("{a+b} over 2", r"\frac{a+b}{2}"), ("sqrt x", r"\sqrt{x}"), ("1 over {1 over {1 over {1 over {1 over 2}}}}", r"\frac{1}{\frac{1}{\frac{1}{\frac{1}{\frac{1}{2}}}}}"),
        ("x^2 over y_1 + 3", r"\frac{x^{2}}{y_{1}} + 3"), ("a over b over c", r"\frac{\frac{a}{b}}{c}"), ("root 3 of {x+1}", r"\sqrt[3]{x+1}"), ("RMABC", r"\mathrm{ABC}"), ("PMATRIX {1 & 2 # 3 & 4}", r"\begin{pmatrix} 1 & 2 \\ 3 & 4 \end{pmatrix}"),
        ("INT from {0} to {1} x", r"\int_{0}^{1} x"), ('x "정수 인" y', r"x \text{정수 인} y"), ("2 over", r"\frac{2}{}"), ("over", r"\frac{}{}"), ("}{", ""), ("LEFT { x RIGHT .", r"\left\{ x \right."), ("LEFT ( x", r"\left( x \right."),
    ],
)
def test_operands_and_broken_scripts(script, latex):
    assert eq.latex_of(script) == latex


@pytest.mark.parametrize(
    ("latex", "script"),
    [
        (r"P(A\cap B)", "rm P it (A CAP B)"), (r"\frac{P(A\cap B)}{P(B)}", "{rm P it (A CAP B)} over {rm P it (B)}"), ("P(x)", "P(x)"), ("E(2X+1)", "rm E it (2X+1)"), (r"\mathrm{P}(2,3)", "rm {P}(2,3)"),
        (r"(A-B^{c})\cup X=X", "(A-B^{C}) CUP X=X"), ("n(A^c)", "n(A^{C})"), (r"(A\cap B^c)^c", "(A CAP B^{C})^{C}"), (r"3^{b}\times 5^c", "3^{b} TIMES 5^{c}"), ("(x+1)^c", "(x+1)^{c}"), ("AB^c", "AB^{c}"), ("A'^c", "A'^{C}"),
        (r"(\frac{1}{2})^2", "LEFT ( {1} over {2} RIGHT )^{2}"), ("f(x)(y)", "f(x)(y)"), (r"\frac12", "{1} over {2}"), (r"\{1\}", '"{"1"}"'), (r"\text{그 외}", '"그 외"'), (r"\frac{1}", "{1} over {}"), ("x}^", "x^{}"), (r"\left(", "LEFT ("),
    ],
)
def test_marks_of_sets_and_probability(latex, script):
    assert eq.script_of(latex) == script


@pytest.mark.parametrize(
    ("latex", "script"),
    [
        (r"\vec{a} \cdot \vec{b}", "VEC {a} ⦁ VEC {b}"), (r"2 \cdot 3", "2 CDOT 3"), (r"(\vec{a}+x) \cdot c", "( VEC {a}+x) ⦁ c"), (r"c \cdot \left( x+\vec{a} \right)", "c ⦁ LEFT ( x+ VEC {a} RIGHT )"), (r"\vec{a} x \cdot y", "VEC {a} x CDOT y"),
        (r"\vec a \cdot b", "VEC {a} ⦁ b"), (r"(x) \cdot (y", "(x) CDOT (y"), (r"\cdot", "CDOT"), (r"\overline{a} \cdot b", "bar {a} CDOT b"),
    ],
)
def test_products_of_vectors(latex, script):
    assert eq.script_of(latex) == script and bare(eq.script_of(eq.latex_of(script))) == bare(script)


def test_distinct_equations_and_nulls(spark):
    df = spark.createDataFrame([("a over b",), ("a over b",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(eq.to_latex(F.col("x"))).collect()] == [r"\frac{a}{b}"] * 2 + ["", ""]
    assert df.select(eq.inline_to_latex(F.lit("if $a over b$ then $sqrt 2$."))).first()[0] == r"if $\frac{a}{b}$ then $\sqrt{2}$."
