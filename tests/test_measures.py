import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import images, measures


def label(rng, depth):
    """A label and its width, worked out from how it is made."""
    parts, total = [], 0.0
    for k in range(rng.randint(1, 4)):
        kind = rng.randrange(7)
        if kind == 0:
            c = rng.choice("abxyAB123가")
            parts.append(c)
            total += measures.em(c)
        elif kind == 1:
            parts.append("=")
            total += measures.em("=") + 0.34
        elif kind == 2:
            parts.append("-")
            total += measures.em("−") + (0.34 if k else 0)
        elif kind == 3 and k:
            c = rng.choice("ij12")
            parts.append(rng.choice("^_") + c)
            total += 0.72 * measures.em(c)
        elif kind == 4 and k:
            inner = "".join(rng.choice("ab+-") for _ in range(rng.randint(1, 3)))
            parts.append(rng.choice("^_") + "{" + inner + "}")
            total += 0.72 * sum(map(measures.em, inner))
        elif kind == 5:
            parts.append(r"\alpha ")
            total += measures.em("α")
        else:
            parts.append(r"^\circ" if k else "°")
            total += 0.63 * 0.4
            parts.append(" " if parts[-1] != "°" else "")
    return "".join(parts), total


def test_widths_of_generated_labels():
    rng = random.Random(1)
    for _ in range(2_000):
        text, total = label(rng, 2)
        assert measures.label_width(text) == pytest.approx(total), text
        assert measures.label_width(rf"\overline{{\mathrm{{{text}}}}}") == pytest.approx(total), text


@pytest.mark.parametrize("text", [r"\frac{1}{2}", "a}", "{a", "$a", r"\!"])
def test_what_is_no_label(text):
    assert measures.label_width(text) is None


def formula(rng, depth):
    """A script, its width and whether it is tall, worked out recursively."""
    if not depth or rng.random() < 0.2:
        c = rng.choice(["x", "12", "TIMES", "SUM", "가"])
        return f" {c} ", {"TIMES": 811, "SUM": 1000, "가": 750}.get(c) or sum(measures.GLYPHS[x] + 100 for x in c), c == "SUM"
    a, b = formula(rng, depth - 1), formula(rng, depth - 1)
    kind = rng.randrange(6)
    if kind == 0:
        return f"{{{a[0]}}} over {{{b[0]}}}", max(a[1], b[1]) * 0.75 + 400, True
    if kind == 1:
        return f"{{{a[0]}}}^{{{b[0]}}}", a[1] + b[1] * 0.5, a[2] or b[2]
    if kind == 2:
        return f"sqrt {{{a[0]}}}", a[1], True
    if kind == 3:
        return f"LEFT ( {a[0]} RIGHT ]", a[1] + 3600 + 1200, a[2]
    if kind == 4:
        return f"bar {{{a[0]}}}", a[1], a[2]
    return f"{{{a[0]}}}{{{b[0]}}}", a[1] + b[1], a[2] or b[2]


def test_sizes_of_generated_equations():
    rng = random.Random(2)
    for depth in [*range(12)] * 30:
        script, width, tall = formula(rng, depth)
        assert measures.equation_size(script) == (max(int(0.8076 * width + 394), 400), 2400 if tall else 1200), script
    assert measures.equation_size("") == (400, 1200) and measures.equation_size("PMATRIX {1 & 2 # 3 & 4}")[1] == 2400
    deep = "{" * 3_000 + "x" + "} over {2}" * 3_000
    assert measures.equation_size(deep)[1] == 2400


def slow(pixels, width, white):
    """The same three measures pixel by pixel."""
    height = len(pixels) // width
    at = lambda y, x: pixels[min(max(y, 0), height - 1) * width + min(max(x, 0), width - 1)]
    lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(height) for x in range(width)]
    best, contrast = -1.0, 0.0
    for t in range(256):
        dark, light = [p for p in pixels if p <= t], [p for p in pixels if p > t]
        if dark and light:
            gap = sum(light) / len(light) - sum(dark) / len(dark)
            if len(dark) * len(light) * gap**2 > best * (1 + 1e-12):
                best, contrast = len(dark) * len(light) * gap**2, gap
    return float(np.var(lap)), 100 * sum(p < white for p in pixels) / len(pixels), contrast


def test_images_pixel_by_pixel():
    rng = random.Random(3)
    for _ in range(40):
        width, height = rng.randint(1, 7), rng.randint(1, 7)
        pixels = [rng.choice([0, 20, 30, 200, 239, 240, 255]) for _ in range(width * height)]
        got = images.measures_of(bytes(pixels), width, height, 240)
        assert list(got.values()) == pytest.approx(slow(pixels, width, 240))
        color = images.measures_of(bytes(p for p in pixels for _ in range(3)), width, height, 240)
        assert list(color.values()) == pytest.approx(slow(pixels, width, 240))


def test_columns(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x00\xff" * 4), 4, 2), (2, None, 4, 2), (3, bytearray(b"x"), 4, 2), (4, bytearray(b""), 0, None)], "i int, p binary, w int, h int")
    got = {r["i"]: r["m"] for r in df.select("i", images.measured(F.col("p"), F.col("w"), F.col("h")).alias("m")).collect()}
    assert got[1]["ink"] == 50 and got[1]["contrast"] == 255 and got[2] is got[3] is got[4] is None
    texts = spark.createDataFrame([("x",), (None,), (r"\frac",)], "t string")
    assert [r[0] for r in texts.select(measures.label_widths(F.col("t"))).collect()] == [0.5, None, None]
    assert [r[0]["height"] for r in texts.select(measures.equation_sizes(F.col("t"))).collect()] == [1200] * 3
