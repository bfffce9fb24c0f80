import random
import time

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import license_scan as li


def distance(template, words):
    """The least edits that make the template a run of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(template, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, words, edits, kind, free):
    """The words with so many edits at places that are free."""
    out = [[w] for w in words]
    for i in rng.sample(free, edits):
        out[i] = {"change": ["changed"], "leave out": [], "put in": [words[i], "more"]}[kind]
    return [w for x in out for w in x]


@pytest.mark.parametrize("kind", ["change", "leave out", "put in"])
def test_every_template_is_found_at_the_full_distance(kind):
    rng = random.Random(kind)
    noise = [f"w{i}" for i in range(200)]
    index = li.build(li.TEMPLATES)
    texts, planted = [], []
    for k, name in enumerate(index.names):
        words, marks = li.template_words(li.TEMPLATES[name])
        inner = {i for a, b in marks for i in range(a, b)}
        free = [i for i in range(len(words)) if i not in inner]
        for part in (0.5, 1, 1, 1):
            texts.append(" ".join(rng.choices(noise, k=30) + edited(rng, words, min(len(free), int(part * (len(words) // 5))), kind, free) + rng.choices(noise, k=30)))
            planted.append(k)
    got = li.matches(index, pa.array(texts))
    for d, k, matched, *_ in got:
        template, words = index.templates[k].tolist(), [index.words.get(w, 0) for w in li.bare(pa.array(texts[d].split())).to_pylist() if w]
        assert distance(template, words) <= len(template) // 5 and matched >= len(template) - len(template) // 5
    found = {(d, k) for d, k, *_ in got}
    alike = {k: v for k, v in enumerate(index.names)}
    for d, k in enumerate(planted):  # or a sibling, of more matched words
        assert (d, k) in found or any(x == d and alike[y].split("-")[0] == alike[k].split("-")[0] for x, y in found), (alike[k], texts[d])


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under the MIT License.", {"mit-line"}), ("Released under an MIT license", {"mit-line"}), ("Released under the BSD License.", set()), ("Released under the GPL License.", set()),
        ("Licensed under CC BY-NC 3.0.", set()), ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0-line"}), ("Licensed under CC BY-SA 4.0.", {"cc-by-sa-4.0-short"}),
        ("This work is licensed under the GNU General Public License, version 2.", {"gpl-2-line"}), ("This work is licensed under the GNU Lesser General Public License, version 3.", {"lgpl-3-line"}),
        ("This work is licensed under the GNU General Public License, version 4.", set()), ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", {"cc-by-nc-4.0-long"}),
        ("Licensed under the Mozilla License, Version 2.0.", set()), ("Licensed under the Apache License, Version 1.1.", set()), ("Licensed under the Apache License, Version 2.0!", {"apache-2.0-line"}),
        *[(t.replace("{", "").replace("}", ""), {k}) for k, t in li.TEMPLATES.items()],
    ],
)
def test_siblings_are_told_apart(text, want):
    index = li.build(li.TEMPLATES)
    assert {index.names[k] for _, k, *_ in li.matches(index, pa.array(["Some words. " + text + " More words."]))} == want


def test_many_matches_and_long_templates():
    index = li.build(li.TEMPLATES)
    began = time.time()
    assert len(li.matches(index, pa.array(["Released under the MIT License. " * 20_000]))) == 20_000
    rng = random.Random(3)
    words = [f"w{rng.randrange(900)}" for _ in range(5_600)]
    changed = edited(rng, words, 1_100, "change", range(5_600))
    assert [m[2] for m in li.matches(li.build({"long": " ".join(words)}), pa.array([" ".join(changed)]))] == [4_500]
    assert time.time() - began < 60


def test_winnowing_keeps_one_of_each_window():
    h = np.random.default_rng(0).integers(0, 1 << 40, 100)
    kept = set(li.winnow(h, 4))
    assert all(kept & set(range(i, i + 4)) for i in range(97))
    assert len(kept) < 60


def test_spans(spark):
    df = spark.createDataFrame([(1, "Hi — Released under the  MIT License. Bye. Released under the MIT license"), (2, "Released under no license")], "doc_id long, text string")
    rows = [r for r in li.scan(df).collect()]
    assert [(r["template"], r["coverage"]) for r in rows] == [("mit-line", 1.0)] * 2
    text = df.first()["text"]
    for r in rows:
        assert text[r["start"] : r["end"]].lower().startswith("released") and text[r["start"] : r["end"]].lower().rstrip(".").endswith("license")
        assert r["spans"] == f"{r['start']}:{r['end']}"


@pytest.mark.parametrize("templates", [{}, {"a": ""}, {"a": None, "b": "fox"}])
def test_odd_templates(odd, templates):
    rows = li.scan(odd, templates).collect()
    assert {r["template"] for r in rows} <= {"b"} and len(rows) == (3 if "b" in templates else 0)


def test_odd_rows(odd, none):
    assert li.scan(odd).count() == 0
    assert li.scan(none).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// SPDX-License-Identifier: Apache-2.0", {"spdx-apache-2.0"}), ("SPDX-License-Identifier: GPL-3.0-or-later.", {"spdx-gpl-3.0-or-later"}), ("SPDX-License-Identifier: Apache-1.1", set()),
        ("MIT License\n\nCopyright (c) 2020 A. Person", {"mit-head"}), ("a city called Mit, licensed", set()), (li.TEMPLATES["mit"], {"mit"}), (li.TEMPLATES["mit-notice"], {"mit-notice"}), (li.TEMPLATES["zlib"].replace("{", "").replace("}", ""), {"zlib"}),
    ],
)
def test_whole_licenses_heads_and_identifiers(text, want):
    index = li.build(li.TEMPLATES)
    assert {index.names[k] for _, k, *_ in li.matches(index, pa.array([text.replace("{", "").replace("}", "")]))} == want


def test_denied(spark):
    rows = [(1, "It is not licensed under CC BY 4.0."), (2, "Licensed under CC BY 4.0."), (3, "Not! Licensed under CC BY 4.0.")]
    got = {r["doc_id"]: r["denied"] for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: True}
