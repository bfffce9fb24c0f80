"""When two written answers mean the same: notations are absorbed, values are not.

Every side is canonicalised once, to columns that are then compared; only the sorting of bracketed factors needs
Python, batched by Arrow. Rules: equal notation; equal final value (after the last `=`, unless an inequality);
an overlap of declared equivalents; equal cores without a trailing aside; or, part by part, any of these.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import let

#: Notations with one meaning.
SYNONYMS = [(r"\\leq?(?![a-z])", r"\leq"), (r"\\geq?(?![a-z])", r"\geq"), (r"\\neq?(?![a-z])", r"\neq"), (r"\\cdot", r"\times"), (r"\\dfrac", r"\frac")]
CONFIDENCE = ["high", "medium", "low"]
LABEL = re.compile(r"\(\d{1,2}\)")
#: A point's name before its coordinates, an aside at the end, what declares equivalents, and where parts begin.
POINT_LABEL = r"(?:\\mathrm\{[A-Z]\}|\b[A-Z])(?=\([^()]*,[^()]*\))"
ASIDE = r"\((?:즉|따라서|직선)[^()]*\)$"
DECLARED = r"^(.*?)(?:\((?:즉|곧)(.+)\)|,\s*(?:즉|곧)\s+(.+))$"
PART = r"(?=\(\d{1,2}\)\s)"


def factors_sorted(text: str) -> str:
    """Neighbouring bracketed factors in lexical order; part labels such as (1) stay where they are and part the runs."""
    out, run, depth, start = [], [], 0, 0

    def close() -> None:
        out.extend(sorted(run))
        run.clear()

    i = 0
    while i < len(text):
        if text[i] != "(":
            close()
            out.append(text[i])
            i += 1
            continue
        depth, start, j = 0, i, i
        while j < len(text):
            depth += (text[j] == "(") - (text[j] == ")")
            j += 1
            if depth == 0:
                break
        if depth:  # not balanced: the sign stands for itself
            close()
            out.append(text[i])
            i += 1
            continue
        group = text[start:j]
        if LABEL.fullmatch(group):
            close()
            out.append(group)
        else:
            run.append(group)
        i = j
    close()
    return "".join(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sort_factors(x: pd.Series) -> pd.Series:
    return x.map(lambda texts: [factors_sorted(t) for t in texts], na_action="ignore")


def _java(replacement: str) -> str:
    return replacement.replace("\\", "\\\\")


def bare_notation(x: Column) -> Column:
    """The canonical notation of an answer, factors as written."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"\$|\\,|~|\\ ", "")
    for pattern, to in SYNONYMS:
        s = F.regexp_replace(s, pattern, _java(to))
    s = F.regexp_replace(s, r"\s+", "")
    s = F.regexp_replace(s, r"([\^_])\{([^{}])\}", "$1$2")
    s = F.regexp_replace(s, POINT_LABEL, "")
    return F.regexp_replace(s, ASIDE, "")


def with_sorted_factors(texts: Column) -> Column:
    """An array of notations with neighbouring factors sorted; Python sees only arrays that have any."""
    some = F.exists(texts, lambda t: t.contains(")("))
    return F.coalesce(_sort_factors(F.when(some, texts)), texts)


def notation(x: Column) -> Column:
    """The canonical notation of an answer."""
    return F.get(with_sorted_factors(F.array(bare_notation(x))), F.lit(0))


def final_value(n: Column) -> Column:
    """What a notation says in the end: an inequality as a whole, else what stands after the last equals sign."""
    tail = F.substring_index(n, "=", -1)
    return F.when(n.rlike(r"[<>]|\\leq|\\geq") | (tail == ""), n).otherwise(tail)


def equivalents(x: Column) -> Column:
    """The notations that an answer declares equivalent: X (즉 Y), or X, 즉 Y."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""), r"\$", ""), r"\s+", " ")
    pattern = DECLARED
    both = F.array(F.regexp_extract(flat, pattern, 1), F.coalesce(F.nullif(F.regexp_extract(flat, pattern, 2), F.lit("")), F.regexp_extract(flat, pattern, 3)))
    return F.when(flat.rlike(pattern), both).otherwise(F.array(flat))


def core(x: Column) -> Column:
    """An answer without an aside in brackets at its end."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""), r"\s*\([^()]*\)\s*$", "")


def parts(x: Column) -> Column:
    """The parts of an answer such as (1) … (2) …, labels off; empty where there are fewer than two."""
    found = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), PART), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.when(F.size(found) > 1, F.transform(found, lambda s: F.regexp_replace(s, r"^\(\d{1,2}\)\s*", ""))).otherwise(F.array().cast("array<string>"))


def canonical(x: Column) -> Column:
    """All forms that an answer is compared in, and after them those of its parts: of each its notation, the core's, and the two declared equivalents'."""

    def forms(t: Column) -> Column:
        e = equivalents(t)
        return F.array(t, core(t), F.get(e, F.lit(0)), F.get(e, F.lit(1)))

    # One expression for the notation of all forms, as it is long.
    raw = F.flatten(F.transform(F.concat(F.array(x), parts(x)), forms))
    return with_sorted_factors(F.transform(raw, bare_notation))


def agree(a: Column, b: Column) -> Column:
    """Whether two canonical answers mean the same: as wholes, or part by part."""

    def alike(i: Column) -> Column:
        at = lambda x, k: F.get(x, 4 * i + k)
        na, nb = at(a, 0), at(b, 0)
        met = F.lit(False)
        for j in (2, 3):
            for k in (2, 3):
                met |= (at(a, j) != "") & (at(a, j) == at(b, k))
        return (na == nb) | (final_value(na) == final_value(nb)) | met | ((at(a, 1) != "") & (at(a, 1) == at(b, 1)))

    by_part = (F.size(a) > 4) & (F.size(a) == F.size(b)) & F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a) / 4 - 1).cast("int")), alike)
    return alike(F.lit(0)) | by_part


def same_answer(a: Column, b: Column) -> Column:
    """Whether two answers mean the same."""
    return let(F.struct(canonical(a).alias("a"), canonical(b).alias("b")), lambda z: agree(z["a"], z["b"]))


def worst_confidence(a: Column, b: Column) -> Column:
    """The lower of two confidences; unknown ones count as medium."""
    rank = lambda c: F.coalesce(F.create_map(*[x for i, v in enumerate(CONFIDENCE) for x in (F.lit(v), F.lit(i))])[c], F.lit(1))
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.greatest(rank(a), rank(b)) + 1)
