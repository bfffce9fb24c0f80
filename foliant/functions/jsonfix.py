"""Repair of JSON that a model wrote: fences, trailing commas, lone backslashes, broken strings, missing and surplus brackets.

The first rung is Spark's own parser; only texts that it cannot read go through Python, batched by Arrow. Each rung
of the ladder is tried on what the one before left, until an object can be read; what follows the object is dropped.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
FENCE = re.compile(r"^\s*```(?:json)?\s*|\s*```\s*$")
LONE = re.compile(r'\\(?:u(?![0-9a-fA-F]{4})|(?!["\\/bfnrtu]))')
#: Between two tokens of well-formed JSON a closing quote is followed by one of these.
AFTER_STRING = set(",}]:")


def first_object(text: str) -> dict | None:
    try:
        found, _ = json.JSONDecoder(strict=True).raw_decode(text.lstrip())
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def without_trailing_commas(text: str) -> str:
    return re.sub(r",(\s*[}\]])", r"\1", text)


def with_escapes(text: str) -> str:
    """Backslashes that start no escape are doubled."""
    return LONE.sub(lambda m: "\\" + m[0], CONTROL.sub("", text))


def with_strings_closed(text: str) -> str:
    """Line breaks and quotes inside strings are escaped. A quote ends its string if what follows may stand after one."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\" and i + 1 < len(text):
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            rest = text[i + 1 :].lstrip()
            if inside and rest and rest[0] not in AFTER_STRING:
                out.append('\\"')
            else:
                inside = not inside
                out.append(c)
        elif inside and c in "\n\r\t":
            out.append({"\n": "\\n", "\r": "", "\t": "\\t"}[c])
        else:
            out.append(c)
        i += 1
    return "".join(out)


def with_brackets(text: str) -> str:
    """Missing closing brackets are added at the end, surplus ones dropped."""
    open_, out, inside, i = [], [], False, 0
    pairs = {"}": "{", "]": "["}
    while i < len(text):
        c = text[i]
        if inside and c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            inside = not inside
        elif not inside and c in "{[":
            open_.append(c)
        elif not inside and c in pairs:
            if pairs[c] not in open_:
                i += 1
                continue
            while open_[-1] != pairs[c]:
                out.append({"{": "}", "[": "]"}[open_.pop()])
            open_.pop()
        out.append(c)
        i += 1
    return "".join(out) + ('"' if inside else "") + "".join({"{": "}", "[": "]"}[c] for c in reversed(open_))


def repaired(text: str | None) -> str | None:
    """The first JSON object of a text, canonically written; null where none can be read."""
    if text is None:
        return None
    text = FENCE.sub("", text)
    at = text.find("{")
    if at < 0:
        return None
    text = text[at:]
    for rung in (lambda x: x, without_trailing_commas, with_escapes, with_strings_closed, with_brackets, without_trailing_commas):
        text = rung(text)
        if (found := first_object(text)) is not None:
            return json.dumps(found, ensure_ascii=False, sort_keys=True)
    return None


@F.pandas_udf(T.StringType())
def _repair(x: pd.Series) -> pd.Series:
    return x.map(repaired)


def json_object(x: Column) -> Column:
    """The JSON text of the object in x: what Spark's parser reads of it, else repaired, else null."""
    parsed = F.to_json(F.try_parse_json(x))
    return F.when(parsed.startswith("{"), parsed).otherwise(_repair(x))


def escaped_braces(text: str | None) -> str | None:
    """Braces without a partner get a backslash; escaped ones stay as they are."""
    if text is None:
        return None
    marks = [(m.start(), m[0]) for m in re.finditer(r"\\.|[{}]", text) if len(m[0]) == 1]
    open_, lone = [], set()
    for at, c in marks:
        if c == "{":
            open_.append(at)
        elif open_:
            open_.pop()
        else:
            lone.add(at)
    lone |= set(open_)
    return "".join("\\" + c if i in lone else c for i, c in enumerate(text))


@F.pandas_udf(T.StringType())
def braces_escaped(x: pd.Series) -> pd.Series:
    return x.map(escaped_braces)
