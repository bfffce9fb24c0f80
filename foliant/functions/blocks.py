"""Passes over a question's array of blocks: boxes that vision made up, figures out of place, spaces, commas, emphasis.

Each takes and returns an array of `sources.readers.BLOCK`; a pass that looks at neighbours reads them by place, so a
chain of passes stays one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import SCORE, hangul_key, let, stripped, text_of, without_lead, without_nulls
from foliant.sources.readers import BLOCK

#: A box's mark at a text's start, and there without a particle; inside a text before a first item; a negated choice; a unit of scores.
BOX_LEAD = r"^\s*(?:<\s*(?:상자|조건|보기|증명)\s*>|\[\s*(?:조건|보기)\s*\])\s*"
BOX_START = r"^\s*(?:<\s*상자\s*>|(?:<\s*(?:조건|보기|증명)\s*>|\[\s*(?:조건|보기)\s*\])(?![가-힣])(?!\s+(?:중에서|에서|중)(?=[\s,.?]|$)))"
ITEM_AHEAD = r"(?=\s*(?:[•·▪◦○〇ㅇ]|[ㄱ-ㅎ]\s*\.|[（(]\s*[가-힣]\s*[)）]))"
BOX_INSIDE = r"<\s*상자\s*>" + ITEM_AHEAD + r"|(?:<\s*(?:조건|보기|증명)\s*>|\[\s*(?:조건|보기)\s*\])(?![가-힣])" + ITEM_AHEAD
NEGATED = r"(않은|않는|아닌|틀린)(?=\s*것(?!으로))"
NEGATION = r"않은|않는|아닌|틀린"
#: An ordinal's prefix at a text's end, its number; a question mark before a bracket, and at a text's end.
ORDINAL, ORDINAL_NUMBER, ASKED_BRACKET, ASKED = "(?:^|[^가-힣])제$", r"^\d+$", r"([?？])(\()", "[?？]$"
#: What an item in a box begins with, and the orders of its labels.
ITEM = r"[(（]\s*([가-힣])\s*[)）]|(?:^|(?<=\s))([ㄱ-ㅎ])\s*\.|([①-⑩])"
LABELS = ["가나다라마바사아자차카타파하", "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊ", "①②③④⑤⑥⑦⑧⑨⑩"]
#: Hangul that a box must have to count as a repetition, of the stem and of a part; what a figure's note begins with.
STEM_REPEATED, PART_REPEATED = 8, 12
FIGURE_NOTE = "※ 그림 자리"


def is_text(b: Column) -> Column:
    return F.coalesce(b["type"] == "text", F.lit(False))


def is_equation(b: Column) -> Column:
    return F.coalesce(b["type"].isin("equation", "equation_block"), F.lit(False))


def with_value(b: Column, value: Column) -> Column:
    return b.withField("value", value)


def without_duplicate_boxes(blocks: Column) -> Column:
    """Without boxes whose Hangul stands in the other texts together."""

    def double(b: Column, i: Column) -> Column:
        own = hangul_key(F.regexp_replace(text_of(b["value"]), BOX_LEAD, ""))
        others = F.array_join(F.transform(F.filter(blocks, lambda x, j: (j != i) & is_text(x)), lambda x: hangul_key(x["value"])), "")
        return F.coalesce(is_text(b) & b["value"].rlike(BOX_LEAD) & (F.length(own) >= STEM_REPEATED) & F.contains(others, own), F.lit(False))

    return F.filter(blocks, lambda b, i: ~double(b, i))


def without_repeated_parts(blocks: Column, parts: Column) -> Column:
    """Without what a box repeats of the question's parts: the box goes, or what follows in it stays as text."""
    texts = F.transform(parts, lambda s: hangul_key(F.array_join(F.transform(F.filter(s["contents"], is_text), lambda b: text_of(b["value"])), "")))
    keys = F.filter(texts, lambda k: F.length(k) >= PART_REPEATED)

    def one(b: Column, keys: Column) -> Column:
        body = F.regexp_replace(text_of(b["value"]), BOX_LEAD, "")
        rest = F.get(without_nulls(F.transform(keys, lambda k: without_lead(body, k))), F.lit(0))
        kept = F.when(hangul_key(F.regexp_replace(rest, SCORE, " ")) != "", with_value(b, F.regexp_replace(rest, r"^[ .,)\]·]+", "")))
        return F.when(~(is_text(b) & b["value"].rlike(BOX_LEAD)) | rest.isNull(), b).otherwise(kept)

    return let(keys, lambda k: F.when(F.size(k) > 0, without_nulls(F.transform(blocks, lambda b: one(b, k)))).otherwise(blocks))


def split_at_boxes(blocks: Column) -> Column:
    """Texts with a box's mark inside, before a first item, cut there."""

    def cut(b: Column) -> Column:
        at = F.regexp_instr(text_of(b["value"]), F.lit(BOX_INSIDE))
        head = F.regexp_replace(F.substring(b["value"], F.lit(1), at - 1), r"\s+$", "")
        return F.when(is_text(b) & (at > 1) & (head != ""), F.array(with_value(b, head), with_value(b, F.substring(b["value"], at, F.length(b["value"]))))).otherwise(F.array(b))

    return F.flatten(F.transform(blocks, cut))


def figure_before_box(blocks: Column) -> Column:
    """A figure at the end moved before the first box, where the text before that box speaks of it."""
    note = F.element_at(blocks, -1)
    figure = (note["type"] == "image") | (is_text(note) & F.ltrim(text_of(note["value"])).startswith(FIGURE_NOTE))
    box = F.array_position(F.transform(blocks, lambda b: is_text(b) & text_of(b["value"]).rlike(BOX_START)), True).cast("int")  # from 1, 0 without

    def moved(k: Column) -> Column:
        before = F.slice(blocks, F.lit(1), k - 1)
        said = F.array_join(F.transform(F.filter(before, is_text), lambda b: text_of(b["value"])), "")
        after = F.slice(blocks, k, F.size(blocks) - k)
        return F.when(F.coalesce(figure, F.lit(False)) & (k > 0) & (k < F.size(blocks)) & said.rlike("그림|그래프"), F.concat(before, F.array(note), after)).otherwise(blocks)

    return F.when(F.size(blocks) > 0, let(box, moved)).otherwise(blocks)


def commas_tightened(blocks: Column) -> Column:
    """No spaces before a comma that follows an equation."""
    return F.transform(blocks, lambda b, i: F.when((i > 0) & is_text(b) & is_equation(F.get(blocks, i - 1)), with_value(b, F.regexp_replace(b["value"], r"^[ \t]+(?=,)", ""))).otherwise(b))


def spaced_before_equations(blocks: Column) -> Column:
    """A space between Hangul and an equation after it; an ordinal's prefix stays with its number."""

    def one(b: Column, i: Column) -> Column:
        after = F.get(blocks, i + 1)
        ordinal = b["value"].rlike(ORDINAL) & stripped(text_of(after["value"])).rlike(ORDINAL_NUMBER)
        return F.when(is_text(b) & is_equation(after) & b["value"].rlike("[가-힣]$") & ~ordinal, with_value(b, F.concat(b["value"], F.lit(" ")))).otherwise(b)

    return F.transform(blocks, one)


def spaced_after_questions(blocks: Column) -> Column:
    """A space between a question mark and a bracket after it, in one text or in two neighbours."""
    own = F.transform(blocks, lambda b: F.when(is_text(b), with_value(b, F.regexp_replace(b["value"], ASKED_BRACKET, "$1 $2"))).otherwise(b))

    def between(xs: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            after = F.get(xs, i + 1)
            meets = is_text(b) & is_text(after) & text_of(after["value"]).startswith("(") & text_of(b["value"]).rlike(ASKED)
            return F.when(meets, with_value(b, F.concat(b["value"], F.lit(" ")))).otherwise(b)

        return F.transform(xs, one)

    return let(own, between)


def negations_emphasised(blocks: Column) -> Column:
    """The negation of a choice of what is not so, in a block of its own, bold and underlined; an underlined negation becomes bold."""
    strong = lambda b, v: with_value(b, v).withField("bold", F.lit(True)).withField("underline", F.lit(True))

    def one(b: Column) -> Column:
        parts = F.split(F.regexp_replace(text_of(b["value"]), NEGATED, "\x01$1\x01"), "\x01")
        runs = F.filter(F.transform(parts, lambda p, i: F.when(i % 2 == 1, strong(b, p)).otherwise(with_value(b, p))), lambda x: x["value"] != "")
        under = F.coalesce(b["underline"], F.lit(False))
        bold = b.withField("bold", F.coalesce(b["bold"], F.lit(False)) | text_of(b["value"]).rlike(NEGATION))
        return F.when(is_text(b) & under, F.array(bold)).when(is_text(b) & text_of(b["value"]).rlike(NEGATED), runs).otherwise(F.array(b))

    return F.flatten(F.transform(blocks, one))


def right_stripped(blocks: Column) -> Column:
    """No spaces at the end of the last text; one of spaces only goes."""
    n, last = F.size(blocks), F.element_at(blocks, -1)
    bare = F.regexp_replace(text_of(last["value"]), r"\s+$", "")
    done = F.concat(F.slice(blocks, F.lit(1), n - 1), F.when(bare != "", F.array(with_value(last, bare))).otherwise(F.array().cast(f"array<{BLOCK}>")))
    return F.when((n > 0) & is_text(last) & (text_of(last["value"]) != ""), done).otherwise(blocks)


def box_text(rows: Column) -> Column:
    """The text of a box from its rows: cut before each item, items in the order of their labels if two or more and three fifths of the pieces have one, joined by bullets."""
    bare = F.transform(rows, lambda r: stripped(F.regexp_replace(text_of(r), r"\s+", " ")))
    pieces = F.filter(F.flatten(F.transform(bare, lambda r: F.transform(F.split(F.regexp_replace(r, f"({ITEM})", "\x01$1"), "\x01"), stripped))), lambda p: p != "")
    order = F.create_map(*[F.lit(v) for names in LABELS for i, c in enumerate(names) for v in (c, i)])
    label = lambda p: F.concat(*[F.regexp_extract(p, f"^(?:{ITEM})", k) for k in (1, 2, 3)])

    def ordered(xs: Column) -> Column:
        keyed = F.transform(xs, lambda p, i: F.struct(order[label(p)].isNull().alias("none"), F.coalesce(order[label(p)], F.lit(0)).alias("label"), i.alias("place"), p.alias("text")))
        known = F.size(F.filter(keyed, lambda k: ~k["none"]))
        return F.transform(F.when(known >= F.greatest(F.lit(2.0), 0.6 * F.size(xs)), F.array_sort(keyed)).otherwise(keyed), lambda k: k["text"])

    return F.array_join(let(pieces, ordered), " • ")
