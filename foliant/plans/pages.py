"""Queries of boxes, choices and documents put together from pages. Turns of conversations stand for blocks and pieces of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import boxes, styles
from foliant.operators import assembly
from foliant.plans.formulas import a_block
from foliant.plans.registry import query, spread, table
from foliant.sources.readers import BLOCK


@query(r"""WITH t AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN regexp_replace(text, '[.?!\s]+$', '') WHEN conv_id % 5 = 4 THEN text || ',' ELSE text END AS v FROM conversations),
e AS (SELECT *, regexp_matches(v, '[.?!]\s*$') AS ended, count(*) OVER (PARTITION BY conv_id) AS n FROM t)
SELECT conv_id, CASE WHEN max(n) > 2 AND NOT regexp_matches(max(CASE WHEN turn = 1 THEN v END), ',\s*$') AND bool_or(ended AND turn % 2 = 1 AND turn < n - 1) THEN 2 END::INT AS behind FROM e GROUP BY 1 HAVING max(n) > 1""")
def boxes_bounded(spark, d):
    """Where the box that a conversation's second turn opens ends: with that turn, unless a comma or a sentence that no text ends leads on into the equation after it."""
    t, c = F.col("turn"), F.col("conv_id")
    v = F.when((c + t) % 3 == 0, F.regexp_replace("text", r"[.?!\s]+\z", "")).when(c % 5 == 4, F.concat("text", F.lit(","))).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", v.alias("v")))).alias("x")).filter(F.size("x") > 1)
    kind = lambda r: F.when((r["turn"] % 2 == 0) & (r["turn"] > 0), "equation").otherwise("text")
    blocks = F.transform("x", lambda r: a_block(kind(r), F.concat(F.when(r["turn"] == 1, "<상자> ").otherwise(""), r["v"])))
    return rows.select("conv_id", boxes.box_bounds(blocks).alias("behind"))


@query(r"""SELECT conv_id, 'text:함수 |' || CASE WHEN conv_id % 2 = 0 THEN 'text_:아닌|text: |' ELSE '' END || 'equation:f(' || conv_id || ')|text: 의 값|text#:<조건> ○ |equation#:' || length(text) || 'x + 1|text#:이다.' || CASE WHEN conv_id % 3 = 0 THEN '|equation:\begin{cases} ' || conv_id || ' \end{cases}' ELSE '|equation_block:y' END || '|equation:z|text:를 구하시오.' AS blocks
FROM (SELECT * FROM conversations WHERE turn = 0)""")
def contents_read(spark, d):
    """A question's raw blocks read: emphasis, formulas, bullets, cases, figures left out, blocks of the box marked."""
    c = F.col("conv_id")
    head = F.concat(F.lit("함수 "), F.when(c % 2 == 0, "__아닌__ ").otherwise(""), F.lit("f("), c, F.lit(") 의 값"))
    box = F.concat(F.lit("<조건> ● "), F.length("text"), F.lit("x + 1이다."))
    shown = F.when(c % 3 == 0, F.concat(F.lit(r"\begin{cases} "), c, F.lit(r" \end{cases}"))).otherwise("y")
    blocks = F.array(a_block("text", head), a_block("figure", F.col("text")), a_block("text", box), a_block("equation_block", shown), a_block("text", F.lit(r"\(z\)를 구하시오.")))
    kind = lambda b: F.concat(b["type"], F.when(F.coalesce(b["underline"], F.lit(False)), "_").otherwise(""), F.when(F.coalesce(b["box_member"], F.lit(False)), "#").otherwise(""))
    got = boxes.question_blocks(blocks)
    return table(spark, d, "conversations").filter("turn = 0").select("conv_id", F.array_join(F.transform(got, lambda b: F.concat(kind(b), F.lit(":"), b["value"])), "|").alias("blocks"))


@query(r"""SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN '(가),(나)' ELSE '' END AS heads, CASE WHEN p_size % 4 > 0 THEN 'equation:' || p_size || '|text:' || chr(9) || '|equation:' || p_partkey ELSE 'text:(가) |equation:' || p_size || '|text:, (다) |equation:' || p_partkey END AS first_choice FROM part""")
def choices_read(spark, d):
    """Choices without their own signs; where all have the same heads of columns, those are taken out and tabs part the columns."""
    z, p = F.col("p_size"), F.col("p_partkey")
    one = lambda n, sign, head: F.struct(F.lit(n).alias("number"), F.array(a_block("text", F.concat(F.lit(f"{sign} (가) "), z, F.lit(", "), head, F.lit(" "), p))).alias("contents"))
    got = boxes.choices_read(F.array(one(1, "①", F.when(z % 4 > 0, "(나)").otherwise("(다)")), one(2, "②", F.lit("(나)"))).cast(f"array<struct<number:int,contents:array<{BLOCK}>>>"))
    shown = F.array_join(F.transform(F.col("c.choices")[0]["contents"], lambda b: F.concat(b["type"], F.lit(":"), b["value"])), "|")
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", got.alias("c")).select("p_partkey", F.array_join("c.heads", ",").alias("heads"), shown.alias("first_choice"))


@query("""WITH p AS (SELECT conv_id, turn, text, CASE WHEN (turn + conv_id) % 4 = 1 THEN turn END AS number FROM conversations), c AS (SELECT *, last_value(number IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM p)
SELECT conv_id, coalesce(q, turn) // 3 AS page, coalesce(q, turn) % 3 AS place, q::INT AS number, count(*) AS pieces, md5(string_agg(text, '|' ORDER BY turn)) AS texts FROM c GROUP BY conv_id, q, coalesce(q, turn)""")
def pages_stitched(spark, d):
    """Questions that run over pages' ends: pieces without a number go on with the question before."""
    t = F.col("turn")
    number = F.when((t + F.col("conv_id")) % 4 == 1, t.cast("int"))
    parts = table(spark, d, "conversations").select("conv_id", F.floor(t / 3).alias("page"), (t % 3).alias("place"), number.alias("number"), F.array("text").alias("contents"))
    return assembly.stitched(parts, "conv_id").select("conv_id", "page", "place", "number", F.size("contents").cast("long").alias("pieces"), F.md5(F.array_join("contents", "|")).alias("texts"))


@query("SELECT doc_id // 10 AS document, arg_min(source, doc_id % 10) FILTER (lang = 'en' AND doc_id % 10 > 2) AS title FROM documents GROUP BY 1")
def document_titles(spark, d):
    pages = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("document"), (F.col("doc_id") % 10).alias("page"), F.when((F.col("lang") == "en") & (F.col("doc_id") % 10 > 2), F.concat(F.lit("　 "), "source")).otherwise(" ").alias("header"))
    return assembly.titles(pages, "document")


@query(r"""WITH e AS (SELECT conv_id, turn, text, turn % 3 <> 2 AS essay, CASE WHEN conv_id % 3 = 0 THEN turn + 1 ELSE turn % 2 + 1 END AS label, CASE WHEN conv_id % 7 = 0 AND turn = 0 THEN NULL ELSE 1 END AS there FROM conversations),
d AS (SELECT conv_id, count(*) FILTER (essay) = count(there) FILTER (essay) AND count(DISTINCT label) FILTER (essay) < count(*) FILTER (essay) AS anew FROM e GROUP BY 1)
SELECT conv_id, turn, CASE WHEN there IS NULL THEN '' ELSE '[서술형 ' || CASE WHEN essay AND anew THEN row_number() OVER (PARTITION BY conv_id, essay ORDER BY turn) ELSE label END || '] ' END || md5(text) AS first_text FROM e JOIN d USING (conv_id)""")
def essays_unified(spark, d):
    """All kinds of essay under one word; labels that clash are numbered anew where all essays of a document have one."""
    t, c = F.col("turn"), F.col("conv_id")
    kind = F.element_at(F.array(*map(F.lit, assembly.ESSAYS)), (1 + t % 3).cast("int"))
    label = F.when((c % 7 == 0) & (t == 0), "").otherwise(F.concat(F.lit("["), kind, F.lit(" "), F.when(c % 3 == 0, t + 1).otherwise(t % 2 + 1), F.lit("] ")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.floor(t / 3).alias("page"), (t % 3).alias("place"), F.array(F.concat(label, F.md5("text"))).alias("contents"))
    return assembly.essays_unified(rows, "conv_id", t % 3 != 2).select("conv_id", "turn", F.col("contents")[0].alias("first_text"))


@query(r"""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS line, l_partkey AS p, l_suppkey AS s, ['점', '확률', '행렬', '번호'][1 + l_partkey % 4] AS word, chr(65 + (l_suppkey % 20)::INT) AS a FROM lineitem)
SELECT line, word || ' |' || CASE word WHEN '점' THEN '\mathrm{' || a || '}|\mathrm{' || a || '}\mathit{(' || p || ', ' || s || ')}|\mathrm{' || a || 'Z}' WHEN '행렬' THEN a || '|' || a || '(' || p || ', ' || s || ')|\mathit{' || a || 'Z}' ELSE a || '|' || a || '(' || p || ', ' || s || ')|\mathrm{' || a || 'Z}' END
 || '|\mathrm{E}_' || p || '+' || CASE WHEN word = '점' THEN '\mathrm{E}' ELSE 'E' END AS shown FROM t""")
def letters_styled(spark, d):
    """Names of points, letters of probability, matrices: upright or slanted by what the question is about; scores go, whole or cut in two."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    word = F.element_at(F.array(*map(F.lit, ("점", "확률", "행렬", "번호"))), (1 + p % 4).cast("int"))
    a = F.char(65 + s % 20)
    scores = F.when(s % 2 == 0, F.concat(F.lit("["), p % 10, F.lit("점]"))).otherwise("")
    blocks = F.array(
        a_block("text", F.concat(word, F.lit(" "), scores)), a_block("equation", a), a_block("equation", F.concat(a, F.lit("("), p, F.lit(", "), s, F.lit(")"))), a_block("equation", F.concat(a, F.lit("Z"))),
        a_block("text", F.lit(" [총 ")), a_block("equation", (p % 10).cast("string")), a_block("text", F.lit("점]")), a_block("equation", F.concat(F.lit(r"\mathrm{E}_"), p, F.lit(r"+\mathrm{E}"))),
    )
    rows = spread(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), styles.letters_styled(blocks).alias("b"))
    return rows.select("line", F.array_join(F.transform("b", lambda b: b["value"]), "|").alias("shown"))
