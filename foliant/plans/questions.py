"""Queries over questions as nested structs, built from conversations: one a document, its turns as questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import blocks as bl
from foliant.functions import questions as qs
from foliant.functions import text as tx
from foliant.operators import audit, scoring
from foliant.operators import evaluation as ev
from foliant.plans.evaluation import LETTERS
from foliant.plans.registry import query, table
from foliant.sources.readers import BLOCK, PART, QUESTION


def block(kind: str, value: Column | None = None, rows: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("type"), (none if value is None else value).alias("value"), (none if rows is None else rows).alias("rows"), *[none.alias(n) for n in ("bbox", "page", "bold", "underline", "box_member")]).cast(BLOCK)


def question(**fields: Column) -> Column:
    names = ["number", "type", "label", "label_type", "score", "contents", "choices", "sub_questions", "subquestions", "answer", "solution", "topic", "difficulty"]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(QUESTION)


#: Texts of sixty letters that no other turn has: how much of one is left can be told in SQL. Of its candidate as many tens are cut off as the conversation's remainder by 6 says.
LONG, CUT = 60, 10


def golden(spark, d) -> DataFrame:
    """sample_id, questions: each turn with a text, an equation, and as many choices as its number's remainder by 5 says; the first choice holds a table or figure."""
    t, c = F.col("turn"), F.col("conv_id")
    text = F.when(t % 7 == 6, "").otherwise(F.substring(F.lit(LETTERS), (t * LONG + 1).cast("int"), F.lit(LONG)))
    first = F.when(t % 5 == 3, F.array(block("table", None, F.array(F.array(c.cast("string"), t.cast("string")), F.array(F.lit("x")))))).when(t % 5 == 4, F.array(block("figure", F.lit("")))).otherwise(F.array(block("text", F.lit(""))))
    choices = F.transform(F.sequence(F.lit(0), t % 5), lambda i: F.struct((i + 1).cast("int").alias("number"), F.when(i == 0, first).otherwise(F.array(block("text", F.lit("")))).alias("contents")))
    contents = F.array(block("text", text), block("equation", F.when(t % 7 == 6, "").otherwise(F.concat(F.lit("x^{"), t.cast("string"), F.lit("}")))))
    q = question(number=(t + 1).cast("int"), type=F.lit("mcq"), score=(t % 4).cast("string"), contents=contents, choices=choices, answer=F.lit("①"))
    return table(spark, d, "conversations").groupBy(c.alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct(t.cast("int").alias("t"), q.alias("q")))).alias("x")).select("sample_id", F.transform("x", lambda x: x["q"]).alias("questions"))


def candidate(gold: DataFrame) -> DataFrame:
    """The same, damaged: every seventh question gone, some choices, numbers, scores, texts, equations and tables changed."""
    s = F.col("sample_id")

    def damaged(q: Column) -> Column:
        t = q["number"] - 1
        keep = F.when((s % 2 == 0) & (t % 5 == 2), F.slice(q["choices"], 1, 1)).otherwise(q["choices"])
        rows = lambda b: F.transform(b["rows"], lambda r: F.when(F.size(r) == 2, F.array(F.get(r, F.lit(0)), F.lit("0"))).otherwise(r))
        cell = lambda b: F.when((b["type"] == "table") & (s % 4 == 1), block("text", F.lit(""))).when(b["type"] == "table", b.withField("rows", rows(b))).otherwise(b)
        short = lambda b: b.withField("value", F.substring(b["value"], F.lit(1), (LONG - CUT * (s % 6)).cast("int")))
        empty = lambda b: F.when(b["type"] == "text", short(b)).when((b["type"] == "equation") & (s % 7 == 0), b.withField("value", F.lit(""))).otherwise(b)
        new = q.withField("choices", F.transform(keep, lambda c: c.withField("contents", F.transform(c["contents"], cell)))).withField("contents", F.transform(q["contents"], empty))
        return new.withField("number", F.when((s % 5 == 0) & (t == 0), F.lit(None)).otherwise(q["number"])).withField("score", F.when(s % 3 == 0, "9").otherwise(q["score"]))

    return gold.select("sample_id", F.transform(F.filter("questions", lambda q: (q["number"] - 1) % 7 != 6), damaged).alias("questions"))


CROPS = """WITH q AS (SELECT conv_id, turn, turn % 7 = 6 AS gone, turn % 5 + 1 AS gc, CASE WHEN conv_id % 2 = 0 AND turn % 5 = 2 THEN 1 ELSE turn % 5 + 1 END AS cc FROM conversations),
s AS (SELECT conv_id AS sample_id, count(*) AS ng, count(*) FILTER (NOT gone) AS nc, avg(least(gc, cc) / greatest(gc, cc)) FILTER (NOT gone) AS choice_count_score, avg((NOT (conv_id % 5 = 0 AND turn = 0))::INT) FILTER (NOT gone) AS number_score,
 CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END::DOUBLE AS score_score, count(*) FILTER (turn % 5 = 3) AS gt, CASE WHEN conv_id % 4 = 1 THEN 0 ELSE count(*) FILTER (turn % 5 = 3 AND NOT gone) END AS ct, count(*) FILTER (turn % 5 = 4) AS gf, count(*) FILTER (turn % 5 = 4 AND NOT gone) AS cf,
 2.0::DOUBLE * (60 - 10 * (conv_id % 6)) * count(*) FILTER (turn % 7 <> 6 AND NOT gone) / (60 * count(*) FILTER (turn % 7 <> 6) + (60 - 10 * (conv_id % 6)) * count(*) FILTER (turn % 7 <> 6 AND NOT gone)) AS text_ratio, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE 1 END::DOUBLE AS equation_ratio FROM q GROUP BY conv_id),
r AS (SELECT *, least(ng, nc) / greatest(ng, nc) AS question_count_score, CASE WHEN gt = 0 AND ct = 0 THEN 1.0 ELSE 2.0 * least(gt, ct) / (gt + ct) END AS table_presence_f1, CASE WHEN gf = 0 AND cf = 0 THEN 1.0 ELSE 2.0 * least(gf, cf) / (gf + cf) END AS figure_presence_f1,
 CASE WHEN gt = 0 THEN NULL WHEN ct = 0 THEN 0 ELSE 2 / 3 END::DOUBLE AS table_cell_acc, array_to_string(list_filter([CASE WHEN ng <> nc THEN 'QUESTION_COUNT' END, CASE WHEN choice_count_score < 1 THEN 'CHOICE_COUNT' END, CASE WHEN number_score < 1 THEN 'NUMBER_MISMATCH' END,
 CASE WHEN equation_ratio < 1 THEN 'EQUATION_DRIFT' END, CASE WHEN sample_id % 6 = 5 THEN 'BOX_PROSE_DROP' END, CASE WHEN gt > 0 AND ct = 0 THEN 'TABLE_MISSING' END], lambda x: x IS NOT NULL), ';') AS regressions FROM s),
c AS (SELECT sample_id, round((question_count_score + choice_count_score + 1 + number_score + score_score + table_presence_f1 + figure_presence_f1) / 7, 6) AS struct_score, round(question_count_score, 6) AS question_count_score, round(choice_count_score, 6) AS choice_count_score, 1::DOUBLE AS content_type_score,
 round(number_score, 6) AS number_score, score_score, round(table_presence_f1, 6) AS table_presence_f1, round(figure_presence_f1, 6) AS figure_presence_f1, round(text_ratio, 6) AS text_ratio, equation_ratio, round(table_cell_acc, 6) AS table_cell_acc, regressions FROM r)"""


def crops(spark, d) -> DataFrame:
    gold = golden(spark, d)
    return scoring.score_crops(candidate(gold), gold)


@query(CROPS + " SELECT * FROM c")
def score_crop(spark, d):
    got = crops(spark, d)
    return got.select("sample_id", *[F.round(c, 6).alias(c) for c in got.columns if c not in ("sample_id", "regressions")], F.array_join("regressions", ";").alias("regressions"))


@query(CROPS + """ SELECT count(*) AS n_samples, round(avg(text_ratio), 5) AS mean_text_ratio, round(avg(equation_ratio), 5) AS mean_equation_ratio, round(avg(struct_score), 5) AS struct_accuracy, round(avg(table_cell_acc), 5) AS mean_table_cell_acc,
count(*) FILTER (regressions <> '') AS n_regressions, round(avg((regressions <> '')::INT), 5) AS regression_rate FROM c""")
def crop_summary(spark, d):
    got = scoring.aggregated_crops(crops(spark, d))
    return got.select("n_samples", "n_regressions", *[F.round(c, 5).alias(c) for c in got.columns if c not in ("n_samples", "n_regressions")])


@query("SELECT conv_id AS sample_id, turn, CASE WHEN turn % 5 = 3 THEN round(CASE WHEN conv_id % 4 = 1 THEN 0 WHEN turn > 0 THEN 2.0 / 3 ELSE 1 END, 6) END AS accuracy FROM conversations WHERE turn % 7 <> 6")
def table_cells(spark, d):
    """Each question's table alone."""
    gold = golden(spark, d)
    both = gold.select("sample_id", F.explode("questions").alias("g")).join(candidate(gold).select("sample_id", F.posexplode("questions").alias("i", "c")), "sample_id").filter((F.col("g.number") == F.col("c.number")) | (F.col("c.number").isNull() & (F.col("g.number") == 1)))
    rows = lambda q: scoring.largest_table(scoring.blocks(F.col(q)))
    shown = F.when(rows("g").isNotNull(), F.coalesce(scoring.table_accuracy(F.coalesce(rows("c"), F.array().cast("array<array<string>>")), rows("g")), F.lit(0.0)))
    missing = rows("g").isNotNull() & rows("c").isNull()
    return both.select("sample_id", (F.col("g.number") - 1).cast("long").alias("turn"), F.round(F.when(missing, 0.0).otherwise(shown), 6).alias("accuracy"))


def each(spark, d) -> DataFrame:
    """sample_id, turn, q: a question with a text, an equation, a figure and a table, two choices and a part."""
    t, c = F.col("turn"), F.col("conv_id")
    n = t.cast("string")
    contents = F.array(block("text", F.concat(F.lit("stem  "), n)), block("equation", F.concat(F.lit("x^"), n)), block("figure", F.when(t % 2 == 0, F.concat(F.lit("그래프 "), F.when(t % 4 == 0, n).otherwise(""))).otherwise("")), block("table", None, F.array(F.array(n, F.lit("b")), F.array(F.lit("c")))))
    choices = F.array(*[F.struct(F.lit(i).alias("number"), F.array(block("equation", F.concat(F.lit(f"{i}+"), n))).alias("contents")) for i in (1, 2)])
    parts = F.array(F.struct(F.lit(1).alias("number"), F.concat(n, F.lit(".0")).alias("score"), F.array(block("equation", F.lit("y")), block("text", F.lit("part"))).alias("contents")))
    q = question(number=t.cast("int"), type=F.lit("mcq"), contents=contents, choices=choices, sub_questions=parts, answer=F.when(t % 3 == 0, "①").when(t % 3 == 1, "two").otherwise("[보기 오류] $9$"))
    return table(spark, d, "conversations").select(c.alias("sample_id"), t, q.alias("q"))


FIG = "CASE WHEN turn % 2 = 0 THEN '그래프 ' || CASE WHEN turn % 4 = 0 THEN turn::VARCHAR ELSE '' END ELSE '' END"


@query(f"SELECT conv_id AS sample_id, turn, trim('stem  ' || turn || ' $x^' || turn || '$ [그림: ' || {FIG} || ']') AS t FROM conversations")
def flatten_found(spark, d):
    return each(spark, d).select("sample_id", "turn", qs.found_text(F.col("q.contents")).alias("t"))


@query(rf"SELECT conv_id AS sample_id, turn, trim(regexp_replace('stem  ' || turn || ' $x^' || turn || '$ [그림] ' || {FIG} || '  (1) $1+' || turn || '$ (2) $2+' || turn || '$ (1) y part', '\s{{2,}}', ' ', 'g')) AS t FROM conversations")
def flatten_exported(spark, d):
    return each(spark, d).select("sample_id", "turn", qs.exported_text(F.col("q")).alias("t"))


@query(f"SELECT conv_id AS sample_id, turn, 'stem  ' || turn || ' $x^' || turn || '$ [그림] ' || {FIG} || ' ' || turn || ' | b / c 1 $1+' || turn || '$ 2 $2+' || turn || '$ (1) $y$ part' AS t FROM conversations")
def flatten_search(spark, d):
    return each(spark, d).select("sample_id", "turn", qs.search_text(F.col("q")).alias("t"))


@query("SELECT conv_id AS sample_id, turn, substring('stem  ' || turn || ' $x^' || turn || '$ [그림] ', 1, 110) AS t, true AS figure FROM conversations")
def flatten_shown(spark, d):
    return each(spark, d).select("sample_id", "turn", F.substring(qs.shown_text(F.col("q")), 1, 110).alias("t"), qs.has_figure(F.col("q")).alias("figure"))


@query(f"SELECT conv_id AS sample_id, turn, 'stem  ' || turn || ' x^' || turn || ' [그림] ' || {FIG} || ' [표] ' || turn || ' | b / c' AS stem, '1+' || turn || ';2+' || turn AS choices, 'y part' AS parts FROM conversations")
def worksheet_rows(spark, d):
    w = each(spark, d).select("sample_id", "turn", qs.worksheet(F.col("q")).alias("w"))
    return w.select("sample_id", "turn", "w.stem", F.array_join(F.transform("w.choices", lambda c: c["text"]), ";").alias("choices"), F.array_join(F.transform("w.sub_questions", lambda s: s["text"]), ";").alias("parts"))


@query(rf"""SELECT conv_id AS sample_id, turn, 'stem  ' || turn || '$x^' || turn || '$' || chr(10) || '[그림' || CASE WHEN turn % 2 = 0 THEN ': ' || trim({FIG}) ELSE '' END || ']' || chr(10) || chr(10) || '| ' || turn || ' | b |' || chr(10) || '| c |' || chr(10) || chr(10) || '(1) $y$part'
|| CASE WHEN turn > 0 THEN ' [' || turn || '점]' ELSE '' END || chr(10) || chr(10) || '① $1+' || turn || '$' || chr(10) || '② $2+' || turn || '$' AS t FROM conversations""")
def prompt_text(spark, d):
    return each(spark, d).select("sample_id", "turn", qs.prompt_text(F.col("q")).alias("t"))


@query("SELECT conv_id AS sample_id, turn, CASE WHEN turn % 3 = 1 THEN 'WARN:figure without a box;FAIL:answer of a choice' ELSE 'WARN:figure without a box' END AS rules FROM conversations")
def question_lint(spark, d):
    return each(spark, d).select("sample_id", "turn", F.array_join(F.transform(qs.lint(F.col("q")), lambda r: F.concat_ws(":", r["level"], r["rule"])), ";").alias("rules"))


@query("SELECT conv_id AS sample_id, turn, CASE WHEN turn % 2 = 1 THEN '<empty>:empty' WHEN turn % 4 = 2 THEN '그래프:paraphrase' ELSE '그래프 ' || turn || ':beside a box' END AS risks FROM conversations")
def figure_risks(spark, d):
    return each(spark, d).select("sample_id", "turn", F.array_join(F.transform(qs.figure_risks(F.col("q")), lambda r: F.concat_ws(":", r["token"], r["reason"])), ";").alias("risks"))


@query("""SELECT category, severity, block_type, count(*) AS n FROM (SELECT 'EXPONENT' AS category, 'medium' AS severity, 'equation' AS block_type FROM conversations UNION ALL SELECT 'FIGURE_HANDWRITING', 'medium', 'figure' FROM conversations) GROUP BY ALL""")
def risk_audit(spark, d):
    """One output's risks without a golden record, over all documents."""
    flat = each(spark, d).select(F.explode(qs.flags(F.col("q"))).alias("f")).select("f.*")
    return flat.groupBy("category", "severity", "block_type").agg(F.count("*").alias("n"))


@query("""SELECT conv_id AS exam_id, turn::INT AS number, CASE turn % 4 WHEN 0 THEN 'choices' WHEN 1 THEN 'empty stem' WHEN 2 THEN 'choices;unbalanced markup' ELSE 'choices without MCQ;unreadable' END AS findings FROM conversations""")
def question_findings(spark, d):
    t = F.col("turn")
    two = F.array(*[F.struct(F.lit(i).alias("number"), F.array(block("text", F.lit("c"))).alias("contents")) for i in (1, 2)])
    none = F.array().cast(f"array<struct<number:int,contents:array<{BLOCK}>>>")
    q = question(number=t.cast("int"), type=F.when(t % 2 == 0, "mcq").otherwise("essay"), contents=F.array(block("text", F.when(t % 4 == 1, " ").when(t % 4 == 2, "{a").when(t % 4 == 3, "�").otherwise("a"))), choices=F.when(t % 4 == 1, none).otherwise(two), answer=F.lit("①"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("exam_id"), q.alias("q")).select("exam_id", "q.*")
    return audit.question_findings(rows).select("exam_id", "number", F.array_join("findings", ";").alias("findings"))


@query("SELECT conv_id AS sample_id, conv_id % 3 = 0 AS spellings FROM conversations GROUP BY 1")
def label_spellings(spark, d):
    t, c = F.col("turn"), F.col("conv_id")
    label = F.when((t == 0) & (c % 3 == 0), "[서술형 1] 풀이").when(c % 3 < 2, "[서답형 2]").otherwise("[단답형 3]")
    both = F.array(question(contents=F.array(block("text", label))), question(contents=F.array(block("text", F.when(c % 3 == 0, "[서답형]").otherwise("x")))))
    one = table(spark, d, "conversations").filter("turn = 0").select(c.alias("sample_id"), qs.two_spellings(both).alias("spellings"))
    return one


@query("""SELECT conv_id AS sample_id, turn, 3 - (turn % 2 = 1)::INT AS boxes, CASE WHEN turn % 2 = 0 THEN '1,2' ELSE '' END AS rows FROM conversations""")
def blocks_adapted(spark, d):
    """Unknown types go, a table spelled in its value gets rows, a box whose Hangul stands elsewhere goes."""
    t = F.col("turn")
    double = block("text", F.when(t % 2 == 1, "<보기> 다음 중에서 옳은 것을 모두 고르시오").otherwise("<보기> 짧다"))
    blocks = F.array(block("text", F.lit("문제: 다음 중에서 옳은 것을 모두 고르시오 [3점]")), double, block("table", F.when(t % 2 == 0, '[["1","2"]]')), block("unknown", F.lit("x")))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", blocks.alias("b")).withColumn("b", qs.adapted_blocks(F.col("b"))).withColumn("c", bl.without_duplicate_boxes(F.col("b")))
    found = F.coalesce(F.flatten(F.flatten(F.transform(F.filter("c", lambda b: b["rows"].isNotNull()), lambda b: b["rows"]).cast("array<array<array<string>>>"))), F.array().cast("array<string>"))
    return rows.select("sample_id", "turn", F.size("c").alias("boxes"), F.array_join(found, ",").alias("rows"))


@query("SELECT doc_id, regexp_replace(lang || CASE doc_id % 3 WHEN 0 THEN '÷' WHEN 1 THEN '≤' ELSE '≥' END || source, '[\\s{}$\\\\_^]', '', 'g') AS t FROM documents")
def norm_symbols(spark, d):
    sign = F.when(F.col("doc_id") % 3 == 0, r" \div ").when(F.col("doc_id") % 3 == 1, r" \leq ").otherwise(r"\ge{}")
    return table(spark, d, "documents").select("doc_id", tx.norm_symbols(F.concat(F.lit("$"), "lang", sign, "source", F.lit("$"))).alias("t"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ' rest ' || doc_id END AS t, '가나다' AS key FROM documents")
def prefix_cut(spark, d):
    x = F.concat(F.lit("(1) 가 나, "), F.when(F.col("doc_id") % 2 == 0, "다").otherwise("라"), F.lit(" rest "), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", tx.without_lead(x, F.lit("가나다")).alias("t"), tx.hangul_key(F.lit("가 1나_다.")).alias("key"))


@query("SELECT doc_id, 'aa bb;' || lang || ' 가;나다라' AS lines FROM documents")
def wrapped_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.wrapped(F.concat(F.lit("aa bb "), "lang", F.lit(" 가 나다라")), 6), ";").alias("lines"))


@query("SELECT doc_id, 'find it ' || lang AS t, [(doc_id % 9 + 0.5)::DOUBLE, 3.0]::VARCHAR AS scores FROM documents")
def scores_cut(spark, d):
    x = F.concat(F.lit("find it ["), (F.col("doc_id") % 9 + 0.5).cast("string"), F.lit("점] "), "lang", F.lit(" (총 3점)"))
    return table(spark, d, "documents").select("doc_id", tx.without_scores(x).alias("t"), F.concat(F.lit("["), F.array_join(F.transform(tx.printed_scores(x), lambda s: s.cast("string")), ", "), F.lit("]")).alias("scores"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '\frac' ELSE lang END AS answer, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 'because' END AS solution, CASE WHEN doc_id % 3 = 0 THEN source END AS topic FROM documents")
def answer_sections(spark, d):
    i = F.col("doc_id") % 3
    fenced = F.concat(F.lit("```\n###ANSWER###\n"), "lang", F.lit("\n### solution ###\nbecause\n###TOPIC###"), "source", F.lit("###END###\n```"))
    json = F.concat(F.lit('so: {"answer": "'), "lang", F.lit('", "solution": "because"}'))
    s = tx.sections(F.when(i == 0, fenced).when(i == 1, json).otherwise(F.lit('{"answer": "\\frac"}')))
    return table(spark, d, "documents").select("doc_id", s["answer"].alias("answer"), s["solution"].alias("solution"), s["topic"].alias("topic"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'HOL_JJAK' WHEN 1 THEN 'DECIMAL' WHEN 2 THEN 'CONFIDENCE_INTERVAL' WHEN 3 THEN 'INEQUALITY' WHEN 4 THEN 'EXPONENT' ELSE CASE WHEN lang <> 'en' THEN 'NUMBER' END END AS category FROM documents")
def mismatches(spark, d):
    pick = lambda *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.col("doc_id") % 6 + 1).cast("int"))
    g, c = pick("홀수 1", "1.25", "±1", "a<1", "x^{2}", "12"), pick("짝수 2", "1.2", "1", "a>1", "x^3", F.when(F.col("lang") == "en", "12").otherwise("13"))
    return table(spark, d, "documents").select("doc_id", tx.mismatch(g, c).alias("category"))


@query("SELECT doc_id AS sample_id, CASE WHEN doc_id % 2 = 0 THEN 'NUMBER' ELSE 'HOL_JJAK' END AS category, CASE WHEN doc_id % 2 = 0 THEN 'is 5' ELSE '은 홀수다' END AS golden, CASE WHEN doc_id % 2 = 0 THEN 'is 7' ELSE '은 짝수다' END AS candidate FROM documents")
def mined_failures(spark, d):
    even = F.col("doc_id") % 2 == 0
    p = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.when(even, "it is 5").otherwise("은 홀수다").alias("g_text"), F.when(even, "it is 7").otherwise("은 짝수다").alias("c_text"))
    return ev.mined(p, 3).select("sample_id", "category", "golden", "candidate")


def shown(blocks: Column) -> Column:
    mark = lambda b: F.concat(F.when(F.coalesce(b["bold"], F.lit(False)), "!").otherwise(""), F.substring(b["type"], 1, 1), F.lit(":"), tx.text_of(b["value"]))
    return F.array_join(F.transform(blocks, mark), "|")


@query("""SELECT conv_id AS sample_id, turn, CASE turn % 4 WHEN 0 THEN 't:다음 그래프를 보고 답하시오 ' || turn || '|i:|t:<보기>|t:ㄱ. 하나' WHEN 1 THEN 't:고른 것은? 답하시오|t:<보기> ㄱ. ' || turn || ' (가)' WHEN 2 THEN 't:본문|t:나머지 ' || turn ELSE 't:자연수의 꼴로 나타낸 후 답하시오' END AS t FROM conversations""")
def block_boxes(spark, d):
    """Boxes that vision made up or that stand in a text, and a figure out of place."""
    t = F.col("turn")
    n = t.cast("string")
    text = lambda v: block("text", v if isinstance(v, Column) else F.lit(v))
    moved = F.array(text(F.concat(F.lit("다음 그래프를 보고 답하시오 "), n)), text("<보기>"), text("ㄱ. 하나"), block("image", F.lit("")))
    inside = F.array(text(F.concat(F.lit("고른 것은? 답하시오  <보기> ㄱ. "), n, F.lit(" (가)"))))
    repeated = F.array(text("본문"), text("<상자> 다음 물음에 모두 바르게 답하시오"), text(F.concat(F.lit("<상자> 다음 물음에 모두 바르게 답하시오. 나머지 "), n)))
    double = F.array(text("자연수의 꼴로 나타낸 후 답하시오"), text("<상자> 의 꼴로 나타낸 후 답"))
    part = F.array(F.struct(F.lit(1).alias("number"), F.lit(None).alias("score"), F.array(text("다음 물음에 모두 바르게 답하시오")).alias("contents")).cast(PART))
    b = F.when(t % 4 == 0, moved).when(t % 4 == 1, inside).when(t % 4 == 2, repeated).otherwise(double)
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", b.alias("b"), part.alias("parts"))
    for step in (bl.without_duplicate_boxes, lambda x: bl.without_repeated_parts(x, F.col("parts")), bl.split_at_boxes, bl.figure_before_box):
        rows = rows.withColumn("b", step(F.col("b")))
    return rows.select("sample_id", "turn", shown(F.col("b")).alias("t"))


@query("""SELECT conv_id AS sample_id, turn, 't:확률을 |e:p_' || turn || '|t:, |t:제|e:' || turn || '|t:은? (단 |t:값은? |t:(가) 옳지 |!t:않은|t: 것' AS t FROM conversations""")
def block_spacing(spark, d):
    """Commas, spaces and emphasis around equations and questions."""
    n = F.col("turn").cast("string")
    text = lambda v: block("text", F.lit(v))
    b = F.array(text("확률을"), block("equation", F.concat(F.lit("p_"), n)), text(" , "), text("제"), block("equation", n), text("은?(단 "), text("값은?"), text("(가) 옳지 않은 것  "))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", b.alias("b"))
    for step in (bl.spaced_before_equations, bl.spaced_after_questions, bl.commas_tightened, bl.negations_emphasised, bl.right_stripped):
        rows = rows.withColumn("b", step(F.col("b")))
    return rows.select("sample_id", "turn", shown(F.col("b")).alias("t"))


@query("SELECT conv_id AS sample_id, turn, CASE turn % 3 WHEN 0 THEN '(가) a ' || turn || ' • (나) b • (다) c' WHEN 1 THEN 'ㄱ. a • ㄴ. b • ㄷ. ' || turn ELSE 'text • ① a • more' END AS t FROM conversations")
def box_items(spark, d):
    t = F.col("turn")
    n = t.cast("string")
    rows = F.when(t % 3 == 0, F.array(F.concat(F.lit("(가)  a "), n, F.lit(" (다) c")), F.lit("( 나 ) b"))).when(t % 3 == 1, F.array(F.lit("ㄴ. b"), F.concat(F.lit("ㄷ. "), n), F.lit("ㄱ. a"))).otherwise(F.array(F.lit("text ① a"), F.lit(" "), F.lit("more")))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", F.regexp_replace(bl.box_text(rows), r"\( 나 \)", "(나)").alias("t"))
