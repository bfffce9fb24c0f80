"""Queries of parsers and canonical forms: file names, repaired JSON, equations, equivalent answers, gates, windows of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import answers, equations, jsonfix, names
from foliant.operators import audit
from foliant.plans.registry import query, spread, table
from foliant.streaming.incremental import windowed


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS f, 1 + o_custkey % 3 AS g, 20 + o_custkey % 6 AS y, 1 + o_orderkey % 2 AS s FROM orders)
SELECT o_orderkey, CASE f WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS fmt, CASE f WHEN 0 THEN '가람' || g || '고' WHEN 1 THEN '나래여고' ELSE '다솜여고' END AS school, g::INT AS grade, '고' AS level,
CASE f WHEN 0 THEN '수1' WHEN 1 THEN '수상' ELSE '수하' END AS subject, (2000 + y)::INT AS year, s::INT AS semester, CASE WHEN f = 2 THEN '기말' ELSE '중간' END AS round, CASE f WHEN 0 THEN '완료' END AS status FROM o""")
def file_names(spark, d):
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").selectExpr("o_orderkey", "o_orderkey % 3 as f", "1 + o_custkey % 3 as g", "20 + o_custkey % 6 as y", "1 + o_orderkey % 2 as s")
    a = F.format_string("/d/[가람%d고][%d][수학1][%d-%d-중간](완료).pdf", "g", "g", "y", "s")
    b = F.format_string("/d/[%d][고%d][%d학기중간][수학상][나래여고].hwp", "y", "g", "s")
    c = F.format_string("/d/다솜여자고등학교_%d학년_20%d_%d학기기말_수학하_공통.pdf", "g", "y", "s")
    paths = o.select("o_orderkey", F.when(F.col("f") == 0, a).when(F.col("f") == 1, b).otherwise(c).alias("path"))
    return names.valid(names.parsed(paths)).select("o_orderkey", "fmt", "school", "grade", "level", "subject", "year", "semester", "round", "status")


@query("SELECT event_id, len(json_keys(props)) AS keys FROM events")
def json_repair(spark, d):
    broken = F.when(F.col("event_id") % 2 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.concat(F.lit("```json\n"), F.expr("left(props, length(props) - 1)"), F.lit(",}\n```")))
    fixed = jsonfix.json_object(broken)
    return table(spark, d, "events").select("event_id", F.size(F.json_object_keys(fixed)).cast("long").alias("keys"))


@query("SELECT o_orderkey, '{' || o_custkey || '} over {x^{2} TIMES ' || o_orderkey || '}' AS script, false AS leaks FROM orders")
def equation_scripts(spark, d):
    latex = F.concat(F.lit(r"\dfrac{"), "o_custkey", F.lit(r"}{x^{2} \times "), "o_orderkey", F.lit("}"))
    script = equations.to_script(latex)
    return spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", script.alias("script"), equations.leaks(script).alias("leaks"))


@query(r"SELECT o_orderkey, 'if $\frac{' || o_custkey || '}{\sqrt{' || o_orderkey || '}}$ holds' AS latex FROM orders")
def equation_latex(spark, d):
    text = F.concat(F.lit("if ${"), "o_custkey", F.lit("} over {sqrt {"), "o_orderkey", F.lit("}}$ holds"))
    return spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", equations.inline_to_latex(text).alias("latex"))


NESTED = "SELECT o_orderkey, o_custkey, 1 + o_orderkey % 30 AS n FROM orders"


@query(rf"""SELECT o_orderkey, repeat('\frac{{' || o_custkey || '}}{{', n) || '\sqrt{{x_{{' || o_orderkey || '}}}}' || repeat('}}', n) || ' \leq \frac{{x^{{2}}}}{{' || n || '}}' AS latex,
 repeat('{{' || o_custkey || '}} over {{', n) || 'sqrt {{x_{{' || o_orderkey || '}}}}' || repeat('}}', n) || ' LEQ {{x^{{2}}}} over {{' || n || '}}' AS script FROM ({NESTED})""")
def equation_depth(spark, d):
    """Scripts nested up to thirty deep, operands without braces, to LaTeX; and that back to a script."""
    n = (1 + F.col("o_orderkey") % 30).cast("int")
    script = F.concat(F.repeat(F.concat("o_custkey", F.lit(" over {")), n), F.lit("sqrt {x_"), "o_orderkey", F.lit("}"), F.repeat(F.lit("}"), n), F.lit(" LEQ x^2 over "), n)
    latex = equations.to_latex(script)
    return spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", latex.alias("latex"), equations.to_script(latex).alias("script"))


@query(r"""SELECT p_partkey, 'rm ' || l || ' it (A CAP ' || b || '^{C})= LEFT ( {' || p_size || '} over {' || p_partkey || '} RIGHT )^{' || p_size || '}' AS script, l || '(x+' || p_size || ')^{c}' AS plain
FROM (SELECT p_partkey, p_size, substr('PEV', 1 + (p_partkey % 3)::INT, 1) AS l, chr(65 + (p_size % 26)::INT) AS b FROM part)""")
def equation_events(spark, d):
    """Probability, mean and variance upright, complements in capitals, brackets as tall as what they hold; other letters as they are."""
    letter, event = F.expr("substr('PEV', 1 + p_partkey % 3, 1)"), F.char(65 + F.col("p_size") % 26)
    latex = F.concat(letter, F.lit(r"(A \cap "), event, F.lit(r"^c)=(\frac{"), "p_size", F.lit("}{"), "p_partkey", F.lit("})^{"), "p_size", F.lit("}"))
    plain = F.concat(letter, F.lit("(x+"), "p_size", F.lit(")^c"))
    return table(spark, d, "part").select("p_partkey", equations.to_script(latex).alias("script"), equations.to_script(plain).alias("plain"))


@query("SELECT doc_id, quality = toxic AS same FROM labels")
def same_answers(spark, d):
    a = F.concat(F.lit(r"$x^{"), F.col("quality").cast("string"), F.lit(r"}(b)(a) \ge 5$"))
    b = F.concat(F.lit("x^"), F.col("toxic").cast("string"), F.lit(r"(a)(b)\geq5"))
    return table(spark, d, "labels").select("doc_id", answers.same_answer(a, b).alias("same"))


@query("SELECT doc_id, CASE WHEN quality = 0 OR toxic = 0 THEN 'medium' ELSE 'high' END AS worst FROM labels")
def worst_confidences(spark, d):
    c = lambda x: F.when(F.col(x) == 1, "high")
    return table(spark, d, "labels").select("doc_id", answers.worst_confidence(c("quality"), c("toxic")).alias("worst"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 3 AND l_linenumber = 1 THEN 4 ELSE 5 END AS choices, l_orderkey % 7 = 2 AND l_linenumber = 2 AS glyphs, CASE WHEN l_orderkey % 7 = 4 AND l_linenumber = 1 THEN 3.5 ELSE 3 END AS score FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS dist, min(l_linenumber) AS low, max(l_linenumber) AS high, bool_or(glyphs) AS glyphs, bool_or(choices <> 5) AS short, sum(score) <> 3 * count(*) AS differs FROM q GROUP BY 1)
SELECT l_orderkey AS exam_id, CASE WHEN n < 3 THEN 'few questions' WHEN low <> 1 OR high <> n OR dist <> n THEN 'numbering' WHEN glyphs THEN 'unresolved glyphs' WHEN short THEN 'choices' WHEN differs THEN 'scores' END AS reason FROM g""")
def extraction_gate(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    q = table(spark, d, "lineitem").select(
        k.alias("exam_id"), n.alias("number"), F.when((k % 7 == 3) & (n == 1), 4).otherwise(5).alias("n_choices"), ((k % 7 == 2) & (n == 2)).alias("unresolved"), F.array(F.lit(3.0)).alias("printed"),
        F.when((k % 7 == 4) & (n == 1), 3.5).otherwise(3.0).alias("score"),
    )
    return audit.gate(q, least=3)


@query("""SELECT time_bucket(INTERVAL '1 hour', ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_events(spark, d):
    got = windowed(table(spark, d, "events"), "ts", "event_type", "1 hour")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT o_orderkey, 'f(' || o_custkey || '=1) # &=abc # &=' || o_orderkey || '00' AS folded FROM orders")
def equation_folded(spark, d):
    script = F.concat(F.lit("f("), "o_custkey", F.lit("=1)=abc="), "o_orderkey", F.lit("00"))
    return table(spark, d, "orders").select("o_orderkey", equations.folded(script).alias("folded"))


@query(r"SELECT o_orderkey, '\overline{AB} \leq \binom{' || o_custkey || '}{\vec{a}} \rightarrow 3^{' || o_orderkey || '}' AS latex, '~' || o_orderkey AS stamp FROM orders")
def equation_roundtrip(spark, d):
    """To a script and back; a stamp put on and taken off."""
    latex = F.concat(F.lit(r"\overline{AB} ≤ \binom{"), "o_custkey", F.lit(r"}{\vec{a}} \to 3^{"), "o_orderkey", F.lit("}"))
    key = F.concat(F.lit("~"), F.col("o_orderkey").cast("string"))
    back = F.regexp_replace(equations.to_latex(equations.to_script(latex)), r" ?\{ ?", "{")
    return table(spark, d, "orders").select("o_orderkey", back.alias("latex"), equations.unstamped(equations.stamped(key, "#!"), "#!").alias("stamp"))
