"""Queries of column functions and of operators over small groups, on inputs made from the tables' values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import exams, names
from foliant.functions import text as tx
from foliant.operators import dedup, merge, ordered, relational
from foliant.operators import evaluation as ev
from foliant.plans.registry import query, table


def picked(key: Column, *values: str | Column | None) -> Column:
    """One of some values by a key's remainder."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def docs(spark, d, **columns: Column):
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


def i() -> Column:
    return F.col("doc_id")


# Filters and predicates


@query("SELECT doc_id FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'fr') AND doc_id % 7 <> 0")
def not_listed(spark, d):
    """A null is in no list and out of none; duplicates are left out."""
    r = table(spark, d, "documents").withColumn("duplicate_of", F.when(i() % 7 == 0, i()))
    return r.filter(F.col("lang").isNotNull() & ~F.col("lang").isin("en", "fr") & F.col("duplicate_of").isNull()).select("doc_id")


@query(rf"""WITH p AS (SELECT doc_id, unnest([text[:300], CASE WHEN doc_id % 2 = 0 THEN lang || repeat(chr(160), 60) || source END, text[301:400]]) AS page FROM documents)
SELECT doc_id, coalesce(sum(length(regexp_replace(page, '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g'))), 0) > 200 AS digital FROM p GROUP BY 1""")
def born_digital(spark, d):
    pages = F.array(F.substring("text", 1, 300), F.when(i() % 2 == 0, F.concat("lang", F.repeat(F.lit("\u00a0"), 60), "source")), F.substring("text", 301, 100), F.substring("text", 401, 10_000))
    return docs(spark, d, digital=exams.born_digital(pages))


@query("""SELECT conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN role = 'user' THEN turn % 3 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), ','), '') AS earlier FROM conversations""")
def earlier_numbers(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("number"), "role")
    got = ordered.earlier_essays(c, "conv_id", "turn", "number", F.col("role") == "user")
    return got.select("conv_id", "turn", F.array_join(F.array_sort("earlier"), ",").alias("earlier"))


# Names and text


@query("""WITH f AS (SELECT s_suppkey, '고' || (1 + s_suppkey % 3) AS grade, 20 + s_suppkey % 7 AS gen, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '기하' END AS subject FROM supplier),
q AS (SELECT c_custkey, '고' || (1 + c_custkey % 3) AS grade, CASE WHEN c_custkey % 2 = 0 THEN '기하' ELSE '대수' END AS subject FROM customer)
SELECT c_custkey, s_suppkey, tier FROM (SELECT q.c_custkey, f.s_suppkey, CASE WHEN f.subject = q.subject AND f.grade = q.grade THEN 0 WHEN f.subject = q.subject THEN 1 WHEN f.grade = q.grade AND f.subject = '' THEN 2 WHEN f.grade = q.grade THEN 3 END AS tier, gen FROM q, f)
WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY tier, gen DESC, s_suppkey) = 1""")
def form_match(spark, d):
    """The form of a subject and grade, else of the subject, else of the grade alone; the newest of equals."""
    f = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("고"), (1 + F.col("s_suppkey") % 3).cast("string")).alias("grade"), (20 + F.col("s_suppkey") % 7).alias("gen"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("기하").alias("subject"))
    q = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("고"), (1 + F.col("c_custkey") % 3).cast("string")).alias("grade"), F.when(F.col("c_custkey") % 2 == 0, "기하").otherwise("대수").alias("subject"))
    newest, any_, own = [-F.col("gen"), F.col("s_suppkey")], F.lit(True), F.col("subject") != ""
    return relational.tiered_match(q, f, "c_custkey", [(["subject", "grade"], own, newest), (["subject"], own, newest), (["grade"], ~own, newest), (["grade"], any_, newest)], ["s_suppkey"])


@query("""WITH v AS (SELECT DISTINCT p_brand AS entry FROM part), q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN lower(p_brand) || ' ' WHEN 2 THEN 'x' || p_brand || 'y' ELSE 'none' END AS name, p_brand FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 THEN (SELECT min(entry) FROM v WHERE contains('x' || q.p_brand || 'y', entry)) ELSE p_brand END AS entry, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_partkey % 4 END AS tier FROM q""")
def vocabulary_lookup(spark, d):
    b = F.col("p_brand")
    q = table(spark, d, "part").select("p_partkey", picked(F.col("p_partkey"), b, F.concat(F.lower(b), F.lit(" ")), F.concat(F.lit("x"), b, F.lit("y")), F.lit("none")).alias("name"))
    return relational.found_in_order(q, table(spark, d, "part").select(b.alias("entry")).distinct(), "p_partkey", "name")


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '\\(?:qquad|quad|thinspace|,|;|:|!| )', '', 'g') || lang, '[{tx.SPACE}]+', '', 'g') AS latex, regexp_replace(text, '[{tx.SPACE}]+', '', 'g') AS space FROM documents""")
def norm_others(spark, d):
    return docs(spark, d, latex=tx.norm_latex(F.concat("text", F.lit(r"\quad \, "), "lang")), space=tx.norm_space(F.col("text")))


# Answers


# Small groups and lists


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN (turn % 2)::VARCHAR ELSE turn::VARCHAR END AS label FROM conversations), g AS (SELECT conv_id, count(label) = count(*) AND count(DISTINCT label) < count(*) AS again FROM c GROUP BY 1)
SELECT conv_id, turn, CASE WHEN again THEN row_number() OVER (PARTITION BY conv_id ORDER BY turn)::VARCHAR ELSE label END AS label FROM c JOIN g USING (conv_id)""")
def labels_renumbered(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, F.col("turn") % 2).otherwise(F.col("turn")).cast("string").alias("label"))
    return ordered.renumbered(c, "conv_id", "turn", "label").select("conv_id", "turn", "label")


@query("SELECT conv_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, -turn)::INT AS place FROM conversations")
def boxes_in_order(spark, d):
    t = F.col("turn")
    b = table(spark, d, "conversations").select("conv_id", t.alias("id"), (10.0 - t).alias("x0"), (F.floor(t / 2) * 100.0 + t).alias("y0"), (11.0 - t).alias("x1"), (F.floor(t / 2) * 100.0 + 50).alias("y1"))
    return ordered.reading_order(b, "conv_id").select("conv_id", "id", "place")


@query("SELECT conv_id, turn AS box FROM conversations WHERE turn % 2 = 0")
def boxes_outer(spark, d):
    t = F.col("turn")
    b = table(spark, d, "conversations").select("conv_id", t.alias("box"), (F.floor(t / 2) * 100.0 + t % 2).alias("x0"), F.lit(0.0).alias("y0"), (F.floor(t / 2) * 100.0 + 50 - t % 2).alias("x1"), (50.0 - t % 2).alias("y1"))
    return ordered.outer_boxes(b, "conv_id").select("conv_id", "box")


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN ' ' ELSE 'x' END AS c, turn % 4 IN (1, 2) AS maths FROM conversations), s AS (SELECT *, CASE WHEN c = ' ' THEN true ELSE maths END AS m2 FROM m),
f AS (SELECT *, (m2 IS DISTINCT FROM lag(m2) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS new FROM s) SELECT conv_id, turn, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM f""")
def glyph_runs(spark, d):
    t = F.col("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(t % 4 == 3, " ").otherwise("x").alias("c"), (t % 4).isin(1, 2).alias("maths"))
    return ordered.spaced_islands(c, "conv_id", ["turn"], "maths", "c").select("conv_id", "turn", "island")


@query("""WITH q AS (SELECT conv_id, turn, (turn * 3) % 5 AS number, min(greatest(turn, 2)) FILTER (turn >= 2) OVER (PARTITION BY conv_id) AS last FROM conversations), l AS (SELECT conv_id, number AS n FROM q WHERE turn = last)
SELECT conv_id, min(turn) AS cut FROM q JOIN l USING (conv_id) WHERE turn > last AND number <= n GROUP BY 1""")
def answer_list_cut(spark, d):
    q = table(spark, d, "conversations").select("conv_id", "turn", ((F.col("turn") * 3) % 5).alias("number"), F.lit(2).cast("long").alias("last"))
    return ordered.list_cut(q, "conv_id", "turn", "number", "last")


@query(rf"""SELECT conv_id, sha1(string_agg(substring(lower(regexp_replace(text, '[{tx.SPACE}$\\{{}}^_~,.]+', '', 'g')), 1, 120), '|' ORDER BY turn)) AS fingerprint, count(*) AS n FROM conversations GROUP BY 1""")
def text_fingerprints(spark, d):
    return dedup.fingerprint(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT count(*) AS total, count(*) FILTER (quality = toxic) AS agree, round(count(*) FILTER (quality = toxic) / count(*), 6) AS share FROM labels WHERE doc_id % 5 > 0 AND doc_id % 7 > 0")
def answer_agreement(spark, d):
    one = lambda c, m: table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % m > 0, F.concat(F.lit(" "), F.col(c).cast("string"))).otherwise(" ").alias("answer"))
    return ev.agreement(one("quality", 5), one("toxic", 7), ["doc_id"], "answer").withColumn("share", F.round("share", 6))


@query("""WITH r AS (SELECT conv_id, turn, turn % 3 = 0 AS scored, turn % 4 <> 1 AS there, conv_id % 2 = 0 AS same FROM conversations)
SELECT conv_id, count(*) AS n_reference, count(*) FILTER (there) AS n_found, round(avg(there::INT), 6) AS similarity, round(avg(same::INT) FILTER (scored AND there), 6) AS scores FROM r GROUP BY 1 HAVING count(*) FILTER (there) > 0""")
def text_verified(spark, d):
    """Two readings of one document; texts are the same but for how they write signs."""
    c = table(spark, d, "conversations")
    score = F.when(F.col("turn") % 3 == 0, F.lit("4"))
    reference = c.select("conv_id", "turn", F.concat(F.lit(r"\leq $x$ "), F.col("turn").cast("string")).alias("text"), score.alias("score"))
    found = c.filter("turn % 4 <> 1").select("conv_id", "turn", F.concat(F.lit("≤x"), F.col("turn").cast("string")).alias("text"), F.when(F.col("conv_id") % 2 == 0, score).otherwise("5").alias("score"))
    got = ev.verified(reference, found, "conv_id", "turn", "text", "score")
    return got.withColumns({c: F.round(c, 6) for c in ("similarity", "scores")})


@query("SELECT coalesce(a.c, b.c) AS conv_id, coalesce(a.p, b.p)::INT AS place, a.v AS \"left\", b.v AS \"right\" FROM (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, turn AS v FROM conversations) a FULL JOIN (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, turn AS v FROM conversations WHERE turn > 0) b ON a.c = b.c AND a.p = b.p")
def zipped_lists(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return relational.zipped(c, c.filter("turn > 0"), "conv_id", "turn", "turn")


@query("SELECT l.doc_id, l.quality FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en') AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.n_chars > 200)")
def both_present(spark, d):
    """Rows that two other tables both have."""
    both = table(spark, d, "documents")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return relational.with_any(relational.with_any(labels, both.filter("lang = 'en'"), "doc_id"), both.filter("n_chars > 200"), "doc_id")


@query("SELECT min(doc_id) AS original, source || '|' || lang AS key FROM documents WHERE source || '|' || lang IN (SELECT source || '|' || lang FROM documents WHERE doc_id % 3 = 0) GROUP BY 2")
def finished_copies(spark, d):
    """The first original of each key that a finished copy has too."""
    r = table(spark, d, "documents").select("doc_id", F.concat_ws("|", "source", "lang").alias("key"))
    return merge.first_wins(relational.with_any(r, r.filter("doc_id % 3 = 0"), "key"), ["key"], "doc_id").select(F.col("doc_id").alias("original"), "key")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE l.quality + 0.5 END::DOUBLE AS similarity, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_as_zero(spark, d):
    """Every golden row, with nothing where the cache has none."""
    cache = table(spark, d, "labels").select("doc_id", (F.col("quality") + 0.5).alias("s"))
    return table(spark, d, "documents").select("doc_id").join(cache, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit(0.0)).alias("similarity"), F.col("s").isNull().alias("missing"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 12")
def present_then_top(spark, d):
    """The first of those whose pages are there."""
    r = relational.with_any(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id")
    return relational.top(r, 12, F.desc("n_chars"), F.asc("doc_id")).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY (lang = 'en') DESC, doc_id LIMIT 1")
def preferred_file(spark, d):
    return relational.top(table(spark, d, "documents"), 1, F.desc(F.col("lang") == "en"), F.asc("doc_id")).select("doc_id")


@query("SELECT page_id::VARCHAR || '.json' AS file, row_number() OVER (ORDER BY page_id) AS place FROM pages ORDER BY page_id LIMIT 25")
def numeric_names(spark, d):
    """Files in the order of the numbers in their names; the first ones are numbered."""
    from pyspark.sql import Window

    p = table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".json")).alias("file"))
    number = F.regexp_extract("file", r"^(\d+)", 1).cast("long")
    return relational.top(p, 25, number).withColumn("place", F.row_number().over(Window.orderBy(number)).cast("long"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 2 = 0) JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)) AS met, (SELECT count(*) FROM documents) + (SELECT count(*) FROM labels) AS listed")
def key_intersection(spark, d):
    a, b = (table(spark, d, t).select("doc_id") for t in ("documents", "labels"))
    met = a.filter("doc_id % 2 = 0").distinct().join(b.distinct(), "doc_id").agg(F.count("*").alias("met"))
    return met.withColumn("listed", F.lit(a.unionByName(b).count()))


@query("SELECT p_size, count(*) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1")
def margin_counts(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"), F.min(p).alias("low"), F.max(p).alias("high"), F.round(F.avg(p), 4).alias("mean"))


@query("""SELECT source, count(*) FILTER (lang = 'en') AS filled, count(*) FILTER (lang = 'fr') AS failed, array_to_string(list_sort(list(doc_id) FILTER (lang = 'fr')), ',') AS failures, round(avg((lang = 'en')::INT), 6) AS accuracy FROM documents GROUP BY 1""")
def fill_summary(spark, d):
    fr = F.when(F.col("lang") == "fr", i())
    got = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("filled"), F.count(fr).alias("failed"), F.array_sort(F.collect_list(fr)).alias("f"), F.round(F.avg((F.col("lang") == "en").cast("int")), 6).alias("accuracy"))
    return got.select("source", "filled", "failed", F.when(F.size("f") > 0, F.array_join("f", ",")).alias("failures"), "accuracy")


@query("SELECT coalesce(category, 'UNCATEGORIZED') AS category, count(*) AS n, array_to_string(list(event_id ORDER BY event_id)[:8], ',') AS samples FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS category FROM events) GROUP BY 1")
def failure_samples(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("category"), F.col("event_id").alias("sample_id"), F.lit("").alias("golden"), F.lit("").alias("candidate"))
    return ev.clusters(e).select("category", "n", F.array_join("samples", ",").alias("samples"))


@query("SELECT display, arg_max(s_suppkey, (gen, -s_suppkey)) AS form FROM (SELECT s_suppkey, 'form ' || s_nationkey AS display, s_suppkey % 4 AS gen FROM supplier) GROUP BY 1")
def newest_generation(spark, d):
    f = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("form "), F.col("s_nationkey").cast("string")).alias("display"), (F.col("s_suppkey") % 4).alias("gen"))
    return f.groupBy("display").agg(F.max_by("s_suppkey", F.struct("gen", -F.col("s_suppkey"))).alias("form"))


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn, 1 + turn % 3 AS n FROM conversations), t AS (SELECT conv_id, -1::BIGINT AS turn, 0::BIGINT AS taken, false AS opened FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT t.conv_id, e.turn, CASE WHEN e.n = t.taken + 1 THEN e.n ELSE t.taken END, e.n = t.taken + 1 FROM t JOIN e ON e.conv_id = t.conv_id AND e.turn = t.turn + 1)
SELECT conv_id, taken::INT AS number, string_agg((1 + turn % 3) || '. line ' || turn, chr(10) ORDER BY turn) AS text FROM t WHERE turn >= 0 AND taken > 0 GROUP BY ALL""")
def question_skeleton(spark, d):
    t = F.col("turn")
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.concat((1 + t % 3).cast("string"), F.lit(". line "), t.cast("string")).alias("line"))
    return ordered.skeleton(lines, "conv_id", "turn", "line")


@query("""SELECT f.conv_id * 100 + f.turn AS id, (SELECT max(g.turn) FROM conversations g WHERE g.conv_id = f.conv_id AND g.turn < f.turn AND abs(g.turn % 3 - f.turn % 3) * 20 <= 30) AS glyph FROM conversations f""")
def figure_anchors(spark, d):
    t = F.col("turn")
    at = table(spark, d, "conversations").select("conv_id", t.alias("glyph"), (t % 3 * 20.0).alias("x"), (t * 10.0).alias("y"))
    figures = at.select((F.col("conv_id") * 100 + F.col("glyph")).alias("id"), "conv_id", "x", "y")
    return ordered.last_above(figures, at, "conv_id").select("id", "glyph")


@query("SELECT source, CASE WHEN count(*) FILTER (lang = 'en') > 0 AND source <> 'web' THEN 'done' ELSE 'pending' END AS status, CASE WHEN count(*) FILTER (lang = 'en') > 0 AND source <> 'web' THEN count(*) FILTER (lang = 'en') ELSE -1 END AS question_count FROM documents GROUP BY 1")
def exams_done(spark, d):
    r = table(spark, d, "documents")
    exams_ = r.select("source").distinct().select("source", F.lit("pending").alias("status"), F.lit(-1).cast("long").alias("question_count"))
    return merge.marked_done(exams_, r.filter("source <> 'web'"), r.filter("lang = 'en'"), "source")


@query(r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'is $\frac{1}{2}$' ELSE lang END AS answer, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'by $a \leq b$' END, source) AS solution, 'printed' AS answer_source FROM documents")
def merge_filled(spark, d):
    old = docs(spark, d, answer=F.col("lang"), solution=F.col("source"), topic=F.lit(None).cast("string"), difficulty=F.lit(None).cast("string"), answer_source=F.lit("printed"))
    new = docs(spark, d, answer=F.when(i() % 2 == 0, "is ${1} over {2}$").otherwise(""), solution=F.when(i() % 3 == 0, "by $a LEQ b$"), topic=F.lit(None).cast("string"), difficulty=F.lit("").cast("string"))
    return merge.merge_filled(old, new, ["doc_id"]).select("doc_id", "answer", "solution", "answer_source")
