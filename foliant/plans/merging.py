"""Queries of merge policies, reloads, change signatures and deduplication. Documents stand for questions, labels for answer sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import SPACE
from foliant.operators import dedup, merge
from foliant.plans.registry import query, table
from foliant.sources import sinks

OLD = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN '' END AS answer, CASE WHEN doc_id % 2 = 0 THEN source END AS solution, CASE WHEN doc_id % 4 > 0 THEN lang ELSE '' END AS topic, CASE WHEN doc_id % 5 > 0 THEN source END AS difficulty, NULL::VARCHAR AS answer_source FROM documents"
NEW = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'a�' ELSE quality::VARCHAR END AS answer, toxic::VARCHAR AS solution, CASE WHEN doc_id % 2 = 0 THEN 't' || quality ELSE '' END AS topic, CASE WHEN doc_id % 3 = 0 THEN 'd' || toxic END AS difficulty FROM labels"
MET = f"WITH o AS ({OLD}), n AS ({NEW}) SELECT o.doc_id, "
ON = " FROM o LEFT JOIN n ON o.doc_id = n.doc_id"


def old(spark, d):
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    return table(spark, d, "documents").select(
        "doc_id", F.when(i % 3 == 0, F.col("lang")).when(i % 3 == 1, "").alias("answer"), F.when(i % 2 == 0, F.col("source")).alias("solution"),
        F.when(i % 4 > 0, F.col("lang")).otherwise("").alias("topic"), F.when(i % 5 > 0, F.col("source")).alias("difficulty"), none.alias("answer_source"),
    )


def new(spark, d):
    i, q, t = F.col("doc_id"), F.col("quality").cast("string"), F.col("toxic").cast("string")
    return table(spark, d, "labels").select(
        "doc_id", F.when(i % 4 == 0, "").when(i % 11 == 0, "a�").otherwise(q).alias("answer"), t.alias("solution"),
        F.when(i % 2 == 0, F.concat(F.lit("t"), q)).otherwise("").alias("topic"), F.when(i % 3 == 0, F.concat(F.lit("d"), t)).alias("difficulty"),
    )


@query(f"""{MET} CASE WHEN n.doc_id IS NULL THEN o.answer ELSE nullif(CASE WHEN n.answer LIKE '%�%' THEN '' ELSE n.answer END, '') END AS answer, CASE WHEN n.doc_id IS NULL THEN o.solution ELSE nullif(n.solution, '') END AS solution,
coalesce(nullif(n.topic, ''), o.topic) AS topic, coalesce(nullif(n.difficulty, ''), o.difficulty) AS difficulty, CASE WHEN nullif(CASE WHEN n.answer LIKE '%�%' THEN '' ELSE n.answer END, '') IS NOT NULL THEN 'printed' END AS answer_source {ON}""")
def merge_overwrite(spark, d):
    return merge.merge_printed(old(spark, d), new(spark, d), ["doc_id"])


@query(f"{MET} o.answer_source, coalesce(nullif(n.answer, ''), o.answer) AS answer, coalesce(nullif(n.solution, ''), o.solution) AS solution, coalesce(nullif(n.topic, ''), o.topic) AS topic, coalesce(nullif(n.difficulty, ''), o.difficulty) AS difficulty {ON}")
def merge_new_first(spark, d):
    return merge.merge_new_first(old(spark, d), new(spark, d), ["doc_id"])


@query(f"{MET} coalesce(nullif(o.topic, ''), nullif(n.topic, '')) AS topic, coalesce(nullif(o.difficulty, ''), nullif(n.difficulty, '')) AS difficulty {ON}")
def merge_old_first(spark, d):
    return merge.merge_old_first(old(spark, d), new(spark, d), ["doc_id"]).select("doc_id", "topic", "difficulty")


@query(f"{MET} CASE WHEN trim(coalesce(o.answer, '')) = '' THEN coalesce(nullif(n.answer, ''), o.answer) ELSE o.answer END AS answer, CASE WHEN trim(coalesce(o.answer, '')) = '' THEN coalesce(nullif(n.topic, ''), o.topic) ELSE o.topic END AS topic {ON}")
def merge_blank(spark, d):
    return merge.merge_blank(old(spark, d), new(spark, d), ["doc_id"]).select("doc_id", "answer", "topic")


@query(f"""WITH o AS ({OLD}), l AS (SELECT doc_id, quality::VARCHAR AS a, toxic::VARCHAR AS b FROM labels)
SELECT o.doc_id, CASE WHEN nullif(o.answer, '') IS NULL AND a = b THEN a ELSE o.answer END AS answer, CASE WHEN nullif(o.answer, '') IS NULL AND a = b THEN 'computed:medium' END AS answer_source FROM o LEFT JOIN l ON o.doc_id = l.doc_id""")
def agree_fill(spark, d):
    sheet = lambda c, how: table(spark, d, "labels").select("doc_id", F.col(c).cast("string").alias("answer"), F.lit(None).cast("string").alias("solution"), F.lit(how).cast("string").alias("confidence"))
    return merge.merge_solved(old(spark, d), sheet("quality", "high"), sheet("toxic", None), ["doc_id"]).select("doc_id", "answer", "answer_source")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patched_overrides(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    patch = c.filter(k % 5 < 2).select("c_custkey", F.create_map(F.lit("c_mktsegment"), F.when(k % 5 == 1, F.lit("NEW"))).alias("set"))
    return merge.patched(c, patch, "c_custkey", ["c_mktsegment"])


@query("SELECT event_id, user_id, event_type, CASE WHEN user_id % 7 = 0 THEN -value ELSE value END AS value FROM events WHERE user_id % 11 <> 0")
def reload_idempotent(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    users = e.filter("user_id % 7 = 0 or user_id % 11 = 0").select("user_id")
    batch = e.filter("user_id % 7 = 0 and user_id % 11 <> 0").withColumn("value", -F.col("value"))
    once = sinks.reloaded(e, batch, "user_id", users)
    return sinks.reloaded(once, batch, "user_id", users)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return merge.upserted(o, o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])


SIGNED = "SELECT conv_id, sha1(string_agg('=' || turn || chr(31) || coalesce('=' || role, '-') || chr(31) || coalesce('=' || {text}, '-'), chr(30) ORDER BY turn)) AS signature FROM conversations GROUP BY conv_id"


@query(SIGNED.format(text="text"))
def change_signature(spark, d):
    return sinks.change_signature(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 = 0")
def incremental_changes(spark, d):
    c = table(spark, d, "conversations")
    edited = c.withColumn("text", F.when(F.col("conv_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    now, state = (sinks.change_signature(x, "conv_id", "turn", "role", "text") for x in (edited, c))
    return sinks.changed(now, state, "conv_id").select("conv_id")


@query("SELECT source, count(*) FILTER (doc_id % 10 < 5) AS n, CASE WHEN count(*) FILTER (doc_id % 10 < 5) = 0 THEN 'no_source' WHEN count(*) FILTER (doc_id % 10 < 5 AND lang <> 'en') > 0 THEN 'done' ELSE 'pending' END AS status FROM documents GROUP BY 1")
def source_status(spark, d):
    some = F.col("doc_id") % 10 < 5
    items = table(spark, d, "documents").select("source", F.when(some, F.col("doc_id")).alias("number"), F.when(some & (F.col("lang") != "en"), F.col("lang")).alias("answer"))
    return merge.exam_status(items, "source").join(items.groupBy("source").agg(F.count("number").alias("n")), "source").select("source", "n", F.col("solution_status").alias("status"))


@query("SELECT conv_id, count(*) AS count, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS shown FROM conversations GROUP BY 1")
def worksheets(spark, d):
    got = sinks.worksheets(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return got.select("conv_id", "count", F.array_join(F.transform("questions", lambda q: F.concat(q["role"], F.lit(":"), F.length(q["text"]).cast("string"))), ",").alias("shown"))


STEMS = r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT doc_id, lower(regexp_replace(line, '[WHITE$\\{}^_~,.]+', '', 'g')) AS s FROM lines),
stems AS (SELECT doc_id, substring(s, 1, 120) AS stem FROM w WHERE length(s) >= 20), sets AS (SELECT doc_id, count(*) AS total, count(DISTINCT stem) AS dist, list_sort(list_distinct(list(stem))) AS x FROM stems GROUP BY 1), n AS (SELECT doc_id, total, dist, min(doc_id) OVER (PARTITION BY total, x) AS rep FROM sets),
one AS (SELECT DISTINCT doc_id, stem FROM stems JOIN n USING (doc_id) WHERE doc_id = rep),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM one a JOIN one b ON a.stem = b.stem AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT x, y, c / greatest(p.dist, q.dist) AS similarity, p.total AS tx, q.total AS ty FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE abs(p.total - q.total) <= 3 AND c / greatest(p.dist, q.dist) >= 0.85)""".replace("WHITE", SPACE)


def line_classes(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return dedup.classes(dedup.stems(lines, "doc_id", "line"))


@query(STEMS + " SELECT doc_id AS key, rep FROM n")
def dedup_classes(spark, d):
    return line_classes(spark, d).select("key", "rep")


@query(STEMS + " SELECT x, y, round(similarity, 6) AS similarity FROM pairs")
def dedup_pairs(spark, d):
    """Pairs of classes; `dedup_classes` has the members."""
    return dedup.similar_pairs(line_classes(spark, d)).select("x", "y", F.round("similarity", 6).alias("similarity"))


@query(STEMS + """ SELECT CASE WHEN tx >= ty THEN y ELSE x END AS loser, arg_max(CASE WHEN tx >= ty THEN x ELSE y END, x * 1000000 + y) AS keeper FROM pairs GROUP BY 1
UNION ALL SELECT doc_id, rep FROM n WHERE doc_id <> rep""")
def dedup_mark(spark, d):
    known = line_classes(spark, d)
    return dedup.marked(dedup.similar_pairs(known)).unionByName(dedup.copies_marked(known))
