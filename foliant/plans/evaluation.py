"""Queries of evaluation and of operators that depend on row order. Conversations stand for exams, turns for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import evaluation as ev
from foliant.operators import ordered
from foliant.plans.registry import query, table

#: All Hangul syllables: letters that a text can have once each.
LETTERS = "".join(map(chr, range(0xAC00, 0xD7A4)))


@query("""WITH g AS (SELECT conv_id, turn, 1 + turn % 3 AS number FROM conversations), c AS (SELECT conv_id, turn, 1 + turn % 4 AS number FROM conversations WHERE turn % 5 <> 1),
gf AS (SELECT conv_id, number, min(turn) AS g_order FROM g GROUP BY ALL), cf AS (SELECT conv_id, number, min(turn) AS c_order FROM c GROUP BY ALL),
met AS (SELECT conv_id, g_order, c_order FROM gf JOIN cf USING (conv_id, number)),
gr AS (SELECT conv_id, turn AS g_order, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM g WHERE (conv_id, turn) NOT IN (SELECT conv_id, g_order FROM met)),
cr AS (SELECT conv_id, turn AS c_order, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM c WHERE (conv_id, turn) NOT IN (SELECT conv_id, c_order FROM met))
SELECT * FROM met UNION ALL SELECT conv_id, g_order, c_order FROM gr JOIN cr USING (conv_id, n)""")
def pair_by_number(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn")
    golden, candidate = t.withColumn("number", 1 + F.col("turn") % 3), t.filter("turn % 5 <> 1").withColumn("number", 1 + F.col("turn") % 4)
    return ev.paired(candidate, golden, "conv_id", "number", "turn")


@query("""SELECT count(*) AS n, round(avg(quality), 6) AS mean_quality, round(avg(CASE WHEN doc_id % 2 = 0 THEN toxic END), 6) AS mean_toxic, round(avg((toxic = 1)::INT), 6) AS regression_rate FROM labels""")
def eval_aggregate(spark, d):
    s = table(spark, d, "labels").select(F.col("quality").cast("double").alias("quality"), F.when(F.col("doc_id") % 2 == 0, F.col("toxic")).cast("double").alias("toxic"), F.when(F.col("toxic") == 1, F.array(F.lit("TOXIC"))).otherwise(F.array().cast("array<string>")).alias("regressions"))
    got = ev.aggregated(s, ["quality", "toxic"])
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("mean_quality", "mean_toxic", "regression_rate")])


@query("""WITH s AS (SELECT doc_id, quality = 0 AS b, toxic = 1 AS c FROM labels) SELECT count(*) AS n, round(avg(b::INT), 6) AS base_rate, round(avg(c::INT), 6) AS candidate_rate, sum((c AND NOT b)::INT)::BIGINT AS new_regressions,
avg(c::INT) <= avg(b::INT) + 1e-9 AND sum((c AND NOT b)::INT) = 0 AS passed FROM s""")
def ab_gate(spark, d):
    tags = lambda c: F.when(c, F.array(F.lit("BAD"))).otherwise(F.array().cast("array<string>")).alias("regressions")
    s = table(spark, d, "labels").withColumnRenamed("doc_id", "sample_id")
    got = ev.ab_gate(s.select("sample_id", tags(F.col("quality") == 0)), s.select("sample_id", tags(F.col("toxic") == 1)))
    return got.withColumns({c: F.round(c, 6) for c in ("base_rate", "candidate_rate")})


@query("SELECT avg(quality) AS mean_quality, avg(quality) >= 0.8 AS passed FROM labels")
def threshold_gate(spark, d):
    return ev.threshold_gate(table(spark, d, "labels").agg(F.avg("quality").alias("mean_quality")), {"mean_quality": 0.8}, {})


@query("SELECT conv_id, round(CASE WHEN count(*) FILTER (role = 'user') + count(*) FILTER (role <> 'user') = 0 THEN 1 ELSE 2.0 * least(count(*) FILTER (role = 'user'), count(*) FILTER (role <> 'user')) / count(*) END, 6) AS f1 FROM conversations GROUP BY 1")
def presence_f1(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("a"), F.count_if(F.col("role") != "user").alias("b"))
    return n.select("conv_id", F.round(ev.presence_f1(F.col("a"), F.col("b")), 6).alias("f1"))


def turns(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "text", F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("after"))


@query()
def seq_ratio(spark, d):
    """How alike each turn is to the next: rows only, as SQL has no such measure."""
    return turns(spark, d).select("conv_id", "turn", F.round(ev.seq_ratio(F.col("text"), F.col("after")), 6).alias("ratio"))


@query(r"""WITH p AS (SELECT conv_id, turn, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') AS t, regexp_replace(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '[^\p{L}\p{N}]+', '', 'g') AS hay FROM conversations)
SELECT conv_id, turn, round(CASE WHEN t = '' THEN 1 WHEN length(t) <= 12 THEN contains(hay, t)::INT ELSE list_avg(list_transform(range(1, length(t) - 10, 6), lambda i: contains(hay, substring(t, i, 12))::INT)) END, 6) AS present FROM p""")
def windows_present(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.round(ev.prose_present(F.col("text"), F.col("after")), 6).alias("present"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question FROM conversations")
def carry_forward(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("head"))
    return ordered.carried(c, "conv_id", "turn", "head", "question").select("conv_id", "turn", "question")


@query("""SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM
(SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)::INT AS new FROM events)""")
def run_islands(spark, d):
    return ordered.islands(table(spark, d, "events"), "user_id", ["event_id"], "event_type").select("event_id", "island")


@query("""WITH f AS (SELECT conv_id, turn, (length(text) < 200)::INT AS f FROM conversations), t AS (SELECT *, min(f) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM f),
c AS (SELECT *, sum(tail) OVER (PARTITION BY conv_id) AS cut, count(*) OVER (PARTITION BY conv_id) AS n FROM t) SELECT conv_id, turn FROM c WHERE tail = 0 OR cut > 0.5 * n""")
def tail_trim(spark, d):
    return ordered.tail_trimmed(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", F.length("text") < 200).select("conv_id", "turn")


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS \"end\" FROM conversations WHERE role = 'user'")
def segment_bounds(spark, d):
    return ordered.segments(table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn"), "conv_id", "turn")


@query("""WITH o AS (SELECT conv_id, turn, (turn * 7) % 5 AS number FROM conversations), v AS (SELECT conv_id, min(number) > 0 AND count(DISTINCT number) = count(*) AS ok FROM o GROUP BY 1)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN ok THEN number ELSE turn END, turn) AS place FROM o JOIN v USING (conv_id)""")
def reorder_by_number(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", ((F.col("turn") * 7) % 5).alias("number"))
    return ordered.reordered(c, "conv_id", "turn", "number").select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@query("""WITH x AS (SELECT DISTINCT l_returnflag, l_extendedprice AS x FROM lineitem), g AS (SELECT l_returnflag, x - lag(x) OVER w AS gap, (x + lag(x) OVER w) / 2 AS middle FROM x WINDOW w AS (PARTITION BY l_returnflag ORDER BY x))
SELECT l_returnflag, round(arg_max(middle, gap), 4) AS cut FROM g GROUP BY 1""")
def column_cut(spark, d):
    return ordered.column_cut(table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x")), "l_returnflag", "x", 0).select("l_returnflag", F.round("cut", 4).alias("cut"))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, 1 + event_id % 4 AS n FROM events),
t AS (SELECT user_id, 0::BIGINT AS p, 0::BIGINT AS taken FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT t.user_id, e.p, CASE WHEN e.n = t.taken + 1 THEN e.n ELSE t.taken END FROM t JOIN e ON e.user_id = t.user_id AND e.p = t.p + 1)
SELECT user_id, max(taken)::INT AS accepted FROM t GROUP BY 1""")
def accepted_headers(spark, d):
    """Numbers that continue a count, of each user's events in order."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda i: (1 + i % 4).cast("int")).alias("n"))
    return e.select("user_id", F.size(ordered.accepted(F.col("n"))).alias("accepted"))


@query("SELECT coalesce(category, 'UNCATEGORIZED') AS category, count(*) AS n FROM (SELECT CASE WHEN event_type <> 'view' THEN event_type END AS category FROM events) GROUP BY 1")
def failure_clusters(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("category"), F.col("event_id").alias("sample_id"), F.lit("").alias("golden"), F.lit("").alias("candidate"))
    return ev.clusters(e).select("category", "n")


@query("""WITH d AS (SELECT doc_id, 20 + n_chars % 150 AS n, doc_id % (20 + n_chars % 150) AS k FROM documents), c AS (SELECT *, n_chars % (n - k + 1) AS m FROM d JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))
SELECT doc_id, round(CASE doc_id % 3 WHEN 0 THEN 2.0 * (n - m) / (2 * n - m) WHEN 1 THEN greatest(k, n - k) / n::DOUBLE ELSE (n - m) / n::DOUBLE END, 6)::DOUBLE AS ratio FROM c""")
def seq_ratio_degrees(spark, d):
    """The similarity of texts of letters that occur once, so that SQL can tell it: with a part left out, with two parts changed about, with a part replaced."""
    r = table(spark, d, "documents")
    n = (20 + F.col("n_chars") % 150).cast("int")
    k = (F.col("doc_id") % n).cast("int")
    m = (F.col("n_chars") % (n - k + 1)).cast("int")
    cut = lambda start, length: F.substring(F.lit(LETTERS), start, length)
    one = F.lit(1)
    a, left, right, after = cut(one, n), cut(one, k), cut(k + 1, n - k), cut(k + m + 1, n - k - m)
    b = F.when(F.col("doc_id") % 3 == 0, F.concat(left, after)).when(F.col("doc_id") % 3 == 1, F.concat(right, left)).otherwise(F.concat(left, cut(F.lit(5_001), m), after))
    return r.select("doc_id", F.round(ev.seq_ratio(a, b), 6).alias("ratio"))
