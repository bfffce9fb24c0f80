"""Queries of the catalogue: statistics, searches, queues, lookups, audits. Exams stand for orders, questions for lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import crossed, in_scope, looked_up, missing, tag
from foliant.operators import audit, ordered, relational
from foliant.operators.merge import best_variant as variant
from foliant.operators.merge import first_wins as first_of
from foliant.operators.merge import last_wins as last_of
from foliant.plans.registry import query, table

BRANDS = {"Brand#11": "first", "Brand#12": "second", "Brand#13": "third"}


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def stats_by_type(spark, d):
    return relational.counted(table(spark, d, "lineitem"), "l_returnflag")


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def stats_join_group(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return relational.counted(o.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey"), "c_mktsegment", "o_orderpriority")


@query("SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_returned, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def counts_global(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 15")
def group_top_n(spark, d):
    return relational.top(relational.counted(table(spark, d, "part"), "p_brand"), 15, F.desc("n"), F.asc("p_brand"))


@query("""SELECT o_orderkey, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R' ORDER BY o_orderdate DESC, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 20""")
def find_filtered(spark, d):
    o = relational.filtered(table(spark, d, "orders"), o_orderpriority="1-URGENT", o_orderstatus="")
    q = relational.filtered(table(spark, d, "lineitem"), l_returnflag="R", l_linestatus=None)
    met = o.join(q, o["o_orderkey"] == q["l_orderkey"])
    return relational.top(met, 20, F.desc("o_orderdate"), *map(F.asc, ("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).select("o_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT doc_id, lang, substring(text, 1, 110) AS shown FROM documents WHERE text ILIKE '%tion the%'")
def find_text(spark, d):
    return relational.containing(table(spark, d, "documents"), "text", "tion the").select("doc_id", "lang", F.substring("text", 1, 110).alias("shown"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def exists_semi(spark, d):
    q = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.with_any(table(spark, d, "orders"), q, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (quality IS NULL OR quality = 0))")
def exists_missing(spark, d):
    open_ = table(spark, d, "labels").filter(missing(F.nullif(F.col("quality").cast("string"), F.lit("0"))))
    return relational.with_any(table(spark, d, "documents"), open_, "doc_id").select("doc_id", "source")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') AND (p_type LIKE '%A%' OR p_name LIKE '%a%'))")
def in_subquery_like(spark, d):
    p = table(spark, d, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#12") & (F.col("p_type").like("%A%") | F.col("p_name").like("%a%"))).select(F.col("p_partkey").alias("l_partkey"))
    return relational.with_any(table(spark, d, "lineitem"), p, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unmatched(spark, d):
    return relational.without_any(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def last_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("o"))
    return last_of(e, ["user_id", "event_type"], "o").drop("o")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def first_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("o"))
    return first_of(e, ["user_id", "event_type"], "o").drop("o")


@query("""SELECT source, doc_id, n_chars, variants FROM (SELECT *, count(*) OVER (PARTITION BY source) AS variants,
row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def best_variant(spark, d):
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return variant(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["source"], [rank, F.desc("n_chars"), F.asc("doc_id")]).select("source", "doc_id", "n_chars", "variants")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_custkey) AS id FROM customer")
def surrogate_ids(spark, d):
    return audit.surrogate_ids(table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment", "c_custkey"]).select("c_custkey", F.col("id").cast("long").alias("id"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, sum(times)::BIGINT AS n, min(l_linenumber) AS low, max(l_linenumber) AS high, list(l_linenumber) AS seen, list_sort(list(l_linenumber) FILTER (times > 1)) AS dup FROM c GROUP BY 1)
SELECT l_orderkey, n, coalesce(array_to_string(dup, ','), '') AS duplicates, coalesce(array_to_string(list_filter(range(low, high + 1), lambda x: NOT list_contains(seen, x::INTEGER))[:10], ','), '') AS gaps FROM g""")
def integrity_audit(spark, d):
    got = audit.numbering(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
    return got.select("l_orderkey", "n", F.array_join("duplicates", ",").alias("duplicates"), F.array_join("gaps", ",").alias("gaps"))


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS total, round(sum(l_extendedprice), 2) AS parts, abs(o_totalprice - sum(l_extendedprice)) > 5 AS differs
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice <> 0 GROUP BY o_orderkey, o_totalprice""")
def score_checksum(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    q = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return audit.score_checksum(o, q, "o_orderkey", "o_totalprice", "l_extendedprice", 5).select("o_orderkey", F.round("total", 2).alias("total"), F.round("parts", 2).alias("parts"), "differs")


@query("""SELECT event_type, n, round(n / t, 6) AS share, t >= 50 AND abs(n / t - 0.2) > 0.12 AS biased
FROM (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS t FROM events GROUP BY 1)""")
def distribution_deviation(spark, d):
    return audit.deviation(table(spark, d, "events"), "event_type", 0.2).withColumn("share", F.round("share", 6))


@query("""SELECT count(*) AS total, count(quality) AS n_quality, round(count(quality) / greatest(count(*), 1), 6) AS share_quality, count(toxic) AS n_toxic, round(count(toxic) / greatest(count(*), 1), 6) AS share_toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def coverage_ratio(spark, d):
    got = audit.coverage(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"), "quality", "toxic")
    return got.withColumns({c: F.round(c, 6) for c in ("share_quality", "share_toxic")})


@query("SELECT source, (sum(n_chars) // 1024)::BIGINT AS kib, (sum(n_chars) // 1024 // 1024)::BIGINT AS mib FROM documents GROUP BY source")
def size_units_intdiv(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("s")).select("source", F.expr("s div 1024").alias("kib"), F.expr("s div 1024 div 1024").alias("mib"))


@query("""SELECT day::VARCHAR AS day, n, floor(n / 1000) > floor(coalesce(lag(n) OVER (ORDER BY day), 0) / 1000) AS crossed FROM
(SELECT date_trunc('day', ts)::DATE AS day, sum(count(*)) OVER (ORDER BY date_trunc('day', ts)::DATE)::BIGINT AS n FROM events GROUP BY 1)""")
def threshold_crossing(spark, d):
    from pyspark.sql import Window

    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))  # one row a day
    w = Window.orderBy("day")
    run = days.select("day", F.sum("c").over(w).alias("n"))
    return run.select(F.col("day").cast("string").alias("day"), "n", crossed(F.col("n"), F.coalesce(F.lag("n").over(w), F.lit(0))).alias("crossed"))


@query("""SELECT o_orderkey FROM (SELECT *, 2020 + o_orderkey % 9 AS y, CASE WHEN o_orderstatus = 'F' THEN '중' ELSE '고' END AS level, 1 + o_custkey % 3 AS grade FROM orders)
WHERE y BETWEEN 2024 AND 2026 AND (level = '중' OR (level = '고' AND grade = 1))""")
def scope_filter(spark, d):
    o = table(spark, d, "orders")
    level = F.when(F.col("o_orderstatus") == "F", "중").otherwise("고")
    return o.filter(in_scope(level, 1 + F.col("o_custkey") % 3, 2020 + F.col("o_orderkey") % 9)).select("o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def queue_topk(spark, d):
    return relational.top(table(spark, d, "orders").filter("o_orderstatus = 'O' and o_totalprice > 1000"), 25, F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, bool_and(o_totalprice > 0) AS all_priced FROM orders GROUP BY ALL")
def status_histogram(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.bool_and(F.col("o_totalprice") > 0).alias("all_priced"))


@query("SELECT p_partkey, coalesce(CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#12' THEN 'second' WHEN 'Brand#13' THEN 'third' END, p_brand) AS brand FROM part")
def alias_lookup(spark, d):
    return table(spark, d, "part").select("p_partkey", looked_up(F.col("p_brand"), BRANDS).alias("brand"))


@query("SELECT s_suppkey, '[' || s_name || '][' || s_nationkey || '][' || 'None' || '][' || (2000 + s_suppkey) % 100 || '-1-' || 'f' || ']' AS tag FROM supplier")
def tags(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", tag(F.col("s_name"), F.col("s_nationkey"), F.lit(None).cast("string"), 2000 + F.col("s_suppkey"), F.lit(1), F.lit("f")).alias("tag"))


@query("""SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, max(l_extendedprice) AS most, count(l_extendedprice) AS n
FROM lineitem GROUP BY 1""")
def robust_stats(spark, d):
    got = relational.robust(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")
    return got.withColumns({c: F.round(c, 4) for c in ("mean", "median", "p95")})


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def linear_fit(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query("""WITH g AS (SELECT k, l_extendedprice AS y, pow(l_quantity - k, 2) AS z FROM lineitem, (VALUES (0.0), (5.0), (10.0)) t(k))
SELECT k::DOUBLE AS shift, round(regr_slope(y, z), 4) AS slope FROM g GROUP BY k ORDER BY regr_r2(y, z) DESC, k LIMIT 1""")
def grid_search(spark, d):
    grid = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "shift double")
    return relational.grid_fit(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", grid, "shift").select("shift", F.round("slope", 4).alias("slope"))


@query("SELECT p_size, count(*) FILTER (p_type LIKE '%STEEL%') AS steel, count(*) FILTER (p_type NOT LIKE '%STEEL%') AS other FROM part GROUP BY 1")
def marker_contingency(spark, d):
    steel = F.col("p_type").like("%STEEL%")
    return table(spark, d, "part").groupBy("p_size").agg(F.count_if(steel).alias("steel"), F.count_if(~steel).alias("other"))


@query("""SELECT o.o_orderkey, e.s_suppkey, CASE WHEN e.s_suppkey % 5 = o.o_orderkey % 5 THEN 0 WHEN e.s_acctbal > 0 THEN 1 ELSE 2 END AS tier
FROM (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) o JOIN supplier e ON e.s_nationkey = o.c_nationkey
QUALIFY row_number() OVER (PARTITION BY o.o_orderkey ORDER BY tier, e.s_suppkey) = 1""")
def tier_match(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("nation"), (F.col("o_orderkey") % 5).alias("fifth"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 5).alias("fifth"))
    least = [F.col("s_suppkey")]
    return relational.tiered_match(o, s, "o_orderkey", [(["nation", "fifth"], F.lit(True), least), (["nation"], F.col("s_acctbal") > 0, least), (["nation"], F.lit(True), least)], ["s_suppkey"])


@query("""SELECT c.c_custkey, s.s_suppkey AS id FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS nation, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 END AS kind FROM customer) c
JOIN supplier s ON (c.nation IS NULL OR c.nation = s.s_nationkey) AND (c.kind IS NULL OR c.kind = s.s_suppkey % 7) WHERE c.nation IS NOT NULL OR c.kind IS NOT NULL""")
def wildcard_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("nation"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 7).alias("kind"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("kind"))
    return relational.wildcard_match(c, s, ["nation", "kind"], "c_custkey")


@query("""WITH n AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), t AS (SELECT c_custkey + (c_custkey % 10 = 0)::INT AS c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 1)
SELECT t.c_custkey, CASE WHEN t.c_nationkey IS NULL AND t.c_mktsegment IS NULL THEN 'weak' WHEN coalesce(t.c_nationkey = n.c_nationkey AND t.c_mktsegment = n.c_mktsegment, false) THEN 'ok'
WHEN EXISTS (SELECT 1 FROM n o WHERE o.c_nationkey = t.c_nationkey AND o.c_mktsegment = t.c_mktsegment) THEN 'shifted' ELSE 'mislabeled' END AS verdict
FROM t LEFT JOIN n ON n.c_custkey = t.c_custkey""")
def id_stability(spark, d):
    now = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    then = now.filter(k % 10 != 1).select((k + (k % 10 == 0).cast("int")).alias("c_custkey"), F.when(k % 7 > 0, F.col("c_nationkey")).alias("c_nationkey"), F.when(k % 7 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return audit.stable_ids(now, then, "c_custkey", ["c_nationkey", "c_mktsegment"])


@query("""SELECT e.event_id, arg_max(p.value, p.event_id) AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') e
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON p.user_id = e.user_id AND p.event_id <= e.event_id GROUP BY e.event_id""")
def asof_last_before(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return ordered.last_before(e.filter("event_type = 'click'").drop("value"), e.filter("event_type = 'view'"), "user_id", "event_id", "value").select("event_id", "last_value")


@query("""SELECT l.l_orderkey * 10 + l.l_linenumber AS id, min(b.s_suppkey) AS box FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity * 10 AS x, l_discount * 1000 AS y FROM lineitem) l
LEFT JOIN (SELECT s_suppkey, s_suppkey % 4 AS page, (s_suppkey % 40) * 10.0 AS x0, (s_suppkey % 40) * 10.0 + 60 AS x1, 0.0 AS y0, 70.0 AS y1 FROM supplier) b
ON b.page = l.l_orderkey % 4 AND l.x BETWEEN b.x0 AND b.x1 AND l.y BETWEEN b.y0 AND b.y1 GROUP BY 1""")
def spatial_point_in_box(spark, d):
    p = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as id", "l_orderkey % 4 as page", "l_quantity * 10 as x", "l_discount * 1000 as y")
    b = table(spark, d, "supplier").selectExpr("s_suppkey as box", "s_suppkey % 4 as page", "s_suppkey % 40 * 10.0d as x0", "s_suppkey % 40 * 10.0d + 60 as x1", "0.0d as y0", "70.0d as y1")
    return ordered.point_in_box(p, b, "page").groupBy("id").agg(F.min("box").alias("box"))
