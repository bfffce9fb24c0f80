"""Queries of text, markup and JSON functions over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import relational
from foliant.plans.registry import query, table


@query(r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') AS t FROM documents")
def norm_strict(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.norm_strict(F.col("text")).alias("t"))


@query(r"SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS t FROM documents")
def norm_loose(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.norm_loose(F.col("text")).alias("t"))


@query(rf"SELECT doc_id, substring(lower(regexp_replace(text, '[{tx.SPACE}$\\{{}}^_~,.]+', '', 'g')), 1, 120) AS t FROM documents")
def norm_dedup(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.norm_dedup(F.col("text")).alias("t"))


RISKS = r"""SELECT doc_id, 'DECIMAL' AS category, 'high' AS severity, unnest(list_distinct(regexp_extract_all(text, '\d+\.\d{2,}'))) AS token FROM documents
UNION ALL SELECT doc_id, 'INEQUALITY', 'medium', unnest(list_distinct(regexp_extract_all(text, '[<>≤≥≦≧]|\\le\b|\\ge\b|\\leq\b|\\geq\b'))) FROM documents
UNION ALL SELECT doc_id, 'EXPONENT', 'medium', unnest(list_distinct(regexp_extract_all(text, '\^\s*\{?\s*\d'))) FROM documents
UNION ALL SELECT doc_id, 'PERCENT', 'low', unnest(list_distinct(regexp_extract_all(text, '\d+\s*%'))) FROM documents
UNION ALL SELECT doc_id, 'UNIT', 'low', unnest(list_distinct(regexp_extract_all(text, '\d+\s*(?:cm|mm|km|kg|mg|mL|kL|°C|℃)\b'))) FROM documents
UNION ALL SELECT doc_id, 'NUMBER', 'low', unnest(list_distinct(regexp_extract_all(text, '\d{3,}'))) FROM documents"""


def risks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(tx.risk_tokens(F.col("text"), "low")).alias("r")).select("doc_id", "r.category", "r.severity", "r.token")


@query(RISKS)
def risk_tokens(spark, d):
    return risks(spark, d)


@query(f"SELECT category, severity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({RISKS}) GROUP BY ALL")
def risk_summary(spark, d):
    # One row a document and category, not a token, goes to the shuffle.
    found = table(spark, d, "documents").select("doc_id", tx.risk_tokens(F.col("text"), "low").alias("r"))
    kinds = F.array_distinct(F.transform("r", lambda t: F.struct(t["category"].alias("category"), t["severity"].alias("severity"))))
    each = found.select("doc_id", F.explode(F.transform(kinds, lambda k: F.struct(k.alias("k"), F.size(F.filter("r", lambda t: t["category"] == k["category"])).alias("n")))).alias("x"))
    return each.groupBy("x.k.category", "x.k.severity").agg(F.sum("x.n").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", tx.without_tags(F.col("html")).alias("t"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS plain FROM conversations GROUP BY 1""")
def flatten_plain(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("plain"))


@query("SELECT event_id, json_keys(props)::VARCHAR[] IS NOT NULL AS parsed, len(json_keys(props)) AS keys FROM events")
def json_props(spark, d):
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select("event_id", keys.isNotNull().alias("parsed"), F.size(keys).cast("long").alias("keys"))


@query(r"""WITH s AS (SELECT event_id, regexp_extract_all(props, '[{}]') AS c, (length(props) - length(replace(props, '$', ''))) % 2 = 0 AS even FROM events),
r AS (SELECT event_id, even, list_transform(range(1, len(c) + 1), lambda i: list_sum(list_transform(c[:i], lambda x: CASE WHEN x = '{' THEN 1 ELSE -1 END))) AS depth FROM s)
SELECT event_id, even AND coalesce(list_min(depth), 0) >= 0 AND coalesce(depth[-1], 0) = 0 AS balanced FROM r""")
def brace_balance(spark, d):
    return table(spark, d, "events").select("event_id", tx.balanced(F.col("props")).alias("balanced"))


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, left(sha256(text), 12) AS signature FROM documents")
def text_hashes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"), tx.signature(t).alias("signature"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(html), '<([a-z0-9]+)', 1)) AS token FROM pages) WHERE token NOT IN ('p', 'a', 'li', 'ul', 'div') GROUP BY 1")
def unknown_tokens(spark, d):
    tokens = table(spark, d, "pages").select(F.explode(F.regexp_extract_all(F.lower("html"), F.lit("<([a-z0-9]+)"), F.lit(1))).alias("token"))
    known = spark.createDataFrame([(x,) for x in ("p", "a", "li", "ul", "div")], "token string")
    return relational.counted(tokens.join(F.broadcast(known), "token", "left_anti"), "token")  # five tokens


@query("""WITH l AS (SELECT conv_id AS key, turn AS path, role AS value FROM conversations), r AS (SELECT conv_id AS key, turn AS path, CASE WHEN turn % 3 = 0 THEN 'x' ELSE role END AS value FROM conversations WHERE turn % 5 <> 0)
SELECT coalesce(l.key, r.key) AS key, coalesce(l.path, r.path) AS path, l.value AS "left", r.value AS "right" FROM l FULL JOIN r ON l.key = r.key AND l.path = r.path WHERE l.value IS DISTINCT FROM r.value""")
def structural_difference(spark, d):
    a = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("path"), F.col("role").alias("value"))
    b = a.filter("path % 5 <> 0").withColumn("value", F.when(F.col("path") % 3 == 0, "x").otherwise(F.col("value")))
    return relational.path_difference(a, b, "key")


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN floor(p_retailprice)::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS shown FROM part WHERE p_retailprice < 10000")
def score_text(spark, d):
    return table(spark, d, "part").filter("p_retailprice < 10000").select("p_partkey", tx.score_text(F.col("p_retailprice")).alias("shown"))


@query("SELECT doc_id, len(w) AS n, w[1] AS first, w[-1] AS last FROM (SELECT doc_id, CASE WHEN length(text) <= 12 THEN [text] ELSE list_transform(range(1, length(text) - 10, 6), lambda i: substring(text, i, 12)) END AS w FROM documents WHERE text <> '')")
def sliding_windows(spark, d):
    w = F.col("w")
    return table(spark, d, "documents").filter("text <> ''").select("doc_id", tx.windows(F.col("text")).alias("w")).select("doc_id", F.size(w).cast("long").alias("n"), F.get(w, F.lit(0)).alias("first"), F.element_at(w, -1).alias("last"))
