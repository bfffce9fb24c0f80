"""The queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import (
    bpe_codec, conversation_repair, decontaminate, fill_middle, language_id, license_scan, quality_classifier, quality_rules, secret_scan, simhash_dedup, token_counts, toxicity, url_filter,
)
from foliant.llm.common import hot_join, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return quality_rules.judge(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"), path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def page_document() -> Column:
    """The document that a page shows: its number stands in the url's path."""
    return F.regexp_extract(url_filter.path_of(F.col("url")), "/([0-9]{1,18})", 1).try_cast("long")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    good = table(spark, sf_dir, "labels").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    shown = pages.select("url", page_document().alias("doc_id")).filter("doc_id is not null")
    known = hot_join(shown, good, ["doc_id"], shown.count(), "inner").select("url", "good")
    return url_filter.judge(pages, known)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    first = F.element_at(F.filter(F.split(url_filter.path_of(url), "/"), lambda s: s != ""), 1)
    sites = table(spark, sf_dir, "pages").select(page_document().alias("doc_id"), F.struct("page_id", url_filter.host_of(url).alias("host"), first.alias("path")).alias("s")).filter("doc_id is not null").groupBy("doc_id").agg(F.min("s").alias("s"))
    # Texts stay where they are: sites are joined to what was measured of them.
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels"), sites.select("doc_id", "s.host", "s.path"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def queries():
    return {f.__name__: f for f in (op1_quality_rules, op2_secret_scans, op3_toxicity, op4_license_scans, op5_url_filters, op6_benchmark_decontamination, op7_quality_classifier, op8_language_id, op9_simhash_near_dedup, op10_bpe_codec, op11_token_counts, op12_fill_middle, op13_conversation_repair)}


def level_sql(k: int) -> str:
    """One level of the tree over the shapes of the level before, by the test of each child."""
    few = f"n < {url_filter.URLS}"
    return f"""
deep{k} AS (SELECT *, template[:{k - 1}] AS parent, template[{k}] AS child FROM shapes{k - 1} WHERE len(template) >= {k}),
node{k} AS (SELECT host, parent, child, sum(n) AS n, sum(labelled) AS labelled, sum(good) AS good FROM deep{k} GROUP BY ALL),
family{k} AS (SELECT host, parent, count(*) AS children, sum(labelled) AS all_labelled, sum(good) / greatest(sum(labelled), 1) AS p, least(greatest(coalesce(sum(good) FILTER ({few}), 0) / greatest(coalesce(sum(labelled) FILTER ({few}), 0), 1), 1e-9), 1 - 1e-9) AS q FROM node{k} GROUP BY ALL),
child{k} AS (SELECT *, children >= {url_filter.CHILDREN} AS many, good / greatest(labelled, 1) AS share, labelled - good AS bad FROM node{k} JOIN family{k} USING (host, parent) WHERE children > 1),
merged{k} AS (SELECT host, parent, child, true AS merged FROM child{k} WHERE CASE WHEN many AND {few}
 THEN exp(-(CASE WHEN good > 0 THEN good * ln(share / q) ELSE 0 END + CASE WHEN bad > 0 THEN bad * ln((1 - share) / (1 - q)) ELSE 0 END)) * children >= {url_filter.ERROR}
 ELSE pow(good - labelled * p, 2) <= {url_filter.APART * url_filter.APART} * labelled * (p * (1 - p) + 1e-9) * CASE WHEN many THEN 1 - labelled / greatest(all_labelled, 1) ELSE 1 END + 1e-9 END),
shapes{k} AS (SELECT host, shape, parent || [CASE WHEN merged THEN '*' ELSE child END] || template[{k + 1}:] AS template, n, labelled, good FROM deep{k} LEFT JOIN merged{k} USING (host, parent, child)
 UNION ALL SELECT host, shape, template, n, labelled, good FROM shapes{k - 1} WHERE len(template) < {k})"""


SHAPE = """list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '[0-9a-f]{12,}') AND regexp_matches(s, '[a-f]') THEN '{hex}' ELSE regexp_replace(s, '[0-9]+', '#', 'g') END)"""
URLS = f"""WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
v AS (SELECT *, {SHAPE} AS shape FROM u),
l AS (SELECT doc_id, (min(quality) = 1)::INT AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
k AS (SELECT host, shape, 0 AS n, 1 AS labelled, l.good FROM v JOIN l ON l.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})', 1) AS BIGINT)),
shapes0 AS (SELECT host, shape, shape AS template, sum(n) AS n, sum(labelled) AS labelled, sum(good) AS good FROM (SELECT host, shape, 1 AS n, 0 AS labelled, 0 AS good FROM v UNION ALL SELECT * FROM k) GROUP BY host, shape),
{", ".join(level_sql(k) for k in range(1, url_filter.DEPTH + 1))},
s AS (SELECT * FROM shapes{url_filter.DEPTH}), a AS (SELECT (sum(good) + 1.0::DOUBLE) / (sum(labelled) + 1.0::DOUBLE) AS everyone FROM s),
h AS (SELECT host, (sum(good) + {url_filter.STRENGTH}::DOUBLE * (SELECT everyone FROM a)) / (sum(labelled) + {url_filter.STRENGTH}::DOUBLE) AS host_purity FROM s GROUP BY host),
t AS (SELECT host, template, (sum(good) + {url_filter.STRENGTH}::DOUBLE * any_value(host_purity)) / (sum(labelled) + {url_filter.STRENGTH}::DOUBLE) AS purity FROM s JOIN h USING (host) GROUP BY host, template),
f AS (SELECT v.page_id, v.host, v.path, '/' || array_to_string(s.template, '/') AS template, t.purity,
 CASE WHEN (v.host = 'example.org' OR v.host LIKE '%.example.org') AND starts_with(v.path, '/es/') THEN 'example.org/es/' WHEN (v.host = 'example.org' OR v.host LIKE '%.example.org') AND starts_with(v.path, '/en/1') THEN 'example.org/en/1'
 WHEN (v.host = 'com' OR v.host LIKE '%.com') AND starts_with(v.path, '/fr/') THEN 'com/fr/' WHEN (v.host = 'com' OR v.host LIKE '%.com') AND starts_with(v.path, '/de/') THEN 'com/de/' WHEN (v.host = 'org' OR v.host LIKE '%.org') AND starts_with(v.path, '/') THEN 'org/' END AS rule
 FROM v LEFT JOIN s ON v.host = s.host AND v.shape = s.shape LEFT JOIN t ON s.host = t.host AND s.template = t.template)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN purity < {url_filter.LEAST} * (SELECT everyone FROM a) THEN 'block' ELSE 'allow' END AS verdict, template, round(purity, 9) AS purity FROM f"""
MIDDLE = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(digest, i, 8))::BIGINT) AS h FROM t),
c AS (SELECT *, len(units)::BIGINT AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {fill_middle.TRANSFORMED} THEN 'plain' WHEN h[4] % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator; the others are tested against brute force in tests/llm."""
    return {"op5_url_filters": URLS, "op12_fill_middle": MIDDLE}
