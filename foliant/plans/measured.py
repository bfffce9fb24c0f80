"""Queries of measures: scans made of the bytes of texts, widths of labels, sizes of equations."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import exams, images, measures
from foliant.plans.registry import query, table

#: Pixels in a row of the scans, and from which byte on they are white.
WIDTH, WHITE = 16, 110


@query(f"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(hex(text), '..')[:strlen(text) // {WIDTH} * {WIDTH}], lambda x: ('0x' || x)::INT) AS p FROM documents WHERE strlen(text) >= {WIDTH}),
l AS (SELECT doc_id, p, len(p) AS n, list_transform(range(0, len(p)), lambda k: p[k + 1 + CASE WHEN k >= {WIDTH} THEN -{WIDTH} ELSE 0 END] + p[k + 1 + CASE WHEN k + {WIDTH} < len(p) THEN {WIDTH} ELSE 0 END] + p[k + 1 - CASE WHEN k % {WIDTH} > 0 THEN 1 ELSE 0 END] + p[k + 1 + CASE WHEN k % {WIDTH} < {WIDTH - 1} THEN 1 ELSE 0 END] - 4 * p[k + 1]) AS lap FROM d),
v AS (SELECT doc_id, n, list_aggregate(lap, 'var_pop') AS sharpness, 100.0 * len(list_filter(p, lambda x: x < {WHITE})) / n AS ink, p FROM l),
h AS (SELECT doc_id, x, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(p) AS x FROM v) GROUP BY ALL),
s AS (SELECT doc_id, x, sum(c) OVER w AS below, sum(c * x) OVER w AS sb, sum(c) OVER (PARTITION BY doc_id) AS n, sum(c * x) OVER (PARTITION BY doc_id) AS sa FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY x)),
o AS (SELECT doc_id, below * (n - below) * pow(sb / below - (sa - sb) / greatest(n - below, 1), 2) AS apart, CASE WHEN n > below THEN (sa - sb) / (n - below) - sb / below ELSE 0 END AS contrast, x FROM s),
c AS (SELECT doc_id, arg_max(contrast, (apart, -x)) AS contrast FROM o GROUP BY 1)
SELECT doc_id, round(sharpness + 1e-7, 4) AS sharpness, round(ink + 1e-7, 4) AS ink, round(contrast + 1e-7, 4) AS contrast, greatest(0, 100 - 30 - CASE WHEN sharpness < 3000 THEN 40 ELSE 0 END - CASE WHEN ink < 60 THEN 50 ELSE 0 END - CASE WHEN contrast < 65 THEN 25 ELSE 0 END)::DOUBLE AS score FROM v JOIN c USING (doc_id)""")
def scans_measured(spark, d):
    """Each text's bytes as a scan of sixteen pixels a row: its features, and its quality by them."""
    height = F.floor(F.octet_length("text") / WIDTH).cast("int")
    scans = table(spark, d, "documents").filter(height > 0).select("doc_id", height.alias("h"), F.substring(F.col("text").cast("binary"), F.lit(1), height * WIDTH).alias("pixels"))
    m = scans.select("doc_id", "h", images.measured(F.col("pixels"), F.lit(WIDTH), F.col("h"), WHITE).alias("m"))
    quality = exams.page_quality(F.lit(WIDTH), F.col("h"), F.col("m.sharpness"), F.col("m.ink"), F.col("m.contrast"), sharp=3000.0, blank=60.0, faded=65.0)
    return m.select("doc_id", *[F.round(F.col(f"m.{c}") + 1e-7, 4).alias(c) for c in ("sharpness", "ink", "contrast")], quality["score"].alias("score"))


@query(r"""WITH o AS (SELECT o_orderkey AS k, length(o_custkey::VARCHAR) AS a, length(o_orderkey::VARCHAR) AS b, o_orderkey % 3 AS kind FROM orders)
SELECT k AS o_orderkey, round(CASE kind WHEN 0 THEN 0.5 * a + 0.5 + 0.72 * 0.5 * b + (0.564 + 0.34) + 0.5 * b + 0.4 * 0.63 WHEN 1 THEN 0.768 + 0.722 + 0.667 + (0.564 + 0.34) + 0.5 * a + 0.25 + 2 * 0.444 + 0 ELSE 0.564 + 0.5 * a + 0.72 * (0.278 + 0.564 + 0.5 * b) + 2 * 1.0 END, 6)::DOUBLE AS width FROM o""")
def label_widths(spark, d):
    """Widths of labels: powers and degrees, angles and units, signs in scripts without their spaces."""
    a, b = F.col("o_custkey"), F.col("o_orderkey")
    one = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    label = F.when(b % 3 == 0, one("$", a, "x^{", b, "}+", b, r"^\circ$")).when(b % 3 == 1, one(r"\angle \mathrm{AB}=", a, " cc")).otherwise(one("-", a, "_{i+", b, "}가나"))
    return table(spark, d, "orders").select("o_orderkey", F.round(measures.label_widths(label), 6).alias("width"))


@query(r"""WITH o AS (SELECT o_orderkey AS k, 683 * length(o_custkey::VARCHAR) AS a, 683 * length(o_orderkey::VARCHAR) AS b, o_orderkey % 3 AS kind FROM orders)
SELECT k AS o_orderkey, greatest(400, floor(0.8076 * CASE kind WHEN 0 THEN 0.75 * greatest(0.75 * greatest(a, b) + 400, a) + 400 + 811 + 0.5 * b + 583 + 100 WHEN 1 THEN a + 500 + 541 + 100 ELSE a + 2 * 1800 + 2 * 600 + 833 + 100 + b END + 394))::INT AS width, CASE kind WHEN 0 THEN 2400 ELSE 1200 END::INT AS height FROM o""")
def equation_sizes(spark, d):
    """Sizes of equations: a fraction in a fraction, words, brackets that grow."""
    a, b = F.col("o_custkey"), F.col("o_orderkey")
    one = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    script = F.when(b % 3 == 0, one("{{", a, "} over {", b, "}} over {", a, "} TIMES x ^{", b, "}")).when(b % 3 == 1, one(a, " alpha g")).otherwise(one("LEFT ( ", a, "+", b, " RIGHT )"))
    size = measures.equation_sizes(script)
    return table(spark, d, "orders").select("o_orderkey", size.alias("s")).select("o_orderkey", "s.width", "s.height")
