"""Queries of column functions over words and numbers of the tables: names, marks, answers, markup, boxes.

Words of documents are read as Hangul, letter by letter, so that names and sentences differ from row to row; the SQL
twins build the same inputs and work the results out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import answers, exams, jsonfix, names
from foliant.functions import text as tx
from foliant.operators import ordered
from foliant.plans.registry import query, table

LATIN, HANGUL = "abcdefghijklmnopqrstuvwxyz", "가나다라마바사아자차카타파하거너더러머버서어저처커터"
#: Documents with their words in Hangul, at least three, as SQL and as rows.
WORDS = f"""SELECT doc_id AS i, n_chars AS n, lang, source, text, list_concat(list_filter(string_split_regex(translate(lower(text), '{LATIN}', '{HANGUL}'), '[^가-힣]+'), lambda x: x <> ''), ['가나다', '나라', '마바사']) AS w FROM documents WHERE text IS NOT NULL"""


def worded(spark, d):
    read = F.filter(F.split(F.translate(F.lower("text"), LATIN, HANGUL), "[^가-힣]+"), lambda x: x != "")
    return table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("i"), F.col("n_chars").alias("n"), "lang", "source", "text", F.concat(read, F.array(*map(F.lit, ("가나다", "나라", "마바사")))).alias("w"))


def w(k: int) -> Column:
    return F.get("w", F.lit(k - 1))


def text(*parts) -> Column:
    """Parts one after the other; texts stand for themselves."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def one_of(key: Column, *values) -> Column:
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (key % len(values) + 1).cast("int"))


def shown(spark, d, **columns: Column):
    return worded(spark, d).select(F.col("i").alias("doc_id"), *[c.alias(k) for k, c in columns.items()])


# Marks


@query(f"""WITH h AS ({WORDS}), x AS (SELECT i, chr(10) || ' ' || translate((n::VARCHAR)[:1 + (i % 2)::INT], '123456789', '①②③④⑤⑥⑦⑧⑨') || chr(160) AS a FROM h)
SELECT i AS doc_id, regexp_full_match(a, '[{tx.SPACE}]*[①-⑩][{tx.SPACE}]*') AS single FROM x""")
def single_choices(spark, d):
    digits = F.expr("substring(cast(n as string), 1, cast(1 + i % 2 as int))")
    return shown(spark, d, single=tx.single_choice(text("\n ", F.translate(digits, "123456789", "①②③④⑤⑥⑦⑧⑨"), " ")))


@query(rf"""WITH h AS ({WORDS}), x AS (SELECT i, ['', '(가) ', '① ', '[조건] ', 'ㄱ. ', ' [서술형] '][1 + i % 6] || array_to_string(w[:1 + (n % 9)::INT], ' ') || CASE WHEN n % 5 = 0 THEN ' | ' WHEN n % 7 = 0 THEN ' a_1+b_2=c^3-2' || n ELSE '' END AS s FROM h),
y AS (SELECT *, regexp_replace(s, '\s+', '', 'g') AS c FROM x)
SELECT i AS doc_id, NOT contains(s, '|') AND NOT regexp_matches(s, '^\s*(?:\(\s*[가나다라마바0-9]+\s*\)|[①-⑮]|[ㄱ-ㅎ]\s*[.)]|\[\s*(?:서술형|서답형|조건|보기)[^가-힣\w])') AND length(regexp_replace(c, '[^가-힣]', '', 'g')) >= 0.55 * length(c) AS prose FROM y""")
def recoverable_prose(spark, d):
    i, n = F.col("i"), F.col("n")
    tail = F.when(n % 5 == 0, " | ").when(n % 7 == 0, text(" a_1+b_2=c^3-2", n)).otherwise("")
    return shown(spark, d, prose=exams.recoverable_prose(text(one_of(i, "", "(가) ", "① ", "[조건] ", "ㄱ. ", " [서술형] "), F.array_join(F.slice("w", F.lit(1), (1 + n % 9).cast("int")), " "), tail)))


@query(f"""WITH h AS ({WORDS}), x AS (SELECT i, 400 + n % 200 AS width, 450 + n % 90 AS height, n % 150 AS sharp, (n % 20) / 10.0 AS ink, n % 60 AS contrast FROM h)
SELECT i AS doc_id, greatest(0.0, 100.0 - CASE WHEN width < 500 OR height < 500 THEN 30 ELSE 0 END - CASE WHEN sharp < 100 THEN 40 ELSE 0 END - CASE WHEN ink < 1 THEN 50 ELSE 0 END - CASE WHEN contrast < 30 THEN 25 ELSE 0 END)::DOUBLE AS score,
 concat_ws(',', CASE WHEN width < 500 OR height < 500 THEN 'small' END, CASE WHEN sharp < 100 THEN 'blurred' END, CASE WHEN ink < 1 THEN 'blank' END, CASE WHEN contrast < 30 THEN 'faded' END) AS reasons FROM x""")
def page_quality(spark, d):
    n = F.col("n")
    q = exams.page_quality(400 + n % 200, 450 + n % 90, (n % 150).cast("double"), (n % 20) / 10.0, (n % 60).cast("double"))
    return shown(spark, d, score=q["score"], reasons=F.array_join(q["reasons"], ","))


@query(rf"""WITH h AS ({WORDS}), x AS (SELECT i, n % 4 = 0 AS choices, CASE WHEN n % 3 = 0 THEN n % 2 END AS score, CASE WHEN n % 11 > 0 THEN n % 5 END AS number, CASE WHEN n % 7 = 0 THEN '[서답형 ' || n % 9 || '] ' ELSE '' END || w[1] AS stem, CASE WHEN n % 6 = 1 THEN lang WHEN n % 6 = 2 THEN ' ' END AS label, [i % 5, n % 3] AS earlier FROM h)
SELECT i AS doc_id, NOT (choices OR coalesce(score, 0) <> 0 OR trim(coalesce(label, '')) <> '' OR coalesce(number > 0 AND NOT list_contains(earlier, number), false) OR regexp_matches(stem, '[\[【]\s*(서술형|서답형|단답형)\s*\d*\s*[\]】]')) AS fragment FROM x""")
def answer_fragments(spark, d):
    i, n, lang = F.col("i"), F.col("n"), F.col("lang")
    stem = text(F.when(n % 7 == 0, text("[서답형 ", n % 9, "] ")).otherwise(""), w(1))
    label = F.when(n % 6 == 1, lang).when(n % 6 == 2, " ")
    return shown(spark, d, fragment=ordered.answer_fragment(n % 4 == 0, F.when(n % 3 == 0, n % 2).cast("double"), F.when(n % 11 > 0, n % 5), stem, label, F.array(i % 5, n % 3)))


# Names


SUFFIXES = ["고", "여고", "중", "여중", "고사", "원"]
SCHOOL = f"{SUFFIXES}[1 + i % 6]"


@query(f"""WITH h AS ({WORDS}), x AS (SELECT i, '20' || 10 + n % 15 || '년 ' || 1 + n % 2 || '학기 [' || w[1][:1 + (n % 4)::INT] || {SCHOOL} || '] ' || w[2] || CASE WHEN n % 2 = 0 THEN '중간고사' ELSE ' 대비' END AS t FROM h)
SELECT i AS doc_id, nullif(regexp_extract(regexp_replace(t, '20\\d{{2}}\\s*년?(?:도)?|\\d\\s*학기|중간고사|기말고사|중간|기말|대비|고사', ' ', 'g'), '([가-힣]{{2,10}}(?:여고|여중|고|중))(?:[^사]|$)', 1), '') AS school FROM x""")
def schools_found(spark, d):
    i, n = F.col("i"), F.col("n")
    own = F.expr("substring(w[0], 1, cast(1 + n % 4 as int))")
    return shown(spark, d, school=names.find_school(text("20", 10 + n % 15, "년 ", 1 + n % 2, "학기 [", own, one_of(i, *SUFFIXES), "] ", w(2), F.when(n % 2 == 0, "중간고사").otherwise(" 대비"))))


NORMED = "replace(replace(replace(regexp_replace(regexp_replace({0}, '\\s+', '', 'g'), '등학교$', ''), '학교', ''), '여자고', '여고'), '여자중', '여중')"


@query(f"""WITH h AS ({WORDS}), x AS (SELECT i, w[1] || ' ' || ['여자고등학교', '고등학교', '중학교', '여자 중학교'][1 + i % 4] AS a, CASE WHEN n % 4 = 0 THEN '' WHEN n % 4 = 1 THEN w[2] ELSE right(w[1], 2) END || ['여고', '고', '중', '여중'][1 + (i + (n % 3 = 0)::INT) % 4] AS b FROM h), y AS (SELECT i, {NORMED.format('a')} AS a, {NORMED.format('b')} AS b FROM x)
SELECT i AS doc_id, a AS school, a = '' OR b = '' OR ends_with(a, b) OR ends_with(b, a) AS same FROM y""")
def schools_same(spark, d):
    i, n = F.col("i"), F.col("n")
    a = text(w(1), " ", one_of(i, "여자고등학교", "고등학교", "중학교", "여자 중학교"))
    b = text(F.when(n % 4 == 0, "").when(n % 4 == 1, w(2)).otherwise(F.right(w(1), F.lit(2))), one_of(i + (n % 3 == 0).cast("int"), "여고", "고", "중", "여중"))
    return shown(spark, d, school=names.norm_school(a), same=names.same_school(a, b))


@query(rf"""WITH h AS ({WORDS}), x AS (SELECT i, CASE WHEN n % 3 = 0 THEN w[2] || ' ' || ['고', '중', '수'][1 + i % 3] || ' ' || n % 5 || '.hwp' ELSE '/중1/[' || w[1] || {SCHOOL} || '][ ' || n % 4 || ' ] 고' || i % 5 || '.pdf' END AS t, w[1] || {SCHOOL} AS s FROM h),
y AS (SELECT *, regexp_extract(t, '([^/]*)$', 1) AS b FROM x), z AS (SELECT *, regexp_extract(b, '^\s*\[([^\]]*)\]\s*\[\s*([1-3])\s*\]', 1) AS head, regexp_extract(b, '^\s*\[([^\]]*)\]\s*\[\s*([1-3])\s*\]', 2) AS number FROM y)
SELECT i AS doc_id, CASE WHEN regexp_matches(head, '[중고]') THEN regexp_extract(head, '^.*([중고])', 1) || number ELSE regexp_extract(b, '(중|고)\s*([1-3])', 1) || regexp_extract(b, '(중|고)\s*([1-3])', 2) END AS grade, regexp_extract(s, '^.*([중고])', 1) AS level FROM z""")
def grades(spark, d):
    i, n = F.col("i"), F.col("n")
    s = text(w(1), one_of(i, *SUFFIXES))
    t = F.when(n % 3 == 0, text(w(2), " ", one_of(i, "고", "중", "수"), " ", n % 5, ".hwp")).otherwise(text("/중1/[", s, "][ ", n % 4, " ] 고", i % 5, ".pdf"))
    return shown(spark, d, grade=names.grade_of(t), level=names.school_level(s))


TOKENS = ["수학1", "공수1", "기하", "확통", "낱말", "수2"]


@query(f"""WITH h AS ({WORDS}), x AS (SELECT i, w[1] || CASE WHEN n % 3 = 0 THEN '중' WHEN n % 3 = 1 THEN '고' ELSE '원' END AS school, (n % 4)::VARCHAR AS g, {TOKENS}[1 + i % 6] AS token, CASE WHEN n % 5 = 0 THEN '20' ELSE '' END || 20 + n % 7 AS year, 1 + n % 2 AS term, CASE WHEN n % 2 = 0 THEN '중간' ELSE '기말' END AS part FROM h),
y AS (SELECT *, right(school, 1) AS level, right(school, 1) IN ('중', '고') AND g IN ('1', '2', '3') AS known, map {{'수학1': '대수', '공수1': '공통수학1', '기하': '기하', '확통': '확률과통계', '수2': '미적분1'}}[token] AS standard FROM x),
z AS (SELECT *, CASE WHEN level = '중' THEN '수학' WHEN standard IS NULL THEN '' ELSE token END AS subject, level = '고' AND standard IS NOT NULL AND standard <> '공통수학1' AS own FROM y)
SELECT i AS doc_id, known AND subject <> '' AS valid, CASE WHEN known THEN level || g ELSE '' END AS grade, CASE WHEN known THEN '20' || right(year, 2) ELSE '' END AS year, CASE WHEN known AND own THEN standard ELSE '' END AS form_subject,
 CASE WHEN known AND own THEN CASE standard WHEN '대수' THEN '수1' WHEN '미적분1' THEN '수2' ELSE '선택과목' END ELSE '' END AS form_subtag, CASE WHEN known THEN subject ELSE '' END AS subject FROM z""")
def form_fields(spark, d):
    i, n = F.col("i"), F.col("n")
    school = text(w(1), F.when(n % 3 == 0, "중").when(n % 3 == 1, "고").otherwise("원"))
    term = text(F.when(n % 5 == 0, "20").otherwise(""), 20 + n % 7, "-", 1 + n % 2, "-", F.when(n % 2 == 0, "중간").otherwise("기말"))
    f = names.filled(text("/x/[", school, "][", n % 4, "][", one_of(i, *TOKENS), "][", term, "][", w(2), "].pdf"))
    return shown(spark, d, **{c: f[c] for c in ("valid", "grade", "year", "form_subject", "form_subtag", "subject")})


@query(f"""WITH h AS ({WORDS}), x AS (SELECT i, CASE WHEN n % 4 = 0 THEN '' ELSE ['중', '고'][1 + n % 2] || 1 + n % 3 END AS grade, CASE WHEN i % 3 = 0 THEN '' ELSE ['수1', '기하', w[2]][1 + i % 3] END AS tag, w[1] AS color, 10 + n % 17 AS gen, n % 2 = 0 AS colored FROM h),
y AS (SELECT *, '[' || gen || '년 폼지(1.2)] (' || trim(grade || ' ' || tag) || ')' || CASE WHEN colored THEN ' (' || color || ')' ELSE '' END AS stem, coalesce(map {{'수1': '대수', '기하': '기하'}}[tag], tag) AS key FROM x),
z AS (SELECT *, grade <> '' OR key IN ('대수', '기하') AS known FROM y)
SELECT i AS doc_id, grade, CASE WHEN known THEN key ELSE '' END AS subject, CASE WHEN known AND trim(grade || ' ' || tag) <> '' THEN trim(grade || ' ' || tag) ELSE stem END || CASE WHEN colored THEN ' (' || color || ')' ELSE '' END AS display, gen AS year FROM z""")
def form_names(spark, d):
    i, n = F.col("i"), F.col("n")
    grade = F.when(n % 4 == 0, "").otherwise(text(one_of(n, "중", "고"), 1 + n % 3))
    tag = F.when(i % 3 == 0, "").otherwise(one_of(i, "수1", "기하", w(2)))
    f = names.form(text("/f/[", 10 + n % 17, "년 폼지(1.2)] (", F.trim(text(grade, " ", tag)), ")", F.when(n % 2 == 0, text(" (", w(1), ")")).otherwise(""), ".hwp"))
    return shown(spark, d, grade=f["grade"], subject=f["subject"], display=f["display"], year=f["generation"]["year"].cast("long"))


# Texts


@query(f"""WITH h AS ({WORDS}), x AS (SELECT i, CASE WHEN n % 3 = 0 THEN (1990 + n % 60)::VARCHAR ELSE lpad((n % 100)::VARCHAR, 2, '0') END || '년' AS y, n % 4 AS g, n FROM h), z AS (SELECT *, regexp_extract(y, '(\\d{{2,4}})', 1)::INT AS v FROM x)
SELECT i AS doc_id, CASE WHEN v < 100 THEN v + 2000 ELSE v END AS year, CASE WHEN g = 0 THEN false ELSE CASE WHEN v < 100 THEN v + 2000 ELSE v END < 2024 + g END AS old, 2000 + n % 100 AS full FROM z""")
def years(spark, d):
    n = F.col("n")
    y = text(F.when(n % 3 == 0, (1990 + n % 60).cast("string")).otherwise(F.lpad((n % 100).cast("string"), 2, "0")), "년")
    return shown(spark, d, year=exams.year_of(y), old=exams.old_curriculum(text("고", n % 4), y), full=tx.full_year(n % 100))


@query(r"WITH h AS (" + WORDS + r""") SELECT i AS doc_id, regexp_replace(w[1] || chr(7) || w[2] || chr(9) || lang || chr(31) || chr(10), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS clean, '\frac' || w[2] || '\' || lang AS single, 2 * length(w[1]) + length(lang) + 2 * length(w[3]) AS width FROM h""")
def scrubs(spark, d):
    lang = F.col("lang")
    return shown(spark, d, clean=tx.scrubbed(text(w(1), "\x07", w(2), "\t", lang, "\x1f\n")), single=tx.single_backslashes(text("\\\\\\frac", w(2), "\\\\", lang)), width=exams.display_width(text(w(1), lang, w(3))))


def brace_words(opening: str, closing: str) -> str:
    return f"array_to_string(list_transform(w[:4], lambda x, k: CASE WHEN (n // k) % 3 = 0 THEN x WHEN (n // k) % 3 = 1 THEN '{opening}' || x ELSE x || '{closing}' END), ' ')"


@query(rf"""WITH h AS ({WORDS}), s AS (SELECT i, {brace_words('{', '}')} AS t, list_transform(w[:4], lambda x, k: CASE WHEN (n // k) % 3 = 1 THEN 1 WHEN (n // k) % 3 = 2 THEN -1 ELSE 0 END) AS m, w[:4] AS w FROM h),
r AS (SELECT *, list_transform(m, lambda v, k: CASE WHEN v = 1 THEN len(list_filter(range(k + 1, len(m) + 1), lambda j: m[j] = -1 AND list_sum(m[k:j]) = 0 AND list_min(list_transform(range(k, j), lambda q: list_sum(m[k:q]))) > 0)) > 0
 WHEN v = -1 THEN len(list_filter(range(1, k), lambda j: m[j] = 1 AND list_sum(m[j:k]) = 0 AND list_min(list_transform(range(j, k), lambda q: list_sum(m[j:q]))) > 0)) > 0 ELSE true END) AS paired FROM s)
SELECT i AS doc_id, array_to_string(list_transform(w, lambda x, k: CASE m[k] WHEN 1 THEN CASE WHEN paired[k] THEN '{{' ELSE '\{{' END || x WHEN -1 THEN x || CASE WHEN paired[k] THEN '}}' ELSE '\}}' END ELSE x END), ' ') AS t FROM r""")
def braces_escaped(spark, d):
    n = F.col("n")
    word = lambda x, k: F.when(F.floor(n / (k + 1)) % 3 == 0, x).when(F.floor(n / (k + 1)) % 3 == 1, F.concat(F.lit("{"), x)).otherwise(F.concat(x, F.lit("}")))
    return shown(spark, d, t=jsonfix.braces_escaped(F.array_join(F.transform(F.slice("w", 1, 4), word), " ")))


@query(rf"""WITH h AS ({WORDS}), x AS (SELECT i, n, w, CASE i % 5 WHEN 0 THEN n % 40 || '. ' || w[1] || ' ' || n % 13 WHEN 1 THEN '[서술형 ' || n % 5 || '] ' || ['①', '②', '③', '④', '⑤'][1 + n % 5] || '번' WHEN 2 THEN '[보기 오류] ' || n WHEN 3 THEN '[문제 오류] ' || array_to_string(w[:6], ' ') ELSE '\( ' || w[1] || ' \)' END AS raw, i % 10 < 7 AS choice FROM h),
d AS (SELECT *, trim(regexp_extract(raw, '(?s)^\[문제 오류\]\s*(.*)$', 1)) AS details FROM x), c AS (SELECT *, CASE WHEN regexp_matches(details[:16], '^.{{6,}} [^ ]*$') THEN regexp_extract(details[:16], '(?s)^(.{{6,}}) [^ ]*$', 1) ELSE details[:16] END AS cut FROM d)
SELECT i AS doc_id, CASE i % 5 WHEN 0 THEN CASE WHEN choice AND n % 13 BETWEEN 1 AND 10 THEN '①②③④⑤⑥⑦⑧⑨⑩'[(n % 13)::INT] ELSE w[1] || ' ' || n % 13 END WHEN 1 THEN CASE WHEN choice THEN ['①', '②', '③', '④', '⑤'][1 + n % 5] ELSE ['①', '②', '③', '④', '⑤'][1 + n % 5] || '번' END
 WHEN 2 THEN '[보기 오류] $' || n || '$' WHEN 3 THEN '[문제 오류] ' || CASE WHEN length(details) > 16 THEN rtrim(cut) || '…' ELSE details END ELSE '$' || w[1] || '$' END AS t FROM c""")
def answers_normalised(spark, d):
    i, n = F.col("i"), F.col("n")
    raw = one_of(i, text(n % 40, ". ", w(1), " ", n % 13), text("[서술형 ", n % 5, "] ", one_of(n, *"①②③④⑤"), "번"), text("[보기 오류] ", n), text("[문제 오류] ", F.array_join(F.slice("w", 1, 6), " ")), text("\\( ", w(1), " \\)"))
    return shown(spark, d, t=exams.answer_text(raw, i % 10 < 7))


@query(rf"""WITH h AS ({WORDS}), x AS (SELECT *, trim(regexp_replace('[ ' || w[1] || chr(10) || ' (' || w[2] || ') ' || repeat(w[3] || ' ', (n % 12)::INT) || ']', '\s+', ' ', 'g')) AS p FROM h)
SELECT i AS doc_id, w[1] || ' $' || w[2] || '$ ' || CASE WHEN n % 2 = 0 THEN '$' || w[3] || ' x$' ELSE '' END AS maths, array_to_string(list_filter([w[1], CASE WHEN n % 3 > 0 THEN w[2] END, lang], lambda v: v IS NOT NULL), chr(10)) AS solution,
 CASE WHEN n % 4 < 3 THEN ['상', '중', '하'][1 + n % 4] ELSE '' END AS difficulty, regexp_replace(p, '^[\[\]()<> ]+|[\[\]()<> ]+$', '', 'g')[:40] AS topic FROM x""")
def solutions_normalised(spark, d):
    n, lang = F.col("n"), F.col("lang")
    maths = text(w(1), " \\( ", w(2), " \\) ", F.when(n % 2 == 0, text("$$ ", w(3), "\n x $$")).otherwise(""))
    solution = text("```\n ", w(1), " \n\n", F.when(n % 3 > 0, w(2)).otherwise("  "), "\n", lang, "\n```")
    level = F.when(n % 4 < 3, text(" ", one_of(n % 4, "상", "중", "하"), "\n")).otherwise(w(1))
    topic = text("[ ", w(1), "\n (", w(2), ") ", F.repeat(text(w(3), " "), (n % 12).cast("int")), "]")
    return shown(spark, d, maths=exams.maths_inline(maths), solution=exams.solution_text(solution), difficulty=exams.difficulty(level), topic=exams.topic(topic))


@query(rf"""WITH h AS ({WORDS}), x AS (SELECT i, '<t>' || w[1] || CASE WHEN n % 2 = 0 THEN ' (정답)' ELSE ' 정답 ' || w[2] END || '</t>' || CASE WHEN n % 3 = 0 THEN '[서답형 ' || n % 9 || '] ' ELSE '' END || CASE WHEN n % 5 < 2 THEN '[ 서술형 1] ' ELSE '' END || CASE WHEN n % 7 = 0 THEN '[' || n % 5 || '점]' || repeat(' ', (n % 8)::INT) || '[4점]' ELSE '' END || CASE WHEN n % 11 = 0 THEN '<hp:t a="b">ㄱ</hp:t>' ELSE '' END AS t FROM h), p AS (SELECT *, regexp_replace(t, '<[^>]+>', '', 'g') AS plain FROM x)
SELECT i AS doc_id, concat_ws(',', CASE WHEN regexp_matches(t, '<hp:t[^>]*>[\x{{3130}}-\x{{318F}}]</hp:t>') THEN 'lone letter' END, CASE WHEN contains(plain, '[서답형') AND regexp_matches(plain, '\[\s*서술형') THEN 'two spellings' END, CASE WHEN NOT contains(replace(plain, '(정답)', ''), '정답') THEN 'no answers' END, CASE WHEN regexp_matches(plain, '\[\s*\d+\s*점\s*\][^<\[]{{0,4}}\[\s*\d+\s*점\s*\]') THEN 'score twice' END) AS found FROM p""")
def markup_lint(spark, d):
    n = F.col("n")
    t = text(
        "<t>", w(1), F.when(n % 2 == 0, " (정답)").otherwise(text(" 정답 ", w(2))), "</t>", F.when(n % 3 == 0, text("[서답형 ", n % 9, "] ")).otherwise(""), F.when(n % 5 < 2, "[ 서술형 1] ").otherwise(""),
        F.when(n % 7 == 0, text("[", n % 5, "점]", F.repeat(F.lit(" "), (n % 8).cast("int")), "[4점]")).otherwise(""), F.when(n % 11 == 0, '<hp:t a="b">ㄱ</hp:t>').otherwise(""),
    )
    return shown(spark, d, found=F.array_join(exams.markup_findings(t), ","))


@query(f"""WITH h AS ({WORDS}), x AS (SELECT *, list_transform(range(1, 2 + n % 3), lambda k: [w[k], lang, (n // k)::VARCHAR]) AS rows FROM h)
SELECT i AS doc_id, array_to_string(list_transform(rows, lambda r: array_to_string(r, ',')), ';') AS rows, len(rows)::INT AS n_rows, array_to_string(list_transform(rows[1:1], lambda r: array_to_string(r, ' | ')), '') AS first FROM x""")
def markdown_tables(spark, d):
    """Rows written as Markdown, with a line under the first, and read back."""
    n, lang = F.col("n"), F.col("lang")
    rows = F.transform(F.sequence(F.lit(1), (1 + n % 3).cast("int")), lambda k: F.array(F.element_at("w", k), lang, F.floor(n / k).cast("string")))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " |  "), F.lit(" |")))
    read = tx.markdown_rows(F.concat(F.get(lines, F.lit(0)), F.lit("\n|---|:-:|--:|\n"), F.array_join(F.slice(lines, 2, 9), "\n")))
    return shown(spark, d, rows=F.array_join(F.transform(read, lambda r: F.array_join(r, ",")), ";"), n_rows=F.size(read), first=tx.table_markdown(F.slice(rows, 1, 1)))


@query(rf"""WITH h AS ({WORDS}), x AS (SELECT *, CASE WHEN n % 2 = 0 THEN ['①', '②', '③'][1 + n % 3] ELSE '$' || w[1] || ' ' || n % 9 || '$' END AS ref, CASE WHEN n % 2 = 0 THEN w[2] || ['①', '②', '③'][1 + i % 3] || CASE WHEN n % 5 = 0 THEN ' ⑤' ELSE '' END ELSE CASE WHEN n % 3 = 0 THEN w[3] ELSE 'x = ' END || '\text{{' || w[1] || '}}' || n % 9 END AS got FROM h),
b AS (SELECT *, lower(regexp_replace(ref, '[\s$\\{{}},~]|mathrm|text|dfrac|frac', '', 'g')) AS r, lower(regexp_replace(got, '[\s$\\{{}},~]|mathrm|text|dfrac|frac', '', 'g')) AS g FROM x)
SELECT i AS doc_id, CASE WHEN n % 2 = 0 THEN len(regexp_extract_all(got, '[①-⑤]')) = 1 AND contains(got, ref) ELSE contains(g, r) OR contains(r, g) END AS graded, w[1] || '|2' || n % 7 || '-' || 1 + n % 2 || '-중간' AS key, replace(w[1] || chr(57344) || w[2], chr(57344), '1/2') AS decoded FROM b""")
def small_functions(spark, d):
    i, n, lang = F.col("i"), F.col("n"), F.col("lang")
    reference = F.when(n % 2 == 0, one_of(n, *"①②③")).otherwise(text("$", w(1), " ", n % 9, "$"))
    got = F.when(n % 2 == 0, text(w(2), one_of(i, *"①②③"), F.when(n % 5 == 0, " ⑤").otherwise(""))).otherwise(text(F.when(n % 3 == 0, w(3)).otherwise("x = "), "\\text{", w(1), "}", n % 9))
    key = exams.term_key(text("[", w(1), "][2][2", n % 7, "-", 1 + n % 2, "-중간] ", lang))
    return shown(spark, d, graded=exams.graded(reference, got, n % 2 == 0), key=key, decoded=tx.decoded(text(w(1), "", w(2)), {"": "1/2"}))


@query(f"""WITH h AS ({WORDS}), x AS (SELECT i, n, n % 1100 - 50 AS x0, n % 700 AS y0, n % 1100 - 50 + i % 400 AS x1, n % 700 + n % 90 AS y1 FROM h), c AS (SELECT *, greatest(0, least(1, x0 / 1000)) AS a, greatest(0, least(1, y0 / 1000)) AS b, greatest(0, least(1, x1 / 1000)) AS c, greatest(0, least(1, y1 / 1000)) AS e FROM x)
SELECT i AS doc_id, CASE WHEN c - a > 0.02 AND e - b > 0.02 THEN 1 ELSE 0 END AS boxes, CASE WHEN c - a > 0.02 AND e - b > 0.02 THEN round(a, 6)::DOUBLE END AS x0, CASE WHEN c - a > 0.02 AND e - b > 0.02 THEN CASE WHEN n % 2 = 0 THEN 'figure' ELSE 'problem' END END AS kind, CASE WHEN i % 2 = 0 THEN n::VARCHAR ELSE n || '.5' END AS number FROM c""")
def crop_boxes(spark, d):
    """Boxes on a grid of a thousand, y first, or as shares, x first; what lies beyond the page is cut, slivers go."""
    i, n = F.col("i"), F.col("n")
    x0, y0 = n % 1100 - 50, n % 700
    x1, y1 = x0 + i % 400, y0 + n % 90
    grid = text('so {"items": [{"cropBox": [', F.concat_ws(",", *[c.cast("string") for c in (y0, x0, y1, x1)]), ']', F.when(n % 2 == 0, ', "class": "figure"').otherwise(""), '}]} end')
    old = text('{"crops": [{"bbox": [', F.concat_ws(",", *[(c / 1000).cast("string") for c in (x0, y0, x1, y1)]), ']', F.when(n % 2 == 0, ', "kind": "figure"').otherwise(""), '}, {"bbox": [1]}]}')
    boxes = exams.crop_boxes(F.when(i % 3 == 0, old).otherwise(grid))
    first = F.get(boxes, F.lit(0))
    return shown(spark, d, boxes=F.size(boxes), x0=F.round(first["x0"], 6), kind=first["kind"], number=exams.number_text(F.when(i % 2 == 0, n.cast("double")).otherwise(n + 0.5)))


@query("""WITH r AS (SELECT doc_id, 1.0 * (n_chars % 50) AS a, 10.0 + doc_id % 30 AS u, 1.0 * (doc_id % 40) AS b, 5.0 + n_chars % 20 AS v FROM documents), o AS (SELECT *, greatest(0, least(a + u, b + v) - greatest(a, b)) * greatest(0, least(u, v) - 2) AS shared, least(u * u, v * (v - 2)) AS area FROM r)
SELECT doc_id, round(shared / area, 6)::DOUBLE AS share FROM o""")
def box_overlaps(spark, d):
    """Of a square and a box that begins two units lower, the shared part of the smaller."""
    r = table(spark, d, "documents")
    a, u, b, v = (x.cast("double") for x in (F.col("n_chars") % 50, 10 + F.col("doc_id") % 30, F.col("doc_id") % 40, 5 + F.col("n_chars") % 20))
    share = ordered.overlap_share([a, F.lit(0.0), a + u, u], [b, F.lit(2.0), b + v, v])
    return r.select("doc_id", F.round(share, 6).alias("share"))


@query(rf"""WITH h AS ({WORDS}) SELECT i AS doc_id, '{{"sub_questions":[{{"label_type":"' || w[1] || '","' || source || 'Key":' || n || '}}],"' || lang || '":"labelType"}}' AS t FROM h""")
def payload_keys(spark, d):
    """Keys that are known by another spelling get it, other keys and values stay."""
    n, lang, source = F.col("n"), F.col("lang"), F.col("source")
    raw = text('{"subQuestions":[{"labelType":"', w(1), '","', source, 'Key":', n, '}],"', lang, '":"labelType"}')
    return shown(spark, d, t=tx.snake_keys(raw, ["sub_questions", "label_type", "other"]))


@query(f"""WITH h AS ({WORDS}), u AS (SELECT i, unnest(w[:12]) AS x, unnest(range(1, 1 + len(w[:12]))) AS k FROM h), f AS (SELECT i, x, min(k) AS k FROM u GROUP BY ALL) SELECT i AS doc_id, string_agg(x, ',' ORDER BY k) AS tags FROM f GROUP BY 1""")
def tags_in_order(spark, d):
    """Repeated words go, the first of each stays where it was."""
    return shown(spark, d, tags=F.array_join(F.array_distinct(F.slice("w", 1, 12)), ","))


# Answers


@query(rf"""WITH h AS ({WORDS}), x AS (SELECT i, n, w, CASE i % 4 WHEN 0 THEN 'P(' || n % 90 || ', ' || i % 9 || ')' WHEN 1 THEN 'f(x) = ' || n || ' = ' || n % 77 WHEN 2 THEN 'x \le ' || n || '=2' ELSE '$x^{{' || n % 10 || '}}$ (즉 ' || w[1] || ')' END AS a FROM h),
b AS (SELECT *, CASE i % 4 WHEN 0 THEN '(' || n % 90 || ',' || i % 9 || ')' WHEN 1 THEN regexp_replace(a, '\s', '', 'g') WHEN 2 THEN 'x\leq' || n || '=2' ELSE 'x^' || n % 10 END AS bare FROM x)
SELECT i AS doc_id, CASE WHEN contains(bare, '\leq') THEN bare ELSE regexp_extract(bare, '([^=]*)$', 1) END AS v, regexp_replace(trim(a), '\s*\([^()]*\)\s*$', '') AS core, CASE i % 4 WHEN 3 THEN 'x^{{' || n % 10 || '}} | ' || w[1] ELSE regexp_replace(trim(a), '\s+', ' ', 'g') END AS declared FROM b""")
def answer_forms(spark, d):
    i, n = F.col("i"), F.col("n")
    a = one_of(i, text("P(", n % 90, ", ", i % 9, ")"), text("f(x) = ", n, " = ", n % 77), text("x \\le ", n, "=2"), text("$x^{", n % 10, "}$ (즉 ", w(1), ")"))
    return shown(spark, d, v=answers.final_value(answers.bare_notation(a)), core=answers.core(a), declared=F.array_join(answers.equivalents(a), "|"))


@query(rf"""WITH h AS ({WORDS}), x AS (SELECT i, n % 5 AS a, (n // 5) % 5 AS b, (i + n) % 5 AS c, i % 5 AS e FROM h)
SELECT i AS doc_id, (a = c AND b = e) AS same, a = b AS factors FROM x""")
def answer_parts(spark, d):
    """Answers of two parts agree part by part; the order of bracketed factors does not matter, what stands in them does."""
    i, n = F.col("i"), F.col("n")
    a, b, c, e = n % 5, F.floor(n / 5) % 5, (i + n) % 5, i % 5
    left, right = text("(1) x=", a, " (2) (t+", b, ")(t-1)"), text("(1) ", c, " (2) (t-1)(t+", e, ")")
    return shown(spark, d, same=answers.same_answer(left, right), factors=answers.same_answer(text("(u+", a, ")(", w(1), ")"), text("(", w(1), ")(u+", b, ")")))
