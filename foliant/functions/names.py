"""Metadata from file names, in three formats: bracketed with a term token (A), older bracketed tokens (B), underscores (C); schools in titles; names of forms and of what is filled into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let

#: Patterns of the formats, and what is no exam.
TERM = r"^(?:20)?(\d{2})\s*년?\s*[-.]?\s*([12])\s*학?기?\s*[-.]?\s*(?:[12]\s*)?(중간|기말)"
TERM_REVERSED = r"^(?:20)?(\d{2})\s*[-.]\s*(중간|기말)\s*[-.]\s*([12])$"
UNDERSCORED = r"^(.+?(?:학교|고|중))_([1-3])학년_(20\d{2})_([12])학기(중간|기말)_([^_]*)"
NOT_EXAM_NAME = r"교사용|열람용|폼지|대수회|수준별|진도학습|편집자료|편집충돌|개념마스터|^\[정답\]|^\[해설\]|모의고사|라이트 본문|교재"
NOT_EXAM_PATH = r"교과서|개념마스터|연산교재|RPM|쎈\b|보드게임|악보|웨딩|BGM|타블 카드|내 그림|제작 툴|academy-app|Making|수익 프로젝트|4g SD|CAFE|WOW|경복궁|박세미|녹화본"
SUBJECTS = {
    "수학1": "수1", "수학I": "수1", "수I": "수1", "수학2": "수2", "수학II": "수2", "수II": "수2",
    "수학상": "수상", "수학(상)": "수상", "수(상)": "수상", "수학 상": "수상", "고등상": "수상",
    "수학하": "수하", "수학(하)": "수하", "수(하)": "수하",
    "미적": "미적분", "확률과통계": "확통", "확률과 통계": "확통",
    "공통수학1": "공수1", "공통수학2": "공수2", "공수": "공수1", "공통수학": "공수1",
    "심화수학1": "심화수학", "심수": "심화수학", "수힉": "수학",
}
KNOWN = ["수1", "수2", "수상", "수하", "확통", "미적분", "공수1", "공수2", "기하", "심화수학", "수학", "경제수학"]
#: Standard subjects of forms and the names they go by; those of the first grade have no form of their own, electives may share one.
STANDARD = {
    "공수1": "공통수학1", "공통수학1": "공통수학1", "수상": "공통수학1", "공수2": "공통수학2", "공통수학2": "공통수학2", "수하": "공통수학2",
    "수1": "대수", "수학1": "대수", "대수": "대수", "수2": "미적분1", "수학2": "미적분1", "미적분1": "미적분1", "미적1": "미적분1", "미적분I": "미적분1", "미적분Ⅰ": "미적분1",
    "미적분": "미적분2", "미적분2": "미적분2", "미적2": "미적분2", "미적분II": "미적분2", "미적분Ⅱ": "미적분2", "기하": "기하", "확통": "확률과통계", "확률과통계": "확률과통계",
}
FIRST_GRADE, ELECTIVES = ["공통수학1", "공통수학2"], ["미적분2", "기하", "확률과통계"]
FORM_SUBJECTS = ["대수", "미적분1", "선택과목", *ELECTIVES]
OLD_FORMS = {"대수": "수1", "미적분1": "수2"}
FORM_TERM = r"(\d{2,4})\s*[-_.]\s*([12])\s*[-_.]\s*(중간|기말)"
FORM_GENERATION = r"\[\s*(\d{2})\s*년[^\]]*?\(\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\)\s*\]"
#: Words around a school's name in titles, and what a school's name looks like.
TITLE_NOISE = r"20\d{2}\s*년?(?:도)?|\d\s*학기|중간고사|기말고사|중간|기말|대비|고사"
SCHOOL_NAME = r"(?!중간|기말|모의)([가-힣]{2,10}(?:여고|여중|고|중))(?!사)"
#: A form's kind (level, grade, subject) in brackets, what ends it, a color, a tag that is none; school and grade at a name's start, or written out.
FORM_KIND, FORM_FOR, FORM_COLOR, NO_COLOR = r"^\s*(?:(중|고)\s*([1-3]))?\s*(.*?)\s*$", "용$", "^[가-힣]+$", "개정"
SCHOOL_AND_GRADE, GRADE_WRITTEN = r"^\s*\[([^\]]*)\]\s*\[\s*([1-3])\s*\]", r"(중|고)\s*([1-3])"
IN_SQUARE, IN_ROUND = r"\[([^\]]*)\]", r"\(([^()]*)\)"
SCHOOLS = [("여자고등학교", "여고"), ("고등학교", "고"), ("여자중학교", "여중"), ("중학교", "중")]


def subject(x: Column) -> Column:
    s = F.trim(x)
    return F.when(x.isNull() | (x == ""), None).otherwise(F.coalesce(F.create_map(*[F.lit(v) for kv in SUBJECTS.items() for v in kv])[s], s))


def _part(x: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with columns that are worked out once a row: a generator makes them, as Spark writes a projection's columns out again in each filter that it moves before it."""
    return rows.select(*[c for c in rows.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parsed(files: DataFrame, path: str = "path") -> DataFrame:
    """files with fmt, school, grade, level, subject, year, semester, round, publisher, status of each path. fmt is A, B, C, or why there is none: notexam, unparsed, nobracket."""
    p = F.regexp_replace(F.coalesce(F.col(path), F.lit("")), r"\\", "/")
    d = _once(files, {"__name": F.regexp_replace(F.regexp_replace(p, r"^.*/", ""), r"(?<=.)\.[^.]*$", ""), "__parent": F.regexp_replace(p, r"/?[^/]*$", ""), "ext": F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1))})
    name = F.col("__name")
    d = _once(d, {"__t": F.transform(F.regexp_extract_all(name, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)), lambda x: F.trim(x))})
    t = F.col("__t")
    is_term = lambda x: x.rlike(TERM) | x.rlike(TERM_REVERSED)
    at = F.array_position(F.transform(t, is_term), True).cast("int")  # from 1, 0 where there is none
    d = _once(d, {"__at": at, "status": F.nullif(F.trim(F.regexp_extract(name, r"\(([^()]*)\)\s*$", 1)), F.lit(""))})
    at, term = F.col("__at"), F.col("__term")
    d = _once(d, {"__term": F.get(t, at - 1), "__c": (F.size(t) == 0) & name.rlike(UNDERSCORED)})
    d = _once(d, {"__straight": term.rlike(TERM)})
    straight = F.col("__straight")
    pick = lambda a, b: F.when(straight, _part(term, TERM, a)).otherwise(_part(term, TERM_REVERSED, b))
    before, second, after = F.get(t, at - 2), F.get(t, F.lit(1)), F.get(t, at)
    first = lambda keep: F.get(F.filter(t, keep), F.lit(0))
    of_b = (at == 0) & (F.size(t) > 0)
    year_b, grade_b, term_b = first(lambda x: x.rlike(r"^\d{2}$")), F.try_element_at(F.filter(t, lambda x: x.rlike("^[중고][1-3]$")), F.lit(-1)), F.try_element_at(F.filter(t, lambda x: x.rlike(r"^[12]학기\s*(중간|기말)$")), F.lit(-1))
    plain = lambda x: ~x.rlike(r"^\d{2}$") & ~x.rlike("^[중고][1-3]$") & ~x.rlike(r"^[12]학기\s*(중간|기말)$")
    is_school = lambda x: plain(x) & x.rlike("(고|중)$") & (F.length(x) >= 2)
    school_b = F.try_element_at(F.filter(t, is_school), F.lit(-1))
    subject_b = subject(F.try_element_at(F.filter(t, lambda x: plain(x) & ~is_school(x) & subject(x).isin(KNOWN)), F.lit(-1)))
    d = _once(d, {"__b": F.when(of_b, F.struct(year_b.alias("year"), grade_b.alias("grade"), term_b.alias("term"), school_b.alias("school"), subject_b.alias("subject")))})
    year_b, grade_b, term_b, school_b, subject_b = (F.col("__b")[c] for c in ("year", "grade", "term", "school", "subject"))
    school_c = _part(name, UNDERSCORED, 1)
    for long, short in SCHOOLS:
        school_c = F.replace(school_c, F.lit(long), F.lit(short))
    whole_b = year_b.isNotNull() & grade_b.isNotNull() & term_b.isNotNull() & school_b.isNotNull()
    fmt = (
        F.when(F.col("__parent").rlike(NOT_EXAM_PATH) | name.rlike(NOT_EXAM_NAME), "notexam")
        .when(F.col("__c"), "C")
        .when(F.size(t) == 0, "nobracket")
        .when(at > 0, "A")
        .when(whole_b, "B")
        .otherwise("unparsed")
    )
    by = lambda a, b, c: F.when(F.col("fmt") == "A", a).when(F.col("fmt") == "B", b).when(F.col("fmt") == "C", c)
    d = _once(d, {"fmt": fmt})
    d = _once(d, {"school": by(F.get(t, F.lit(0)), school_b, school_c)})
    school = F.col("school")
    d = _once(
        d,
        {
            "grade": by(F.when(second.rlike("^[1-3]$"), second), F.right(grade_b, F.lit(1)), _part(name, UNDERSCORED, 2)).cast("int"),
            "subject": by(F.when((at >= 2) & ~before.rlike("^[1-3]$"), subject(before)), subject_b, subject(_part(name, UNDERSCORED, 6))),
            "year": by(pick(1, 1).cast("int") + 2000, year_b.cast("int") + 2000, _part(name, UNDERSCORED, 3).cast("int")),
            "semester": by(pick(2, 3), F.left(term_b, F.lit(1)), _part(name, UNDERSCORED, 4)).cast("int"),
            "round": by(pick(3, 2), F.regexp_extract(term_b, "(중간|기말)$", 1), _part(name, UNDERSCORED, 5)),
            "publisher": by(after, F.lit(None), F.lit(None)),
            "level": F.coalesce(by(F.lit(None), F.left(grade_b, F.lit(1)), F.lit(None)), F.when(school.rlike("중$"), "중").when(school.rlike("고$"), "고")),
        },
    )
    d = d.withColumn("subject", F.when(F.col("subject").isNull() & (F.col("level") == "중"), "수학").otherwise(F.col("subject")))
    return d.drop("__name", "__parent", "__t", "__at", "__term", "__c", "__straight", "__b")


def valid(names: DataFrame, since: int = 2020) -> DataFrame:
    """Exams with all that identifies them, since a year."""
    some = F.col("fmt").isin("A", "B", "C") & (F.col("year") >= since) & (F.col("grade") > 0)
    for c in ("school", "round", "level"):
        some &= F.col(c).isNotNull() & (F.col(c) != "")
    return names.filter(some)


def find_school(title: Column) -> Column:
    """The first school's name in a title, words around it set aside; null where there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(F.coalesce(title, F.lit("")), TITLE_NOISE, " "), SCHOOL_NAME, 1), F.lit(""))


def norm_school(x: Column) -> Column:
    """A school's name in its short form."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", ""), "등학교$", "")
    for long, short in (("학교", ""), ("여자고", "여고"), ("여자중", "여중")):
        s = F.replace(s, F.lit(long), F.lit(short))
    return s


def same_school(a: Column, b: Column) -> Column:
    """Whether two names may be one school's: one ends with the other; an unknown one may be any."""
    x, y = norm_school(a), norm_school(b)
    return (x == "") | (y == "") | x.endswith(y) | y.endswith(x)


def school_level(school: Column) -> Column:
    """중 or 고 by whichever comes last in a school's name; empty without either."""
    return F.regexp_extract(F.coalesce(school, F.lit("")), "^.*([중고])", 1)


def grade_of(title: Column) -> Column:
    """The level and grade of a file's name or title: of its school and grade in brackets, else as written out; empty where unknown."""
    base = F.regexp_replace(F.coalesce(title, F.lit("")), r"^.*/", "")
    level = school_level(F.regexp_extract(base, SCHOOL_AND_GRADE, 1))
    written = F.concat(*[F.regexp_extract(base, GRADE_WRITTEN, k) for k in (1, 2)])
    return F.when(level != "", F.concat(level, F.regexp_extract(base, SCHOOL_AND_GRADE, 2))).otherwise(written)


def standard_subject(x: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in STANDARD.items() for v in kv])[x]


def filled(path: Column) -> Column:
    """valid, school, grade, year, term, part, subject, form_subject, form_subtag of the file that is to be filled into a form, by its bracketed name."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")

    def of(t: Column) -> Column:
        school, number = F.trim(F.get(t, F.lit(0))), F.trim(F.get(t, F.lit(1)))
        level = school_level(school)
        known = (F.size(t) >= 3) & level.isin("중", "고") & number.isin("1", "2", "3")
        joined = F.array_join(t, " ")
        year = F.regexp_extract(joined, FORM_TERM, 1)
        token = F.get(F.filter(F.transform(F.slice(t, 3, 100), F.trim), lambda x: standard_subject(F.replace(x, F.lit(" "), F.lit(""))).isNotNull()), F.lit(0))
        standard = standard_subject(F.replace(token, F.lit(" "), F.lit("")))
        own = (level == "고") & standard.isNotNull() & ~standard.isin(FIRST_GRADE)
        subtag = F.coalesce(F.create_map(*[F.lit(v) for kv in OLD_FORMS.items() for v in kv])[standard], F.lit("선택과목"))
        subject = F.when(level == "중", "수학").otherwise(F.coalesce(token, F.lit("")))
        some = lambda x: F.when(known, x).otherwise("")
        return F.struct(
            (known & (year != "") & (subject != "")).alias("valid"), some(school).alias("school"), some(F.concat(level, number)).alias("grade"), some(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)).alias("year"),
            some(F.regexp_extract(joined, FORM_TERM, 2)).alias("term"), some(F.regexp_extract(joined, FORM_TERM, 3)).alias("part"), some(subject).alias("subject"), some(F.when(own, standard).otherwise("")).alias("form_subject"), some(F.when(own, subtag).otherwise("")).alias("form_subtag"),
        )

    return let(F.regexp_extract_all(stem, F.lit(IN_SQUARE), F.lit(1)), of)


def form(path: Column) -> Column:
    """grade, subtag, subject, color, display, generation (year, month, day) of a form, by its name: its kind stands in the first brackets, a color in a later one. A name without grade or known subject has neither."""
    name = F.regexp_replace(F.coalesce(path, F.lit("")), r"^.*/", "")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")

    def of(t: Column) -> Column:
        first = F.coalesce(F.get(t, F.lit(0)), F.lit(""))
        level, number, rest = (F.regexp_extract(first, FORM_KIND, k) for k in (1, 2, 3))
        grade, raw = F.concat(level, number), F.regexp_replace(F.regexp_replace(rest, FORM_FOR, ""), r"\s+", "")
        key = F.coalesce(standard_subject(raw), raw)
        known = (grade != "") | key.isin(FORM_SUBJECTS)
        color = F.coalesce(F.get(F.filter(F.slice(t, 2, 100), lambda x: (x != NO_COLOR) & x.rlike(FORM_COLOR)), F.lit(0)), F.lit(""))
        subtag, subject = F.when(known, raw).otherwise(""), F.when(known & ~key.isin(FIRST_GRADE), key).otherwise("")
        label = F.trim(F.concat_ws(" ", F.nullif(grade, F.lit("")), F.nullif(subtag, F.lit(""))))
        display = F.trim(F.concat(F.when(label != "", label).otherwise(stem), F.when(color != "", F.concat(F.lit(" ("), color, F.lit(")"))).otherwise("")))
        part = lambda i: F.coalesce(F.regexp_extract(name, FORM_GENERATION, i).try_cast("int"), F.lit(0))
        return F.struct(grade.alias("grade"), subtag.alias("subtag"), subject.alias("subject"), color.alias("color"), display.alias("display"), F.struct(part(1).alias("year"), part(2).alias("month"), part(3).alias("day")).alias("generation"))

    return let(F.transform(F.regexp_extract_all(F.regexp_replace(stem, r"\[[^\]]*\]", ""), F.lit(IN_ROUND), F.lit(1)), F.trim), of)
