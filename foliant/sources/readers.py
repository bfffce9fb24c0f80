"""Scans: file inventories, JSON files keyed by their names, versions of folders. Spark reads all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of unpacked entries after which they leave Python.
HELD = 1_000_000
INVENTORY = "path string, size long, mtime string"
BLOCK = "struct<type:string,value:string,rows:array<array<string>>,bbox:array<double>,page:int,bold:boolean,underline:boolean,box_member:boolean>"
PART = f"struct<number:int,score:string,contents:array<{BLOCK}>>"
QUESTION = f"struct<number:int,type:string,label:string,label_type:string,score:string,contents:array<{BLOCK}>,choices:array<struct<number:int,contents:array<{BLOCK}>>>,sub_questions:array<{PART}>,subquestions:array<{PART}>,answer:string,solution:string,topic:string,difficulty:string>"
EXAM = f"exam_id int, header struct<title:string>, questions array<{QUESTION}>, _corrupt_record string"
ANSWERS = "exam_id int, answer_pages array<int>, items array<struct<number:int,answer:string,solution:string,topic:string,difficulty:string>>, _source string, note string, _corrupt_record string"
SOLVED = "exam_id int, pass string, items array<struct<number:int,answer:string,solution:string,confidence:string,note:string>>, _corrupt_record string"


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, size, modified of every file under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a header-less, tab-separated inventory: blank lines and a byte order mark are dropped."""
    rows = spark.read.schema(INVENTORY).option("sep", "\t").option("quote", "").csv(path)
    return rows.withColumn("path", F.regexp_replace("path", "^﻿", "")).filter("path is not null and path <> ''")


def json_files(spark: SparkSession, path: str, schema: str, key: str = "exam_id", pattern: str = "*.json", without: str | None = None) -> DataFrame:
    """One row a file. A key missing in the body is the number that the file's name starts with; broken files keep their text in _corrupt_record."""
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).json(path).withColumn("file", F.col("_metadata.file_name"))
    named = read.withColumn(key, F.coalesce(key, F.regexp_extract("file", r"^(\d+)", 1).try_cast("int")))
    return named.filter(~F.col("file").like(without.replace("*", "%"))) if without else named


def split_corrupt(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the files that are not."""
    return read.filter("_corrupt_record is null").drop("_corrupt_record"), read.filter("_corrupt_record is not null").select("file")


def newest(found: DataFrame, group: str = "folder", by: str = "modified") -> DataFrame:
    """Of each group's files the newest; ties by path."""
    return found.groupBy(group).agg(F.max_by("path", F.struct(by, "path")).alias("path"))


def zipped_xml(spark: SparkSession, path: str, entry: str = r"section\d+\.xml\Z") -> DataFrame:
    """path, entry, xml of the entries of zip files whose names match; entries in order of name."""
    return unzipped(spark.read.format("binaryFile").load(path).select("path", "content"), entry)


def unzipped(files: DataFrame, entry: str = r"section\d+\.xml\Z") -> DataFrame:
    """path, entry, xml of the entries of zip files (path, content) whose names match; a broken file has one row without an entry."""
    import io
    import re
    import zipfile

    import pyarrow as pa

    names = pa.schema([("path", pa.string()), ("entry", pa.string()), ("xml", pa.string())])

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for p, content in zip(batch["path"], batch["content"], strict=True):
                p, content = p.as_py(), content.as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        own = [{"path": p, "entry": n, "xml": z.read(n).decode("utf-8", "replace")} for n in sorted(z.namelist()) if re.search(entry, n)]
                except zipfile.BadZipFile:
                    own = [{"path": p, "entry": None, "xml": None}]
                rows += own
                held += sum(len(r["xml"] or "") for r in own)
                if held > HELD:
                    yield pa.RecordBatch.from_pylist(rows, names)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, names)

    return files.select("path", "content").mapInArrow(run, "path string, entry string, xml string")


def remapped(rows: DataFrame, path: str, existing: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """rows whose path exists in a scan (its column `path`), as it is or with its drive's prefix replaced; the path is the one that exists."""
    p, moved = F.col(path), F.lit(None).cast("string")
    for old, new in prefixes.items():
        moved = F.when(p.startswith(old), F.concat(F.lit(new), F.substring(p, len(old) + 1, F.lit(1 << 20)))).otherwise(moved)
    there = existing.select(F.col("path").alias("__there")).distinct()
    as_is = rows.join(there, p == F.col("__there"), "left_semi")
    rest = rows.join(there, p == F.col("__there"), "left_anti").withColumn(path, moved)
    return as_is.unionByName(rest.join(there, F.col(path) == F.col("__there"), "left_semi"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a line; broken lines keep their text in _corrupt_record, if the schema has it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def page_files(spark: SparkSession, path: str, schema: str, pattern: str = "p*_merged.json") -> DataFrame:
    """Pages of a document, in the order of their files' names: p10 comes before p2."""
    return json_files(spark, path, schema, key="page", pattern=pattern).orderBy("file")
