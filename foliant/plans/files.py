"""Queries that write tables to files in the shared folder and read them back by the readers: inventories, JSON, archives, versions, streams."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.plans.registry import query, table
from foliant.sources import readers, sinks
from foliant.sources.durable import durable, new_folder
from foliant.streaming import incremental


@query("SELECT 'labels' AS folder, count(*) > 0 AS some, sum(doc_id)::BIGINT AS total FROM labels")
def inventory_scan(spark, d):
    """A table written as tab-separated lines, its files listed, and read back."""
    path = new_folder(spark, "inventory")
    rows = table(spark, d, "labels").select(F.concat(F.lit("/d/"), "doc_id").alias("path"), F.col("doc_id").alias("size"), F.lit("2024-01-01").alias("mtime"))
    sinks.export_tsv(rows, path)
    listed = readers.files(spark, path, "*.csv").agg((F.count("*") > 0).alias("some"))
    read = readers.inventory(spark, path).agg(F.sum("size").alias("total"))
    return read.select(F.lit("labels").alias("folder"), F.lit(listed.first()["some"]).alias("some"), "total")


@query("SELECT doc_id, quality, CASE WHEN doc_id % 2 = 0 THEN toxic END AS toxic FROM labels")
def jsonl_roundtrip(spark, d):
    """JSON lines with explicit nulls, and back."""
    path = new_folder(spark, "jsonl")
    sinks.export_jsonl(table(spark, d, "labels").withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, F.col("toxic"))), path)
    return readers.json_lines(spark, path, "doc_id long, quality int, toxic int")


@query("SELECT doc_id, quality, CASE WHEN quality = 1 THEN 'GOOD;SEEN' ELSE 'SEEN' END AS tags FROM labels")
def score_files(spark, d):
    """Scores as lines and as a table with joined lists; the table is read back."""
    path = new_folder(spark, "scores")
    sinks.scores_pair(table(spark, d, "labels").select("doc_id", "quality", F.when(F.col("quality") == 1, F.array(F.lit("GOOD"), F.lit("SEEN"))).otherwise(F.array(F.lit("SEEN"))).alias("tags")), path)
    return spark.read.schema("doc_id long, quality int, tags string").option("sep", "\t").option("header", True).csv(f"{path}/summary")


def region_files(spark, d) -> str:
    path = new_folder(spark, "json")
    body = F.when(F.col("r_regionkey") == 3, '{"broken').otherwise(F.to_json(F.struct(F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey")).alias("exam_id"), F.col("r_name").alias("note"))))
    rows = table(spark, d, "region").select(F.concat(F.col("r_regionkey").cast("string"), F.when(F.col("r_regionkey") == 4, ".answers.json").otherwise(".json")).alias("file"), body.alias("value"))
    rows.write.partitionBy("file").text(path)
    return path


@query("SELECT count(*) FILTER (r_regionkey <> 3) AS readable, count(*) FILTER (r_regionkey = 3) AS broken FROM region")
def json_file_scan(spark, d):
    """Files of one object each: keys from the body, broken files set aside."""
    read = spark.read.schema("exam_id int, note string, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(region_files(spark, d))
    good, bad = readers.split_corrupt(durable(read.withColumn("file", F.col("_metadata.file_name"))))  # Spark counts no broken rows of files that it parses anew
    return good.agg(F.count("*").alias("readable")).withColumn("broken", F.lit(bad.count()))


def written_files(spark, path, rows, name, body):
    """A small file for each row of a table of a few rows, in the driver's order."""
    for r in rows.select(name.alias("name"), body.alias("body")).toLocalIterator():
        sinks.write_text(spark, f"{path}/{r['name']}", r["body"])


@query("""SELECT n_nationkey::INT AS exam_id, n_name AS note FROM nation WHERE n_nationkey % 5 < 3""")
def json_named_files(spark, d):
    """A file for each nation. A key missing in the body is the number that the file's name starts with; answer files are left out, broken ones told apart."""
    path, n = new_folder(spark, "named"), F.col("n_nationkey")
    name = F.concat(n.cast("string"), F.when(n % 5 == 3, ".answers.json").when(n % 2 == 0, ".json").otherwise(".x.json"))
    body = F.when(n % 5 == 4, "{").otherwise(F.to_json(F.struct(F.when(n % 3 > 0, n).alias("exam_id"), F.col("n_name").alias("note"))))
    written_files(spark, path, table(spark, d, "nation"), name, body)
    return readers.split_corrupt(readers.json_files(spark, path, "exam_id int, note string, _corrupt_record string", without="*.answers.json"))[0].select("exam_id", "note")


@query("""SELECT 'p' || n_nationkey || '_merged.json' AS file, n_nationkey::INT AS page, n_name AS title FROM nation WHERE n_regionkey <> 2""")
def page_file_order(spark, d):
    """Pages named by number; a page without its number takes none from the name, whose number is not at the start, and other files are no pages."""
    path, n = new_folder(spark, "pages"), F.col("n_nationkey")
    name = F.concat(F.when(F.col("n_regionkey") == 2, "x").otherwise("p"), n.cast("string"), F.lit("_merged.json"))
    written_files(spark, path, table(spark, d, "nation"), name, F.to_json(F.struct(n.alias("page"), F.col("n_name").alias("title"))))
    return readers.page_files(spark, path, "page int, title string, _corrupt_record string").select("file", "page", "title")


def zipped(batches):
    """A zip file for each row (doc_id, text): the text in two sections and a file beside them; every seventh is broken."""
    few = (b.slice(k, 100) for b in batches for k in range(0, b.num_rows, 100))
    for batch in few:
        files = []
        for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                for name, body in (("Contents/section10.xml", f"<b>{i}</b>"), ("Contents/section0.xml", f"<a>{x}</a>"), ("section.xml", "x"), ("other.txt", "x")):
                    z.writestr(name, body)
            files.append(buffer.getvalue()[: 20 if i % 7 == 0 else None])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(files, pa.binary())], ["path", "content"])


@query("""SELECT doc_id, entry, md5(xml) AS xml FROM (SELECT doc_id, 'Contents/section0.xml' AS entry, '<a>' || text || '</a>' AS xml FROM documents WHERE doc_id % 7 > 0 UNION ALL SELECT doc_id, 'Contents/section10.xml', '<b>' || doc_id || '</b>' FROM documents WHERE doc_id % 7 > 0 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 7 = 0)""")
def zip_entries(spark, d):
    """Sections of zip files, one of each document's text, that are made in tasks; broken files have no entry."""
    files = table(spark, d, "documents").select("doc_id", "text").mapInArrow(zipped, "path string, content binary")
    return readers.unzipped(files).select(F.col("path").cast("long").alias("doc_id"), "entry", F.md5("xml").alias("xml"))


@query("SELECT source AS folder, arg_max(doc_id::VARCHAR, (n_chars, doc_id::VARCHAR)) AS path FROM documents GROUP BY 1")
def newest_files(spark, d):
    """Of each folder the file of the latest time, here its size."""
    return readers.newest(table(spark, d, "documents").select(F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("modified")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'E:/new/' ELSE 'D:/old/' END || doc_id AS path FROM documents WHERE doc_id % 3 > 0")
def paths_remapped(spark, d):
    """Rows whose file exists, on the old drive or the new."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("D:/old/"), i).alias("path"))
    there = rows.filter(i % 3 > 0).select(F.concat(F.when(i % 2 == 0, "E:/new/").otherwise("D:/old/"), i).alias("path"))
    return readers.remapped(rows, "path", there, {"D:/old/": "E:/new/"})


@query("SELECT doc_id, quality + 1 AS quality FROM labels")
def newest_version(spark, d):
    """Two versions of a table; the newer is read, the older stays."""
    root = new_folder(spark, "versions")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    sinks.versioned(labels, root, 1)
    sinks.versioned(labels.withColumn("quality", F.col("quality") + 1), root, 2)
    found = readers.files(spark, root, "*.parquet").select(F.regexp_replace("path", r"/[^/]*$", "").alias("path"), F.regexp_extract("path", r"version=(\d+)", 1).cast("int").alias("modified"), F.lit("all").alias("folder"))
    return spark.read.schema("doc_id long, quality int").parquet(readers.newest(found.distinct()).first()["path"])


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def golden_content(spark, d):
    """Golden records whose file is still the one recorded."""
    t = table(spark, d, "documents").select("doc_id", "text")
    golden = t.select("doc_id", F.sha2(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("png_sha256"))
    return sinks.matching_content(golden, t, "doc_id", "text", "png_sha256").select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'reviewed ready' WHEN doc_id % 3 = 1 THEN 'reviewed x' ELSE 'reviewed' END AS status FROM documents")
def statuses_reviewed(spark, d):
    i = F.col("doc_id") % 3
    once = sinks.reviewed(F.when(i == 0, "ready").when(i == 1, "reviewed x"))
    return table(spark, d, "documents").select("doc_id", sinks.reviewed(once).alias("status"))


@query("SELECT c_custkey AS folder, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'reference missing' WHEN 2 THEN 'no pages' ELSE 'status;no reference' END AS reasons FROM customer")
def handoff_readiness(spark, d):
    """What speaks against taking a folder: its status, its reference, what a scan does not have."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("/in/"), k.cast("string"))
    meta = table(spark, d, "customer").select(name.alias("folder"), F.when(k % 4 < 3, "ready").otherwise("draft").alias("status"), F.when(k % 4 < 3, F.concat(name, F.lit("/ref.pdf"))).alias("reference_pdf"), F.lit("").alias("ref_pdf"))
    scan = table(spark, d, "customer").select(F.explode(F.array(F.when(k % 4 != 1, F.concat(name, F.lit("/ref.pdf"))), F.when(k % 4 != 2, F.concat(name, F.lit("/p1_merged.json"))))).alias("path")).filter("path is not null")
    got = incremental.present(incremental.readiness(meta), scan)
    return got.select(F.regexp_extract("folder", r"(\d+)$", 1).cast("long").alias("folder"), F.array_join("reasons", ";").alias("reasons"))


@query("SELECT status, count(*) AS n FROM (SELECT 'ready' AS status FROM region WHERE r_regionkey % 2 = 0) GROUP BY 1")
def handoff_stream(spark, d):
    """A stream of meta files in folders; those without anything against them are counted."""
    root = new_folder(spark, "handoffs")
    for r in table(spark, d, "region").collect():  # five rows
        sinks.write_text(spark, f"{root}/in/{r['r_regionkey']}/meta.json", '{"status": "%s", "reference_pdf": "/x/a.pdf"}' % ("ready" if r["r_regionkey"] % 2 == 0 else "draft"))
    out = f"{root}/out"
    incremental.handoffs(spark, f"{root}/in").filter(F.size("reasons") == 0).select("status").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("status string").parquet(out).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def work_queue(spark, d):
    return incremental.unprocessed(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


EVENTS = "user_id long, event_id long, value double"


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def published_changes(spark, d):
    """Events that come in many batches, with a restart between: each user's are published once, and not again when asked again."""
    root, parts = new_folder(spark, "published"), 4
    rows = table(spark, d, "events").select("user_id", "event_id", "value")
    for part in range(2):
        rows.filter(F.col("event_id") % 2 == part).repartition(parts).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", parts // 2).parquet(f"{root}/in")
        incremental.watched(stream, "user_id", "event_id", ["value"], f"{root}/state", f"{root}/checkpoint")
    for _ in range(2):
        incremental.published(spark.read.schema(EVENTS).parquet(f"{root}/in"), "user_id", f"{root}/state", lambda sent: sent.write.mode("append").parquet(f"{root}/out"))
    return spark.read.schema(EVENTS).parquet(f"{root}/out").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT count(*) // 100 * 100 AS passed, count(*) AS total FROM events")
def stream_checkpoints(spark, d):
    """A count over a stream's batches, with a restart between, that is noted whenever it passes a hundred."""
    root, seen = new_folder(spark, "counted"), []
    rows = table(spark, d, "events").select("event_id")
    for part in range(2):
        rows.filter(F.col("event_id") % 2 == part).repartition(4).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("event_id long").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        incremental.counted_batches(stream, lambda _, n: seen.append(n), f"{root}/checkpoint", 100).awaitTermination()
    schema = T.StructType([T.StructField("passed", T.LongType()), T.StructField("total", T.LongType())])
    return spark.createDataFrame([(seen[-1] // 100 * 100, seen[-1])] if seen else [], schema)


@query("SELECT doc_id, strftime(make_timestamp((1704067200 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S') AS mtime, '{\"id\":' || doc_id || ',\"t\":\"가\"}' AS body FROM documents")
def file_times(spark, d):
    """Modification times as text, and bodies as JSON with their letters as they are."""
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.date_format(F.timestamp_seconds(i + 1704067200), "yyyy-MM-dd'T'HH:mm:ss").alias("mtime"), F.to_json(F.struct(i.alias("id"), F.lit("가").alias("t"))).alias("body"))
