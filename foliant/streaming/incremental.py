"""Streams in place of polling: files that get ready, changed keys to publish, counters that pass a threshold, events by window."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.sources.durable import durable, new_folder
from foliant.sources.sinks import change_signature, changed, exists, folders, remove


def handoffs(spark: SparkSession, root: str, schema: str = "status string, reference_pdf string, ref_pdf string") -> DataFrame:
    """A stream of meta files that are ready: each file's folder, status, reference, and the reasons why it is not."""
    read = spark.readStream.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").json(root)
    return readiness(read.withColumn("folder", F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "")))


def readiness(meta: DataFrame) -> DataFrame:
    """meta with `reference` and `reasons`: what speaks against taking it; none means ready."""
    reference = F.coalesce(F.nullif("reference_pdf", F.lit("")), F.nullif("ref_pdf", F.lit("")))
    reasons = F.array_compact(F.array(F.when(~F.coalesce(F.col("status"), F.lit("")).startswith("ready"), "status"), F.when(reference.isNull(), "no reference"), F.when(~reference.rlike(r"[/\\]|\.pdf$"), "no path")))
    return meta.withColumn("reference", reference).withColumn("reasons", reasons)


def present(ready: DataFrame, files: DataFrame) -> DataFrame:
    """ready (folder, reference, reasons) with reasons of what a scan (path) does not have: the reference itself, and any page file in the folder."""
    here, paged = (f"__{c}_{uuid.uuid4().hex}" for c in ("there", "pages"))
    there = files.select(F.col("path").alias("reference"), F.lit(True).alias(here)).distinct()
    pages = files.filter(F.col("path").rlike(r"/p\d+_merged\.json\z")).select(F.regexp_replace("path", r"/[^/]*\z", "").alias("folder"), F.lit(True).alias(paged)).distinct()
    met = ready.join(there, "reference", "left").join(pages, "folder", "left")
    more = F.array_compact(F.array(F.when(F.col("reference").isNotNull() & F.col(here).isNull(), "reference missing"), F.when(F.col(paged).isNull(), "no pages")))
    return met.withColumn("reasons", F.concat("reasons", more)).drop(here, paged)


def publish_changes(stream: DataFrame, key: str, order: str, values: list[str], state_path: str, send: Callable[[DataFrame], None], checkpoint: str, compact: int = 50):
    """For batches that hold their keys whole, as snapshots: the rows of keys whose signature differs from the one last published go to `send`; signatures are kept only after it succeeds. A batch that runs again sends nothing twice that was kept. Every `compact` batches the state is written anew with one row a key, as the next generation; the older one goes when that is complete. For keys whose rows come in many batches see `watched`."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = change_signature(batch, key, order, *values)
        state = spark.read.parquet(state_path) if exists(spark, state_path) else now.limit(0).withColumns({"batch": F.lit(0), "gen": F.lit(0)})
        top = state.agg(F.max("gen")).first()[0] or 0
        kept = state.filter(F.col("gen") == top).groupBy(key).agg(F.max_by("signature", "batch").alias("signature"), F.max("batch").alias("batch"))
        path = new_folder(spark, "changed-keys")
        changed(now, kept, key).select(key, "signature").withColumn("batch", F.lit(number)).write.parquet(path)
        fresh = spark.read.parquet(path)
        send(batch.join(fresh.select(key), key, "left_semi"))
        if (number + 1) % compact:
            fresh.write.mode("append").parquet(f"{state_path}/gen={top}")
        else:
            kept.join(fresh.select(key), key, "left_anti").select(key, "signature", "batch").unionByName(fresh).write.mode("overwrite").parquet(f"{state_path}/gen={top + 1}")
            remove(spark, f"{state_path}/gen={top}")
        remove(spark, path)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Signatures(StatefulProcessor):
    """Of each key the digests of its rows by order, and their sum, which is its signature: rows can come in any order and number of batches, a row that comes again changes nothing, and one with another digest replaces the one before. What a batch costs grows with the batch, not with the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "o string", "digest string")
        self.total = handle.getValueState("total", "sum string, rows long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.total.get() if self.total.exists() else ("0", 0)
        total, n = int(before[0], 16), before[1]
        for batch in rows:
            for o, digest in zip(batch.iloc[:, -2], batch.iloc[:, -1], strict=True):  # by place: what the columns are called depends on Spark's version
                if self.rows.containsKey((o,)):
                    total -= int(self.rows.getValue((o,))[0], 16)
                else:
                    n += 1
                total += int(digest, 16)
                self.rows.updateValue((o,), (digest,))
        now = (f"{total % (1 << 128):032x}", n)
        if now != tuple(before):
            self.total.update(now)
            yield pd.DataFrame({"key": [key[0]], "signature": [f"{now[0]}:{now[1]}"]})

    def close(self) -> None:
        pass


def signed(stream: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """A stream of (key as text, signature) of keys whose rows have changed, over all batches so far; the state is Spark's, and so outlives a restart from the checkpoint. Of a key one row of each order counts, the last that came."""
    shown = [F.coalesce(F.concat(F.lit("="), F.col(v).cast("string")), F.lit("-")) for v in (order, *values)]
    rows = stream.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")).alias("__key"), shown[0].alias("__o"), F.md5(F.concat_ws("\x1f", *shown)).alias("__digest"))
    return rows.groupBy("__key").transformWithStateInPandas(Signatures(), "key string, signature string", "update", "none")


def watched(stream: DataFrame, key: str, order: str, values: list[str], state_path: str, checkpoint: str):
    """Notes which keys have changed, batch by batch, all that is available; a batch that runs again writes the same again. Needs the RocksDB state store, which it sets for the query that it starts."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        note = lambda batch, number: batch.write.mode("overwrite").parquet(f"{state_path}/changed/batch={number}")
        query = signed(stream, key, order, values).writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return query


def published(rows: DataFrame, key: str, state_path: str, send: Callable[[DataFrame], None]) -> None:
    """Sends the rows of keys that have changed since the last publication, each key once, however many batches it came in; what was sent is noted after that as the next generation, one row a key, and older notes go. rows is what the watched stream reads, as a table."""
    spark = rows.sparkSession
    batches, gens = folders(spark, f"{state_path}/changed", "batch"), folders(spark, f"{state_path}/published", "gen")
    if not batches:
        return
    schema = "key string, signature string"
    read = lambda path: spark.read.schema(schema).parquet(path)
    noted = [read(f"{state_path}/changed/batch={n}").withColumn("batch", F.lit(n)) for n in batches]
    top = gens[-1] if gens else 0
    last = read(f"{state_path}/published/gen={top}") if gens else spark.createDataFrame([], schema)
    now = reduce(DataFrame.unionByName, noted).groupBy("key").agg(F.max_by("signature", "batch").alias("signature"))
    fresh = durable(now.join(last, ["key", "signature"], "left_anti"))
    name = f"__key_{uuid.uuid4().hex}"
    shown = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-"))
    send(rows.withColumn(name, shown).join(fresh.select(F.col("key").alias(name)), name, "left_semi").drop(name))
    last.join(fresh.select("key"), "key", "left_anti").unionByName(fresh).write.mode("overwrite").parquet(f"{state_path}/published/gen={top + 1}")
    for n in batches:
        remove(spark, f"{state_path}/changed/batch={n}")
    for n in gens:
        remove(spark, f"{state_path}/published/gen={n}")


def counted_batches(stream: DataFrame, done: Callable[[int, int], None], checkpoint: str, step: int = 1000):
    """Counts a stream's rows over its batches, all that is available; `done` is called with the batch and the total whenever the total passes a multiple of the step. The count is Spark's state, and the total before a batch stands beside the checkpoint, so a restart goes on where the last run ended; a batch that runs again calls again."""
    spark = stream.sparkSession
    totals = f"{checkpoint}-totals"

    def run(batch: DataFrame, number: int) -> None:
        if (row := batch.first()) is None:
            return
        earlier = [n for n in folders(spark, totals, "batch") if n < number]
        before = spark.read.schema("rows long").parquet(f"{totals}/batch={earlier[-1]}").first()["rows"] if earlier else 0
        if row["rows"] // step > before // step:
            done(number, row["rows"])
        batch.write.mode("overwrite").parquet(f"{totals}/batch={number}")
        for n in earlier[:-1]:
            remove(spark, f"{totals}/batch={n}")

    return stream.groupBy().agg(F.count("*").alias("rows")).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unprocessed(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """A work queue that survives a crash: what the output does not have yet."""
    return inputs.join(done.select(key), key, "left_anti")


def windowed(events: DataFrame, at: str, group: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of a stream or table by tumbling window and group; rows later than the watermark are dropped by a stream."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    marked = timed.withWatermark(at, late) if events.isStreaming else timed
    return marked.groupBy(F.window(at, size).alias("w"), group).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")
