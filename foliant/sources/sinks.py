"""Writes: idempotent reloads, incremental publication by content hash, exports."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reloaded(table: DataFrame, batch: DataFrame, key: str, loaded: DataFrame | None = None) -> DataFrame:
    """The table after the keys of a batch are replaced by the batch's rows. `loaded` names the keys where a key may come with no rows at all, which deletes it."""
    keys = (batch if loaded is None else loaded).select(key).distinct()
    return table.join(keys, key, "left_anti").select(*table.columns).unionByName(batch.select(*table.columns))


def change_signature(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """key, signature: a hash of each key's rows in order. Null values differ from empty ones."""
    shown = [F.coalesce(F.concat(F.lit("="), F.col(v).cast("string")), F.lit("-")) for v in (order, *values)]
    line = F.concat_ws("\x1f", *shown)
    return rows.groupBy(key).agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "\x1e")).alias("signature"))


def changed(now: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Keys whose signature is new or other than in the state of the last publication."""
    return now.join(state.select(key, "signature"), [key, "signature"], "left_anti")


def publish(rows: DataFrame, send: Callable[[list[dict]], None], chunk: int = 40, depth: int = 6) -> None:
    """Sends rows in chunks from each partition; a chunk whose sending fails is halved and tried again, down to one row or `depth` halvings. `send` must be an upsert, as tasks can run again."""

    def deliver(batch: list[dict], level: int = 0) -> None:
        try:
            send(batch)
        except ConnectionError:
            if len(batch) == 1 or level >= depth:
                raise
            middle = len(batch) // 2
            deliver(batch[:middle], level + 1)
            deliver(batch[middle:], level + 1)

    def run(part: Iterable) -> None:
        batch: list[dict] = []
        for row in part:
            batch.append(row.asDict(recursive=True))
            if len(batch) == chunk:
                deliver(batch)
                batch = []
        if batch:
            deliver(batch)

    rows.foreachPartition(run)


def export_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    """Explicit nulls stay."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def worksheets(questions: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """key, count, questions: one row a key, its questions in order; written as JSON, a worksheet each."""
    return questions.groupBy(key).agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct(order, *fields))).alias("questions"))


def joined_list(x: Column) -> Column:
    return F.array_join(x, ";")


def versioned(df: DataFrame, root: str, version: int) -> str:
    """Writes df as a new version under root and returns its folder; older versions stay, so that readers of them are not disturbed."""
    path = f"{root}/version={version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def scores_pair(scores: DataFrame, root: str) -> None:
    """Scores as JSON lines with explicit nulls, and as a table with a header whose lists are joined."""
    export_jsonl(scores, f"{root}/scores")
    lists = [f.name for f in scores.schema.fields if f.dataType.typeName() == "array"]
    export_tsv(scores.select(*[joined_list(F.col(c)).alias(c) if c in lists else F.col(c) for c in scores.columns]), f"{root}/summary", header=True)


def matching_content(golden: DataFrame, files: DataFrame, key: str, content: str, digest: str) -> DataFrame:
    """golden rows whose recorded SHA-256 is that of the file of the same key: (key, content) of files."""
    known = files.select(key, F.sha2(F.col(content).cast("binary"), 256).alias(digest))
    return golden.join(known, [key, digest], "left_semi")


def create_only(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Fails where the path exists, unless told to overwrite."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def reviewed(status: Column) -> Column:
    """The status after review: marked once, however often it is run."""
    return F.when(F.coalesce(status, F.lit("")).startswith("reviewed"), status).otherwise(F.concat_ws(" ", F.lit("reviewed"), status))


def write_text(spark: SparkSession, path: str, body: str | bytes) -> None:
    """One small file, in any folder that Spark can reach."""
    sc = spark.sparkContext
    to = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to)
    try:
        out.write(body.encode() if isinstance(body, str) else body)
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the complete tables name=number under a path, in order."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    found = at.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what this library wrote and nothing reads any more."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
