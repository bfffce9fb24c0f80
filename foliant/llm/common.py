"""What the operators of this subpackage share: tables, durable intermediates, word splitting and seeded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one key that a task may get.
HOT = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset and all run on one machine, as in tests, a new one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foliant-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and still there when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table that this library wrote and that nothing reads any more."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def rounds(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """A keeper of one table that changes from round to round: each state is written and read back, and the one before deleted."""
    folder, steps = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", count()

    def kept(df: DataFrame) -> DataFrame:
        step = next(steps)
        df.write.parquet(f"{folder}/{step}")
        if step:
            delete(spark, f"{folder}/{step - 1}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{step}")

    return kept


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in any folder that Spark can reach, written by the driver: for small files only."""
    sc = spark.sparkContext
    to = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to)
    try:
        out.write(data)
    finally:
        out.close()


def sized(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows; a larger one is joined as Spark sees fit. For tables that are cheap to count, with short rows."""
    return F.broadcast(df) if df.count() <= most else df


def hot_join(rows: DataFrame, facts: DataFrame, on: list[str], total: int, how: str = "left", hot: int = HOT) -> DataFrame:
    """rows joined to facts, which has each key once. Of `total` rows one key may have a third: keys of more than `hot` rows, no more than one in so many rows, meet their facts by a broadcast, the others by a shuffle. Columns: on, then the others of both."""
    if total <= hot:
        return rows.join(facts, on, how)
    keys = written(rows.groupBy(*on).count().filter(F.col("count") > hot).select(*on), "hot-keys")
    if keys.isEmpty():
        return rows.join(facts, on, how)
    keys = sized(keys)
    heavy = rows.join(keys, on, "left_semi").join(sized(facts.join(keys, on, "left_semi")), on, how)
    # Rows with a null in the key meet nothing: they need not move.
    known = reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in on])
    out = heavy.unionByName(rows.filter(known).join(keys, on, "left_anti").join(facts, on, how))
    return out.unionByName(rows.filter(~known), allowMissingColumns=True) if how == "left" else out


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that is never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def order_key(*names: str) -> Column:
    """A seeded pseudo-random order of rows, the same in every run."""
    return F.xxhash64(F.lit(20240607), *names)


def drawn(rows: DataFrame, most: int, total: int, *key: str) -> DataFrame:
    """At most `most` rows in a seeded order. Of `total` rows only about four times as many are sorted, so that no task or driver gets a share that grows with the table."""
    share = min(1.0, 4 * most / max(total, 1))
    return rows.filter(F.pmod(order_key(*key), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(order_key(*key), *key).limit(most)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about `most` bytes of text, or one row: bounds the memory of what follows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and for each the index of its text. Null and blank texts have none."""
    lists = pc.ascii_split_whitespace(texts)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), owner.filter(some).to_numpy().astype(np.int64)


def segment_sum(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def enough_near(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, who: np.ndarray, members: np.ndarray, width: int, edits: np.ndarray, at_once: int = 2_000_000) -> np.ndarray:
    """Which candidates have enough words of what they may hold: of the different words of `who` no more than `edits` are missing in words[lo:hi]. members: who * width + word, sorted. Looks at a bounded number of words in one go, or one candidate's."""
    size, out = np.maximum(hi - lo, 0), np.zeros(len(who), bool)
    need = np.bincount(members // width, minlength=int(who.max(initial=-1)) + 1)[who] - edits
    ends = np.cumsum(size)
    at = 0
    while at < len(who):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + at_once, side="right")))
        of = np.repeat(np.arange(at, to), size[at:to])
        word = words[np.arange(len(of)) - np.repeat(ends[at:to] - size[at:to] - base, size[at:to]) + lo[of]]
        key = who[of] * width + word
        place = np.minimum(np.searchsorted(members, key), len(members) - 1)
        held = members[place] == key
        seen = np.unique((of[held] - at) * len(members) + place[held]) // len(members)
        out[at:to] = np.bincount(seen, minlength=to - at) >= need[at:to]
        at = to
    return out
