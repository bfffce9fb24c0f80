"""Names of columns that operators add for a while, which no table has, and how rows are dealt out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

_SALT = uuid.uuid4().hex


def own(name: str) -> str:
    return f"__{name}_{_SALT}"


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by keys over as many tasks as shuffles have. The number is given, as Spark would put few bytes together again, however much is made of them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
