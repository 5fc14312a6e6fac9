"""Idempotent sinks (K1–K5, J2, W3). Data is written first, into a folder of
its attempt; a commit that names its files is appended last (``plans/store``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID_SHIFT = 1 << 40  # id = import_no * 2^40 + source_row: unique, ascending per import


def table_path(root: str, name: str) -> str:
    return os.path.join(root, name)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep one row per key — the smallest by ``order`` then by every other
    column (a total order, so the winner is deterministic).

    Written as ``min(struct(...))`` per key: a partial (map-side) aggregate,
    so a key holding a third of all rows is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest]).alias("_w")
    return (df.groupBy(*key).agg(F.min(packed).alias("_w"))
            .select(*key, *[F.col("_w." + c).alias(c) for c in order + rest]))


def new_rows(batch: DataFrame, stored: DataFrame | None, key: list[str]) -> DataFrame:
    """Conflict-ignore insert — rows whose key is not stored yet."""
    if stored is None:
        return batch
    return batch.join(stored.select(*key), key, "left_anti")


def append_attempt(df: DataFrame, path: str, attempt: str, sort_cols: list[str]) -> None:
    """Write an attempt's rows under attempt/import_id folders with no shuffle.

    Upstream tasks are scan splits — contiguous ranges of one file — so a
    huge import is already spread over many tasks and each task's rows are
    nearly sorted; a local sort leaves every written file sorted by the key
    (row-group min/max skipping for keyset reads) and one file per import per
    task."""
    (df.sortWithinPartitions("import_id", *sort_cols)
       .write.mode("append").partitionBy("import_id").parquet(os.path.join(path, f"attempt={attempt}")))
