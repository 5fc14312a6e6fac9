"""Keyset pages (L1–L4) with limit+1 look-ahead.

A single-import page is ``filter(import_id, key > after).orderBy(key).limit(n+1)``:
partition pruning on import_id, Parquet ``GreaterThan`` pushdown on the key,
and ``TakeOrderedAndProject`` (a per-task top-n, no full sort). First pages of
many imports at once use a window top-n, which Spark evaluates with a
per-partition group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline import contract as C


class InvalidPagination(ValueError):
    pass


class ImportNotFound(LookupError):
    """The ledger has no such import (a known one without rows is an empty page)."""


def require_import(jobs: DataFrame, import_id: str) -> None:
    """Raise unless the ledger's jobs hold ``import_id``."""
    if jobs.filter(F.col("import_id") == import_id).isEmpty():
        raise ImportNotFound(f"import {import_id} does not exist")


def import_page(jobs: DataFrame, rows: DataFrame, import_id: str, key: str, limit: int | None = None,
                after: int | None = None) -> DataFrame:
    """The page a reader gets: arguments first (L4), then existence (J1), then
    the rows (L1–L3), trimmed (P6)."""
    check_page_args(limit, after)
    require_import(jobs, import_id)
    return trimmed(keyset_page(rows, import_id, key, limit, after))


def existence(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """J1 for many imports at once: ``asked`` (import_id) with ``known``."""
    have = jobs.select(F.col("import_id").alias("_known")).distinct()
    return asked.join(have, F.col("import_id") == F.col("_known"), "left").select(
        "import_id", F.col("_known").isNotNull().alias("known"))


def check_page_args(limit: int | None, after: int | None) -> tuple[int, int]:
    """L4: limit 1..200 (default 50), after >= 0 (null -> 0)."""
    limit = C.PAGE_LIMIT_DEFAULT if limit is None else limit
    after = 0 if after is None else after
    if not (C.PAGE_LIMIT_MIN <= limit <= C.PAGE_LIMIT_MAX):
        raise InvalidPagination(f"limit must be between {C.PAGE_LIMIT_MIN} and {C.PAGE_LIMIT_MAX}")
    if after < 0:
        raise InvalidPagination("after must be >= 0")
    return limit, after


def keyset_page(rows: DataFrame, import_id: str, key: str, limit: int | None = None,
                after: int | None = None) -> DataFrame:
    """L1/L2/L3: up to ``limit`` rows with key > after, plus ``next_cursor``
    (key of the last returned row when a further row exists, else null)."""
    limit, after = check_page_args(limit, after)
    fetched = (rows.filter((F.col("import_id") == import_id) & (F.col(key) > after))
               .orderBy(key).limit(limit + 1))
    w = Window.orderBy(key)  # over at most limit+1 rows
    ranked = fetched.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    page = ranked.filter(F.col("_rn") <= limit)
    nxt = F.when(F.col("_n") > limit, F.max(key).over(Window.partitionBy())).cast("long")
    return page.withColumn("next_cursor", nxt).drop("_rn", "_n")


def first_pages(rows: DataFrame, key: str, limit: int | None = None, after: int | None = None) -> DataFrame:
    """L1–L3 for every import at once (window top-n per import)."""
    limit, after = check_page_args(limit, after)
    w = Window.partitionBy("import_id").orderBy(key)
    ranked = rows.filter(F.col(key) > after).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit + 1)
    wi = Window.partitionBy("import_id")
    has_more = F.max("_rn").over(wi) > limit
    last_key = F.max(F.when(F.col("_rn") <= limit, F.col(key))).over(wi)
    return (ranked.withColumn("next_cursor", F.when(has_more, last_key).cast("long"))
            .filter(F.col("_rn") <= limit).drop("_rn"))


def trimmed(rows: DataFrame, cols: tuple[str, ...] = ("transaction_id", "category", "error_code", "reason")) -> DataFrame:
    """Trim text on read (Java ``trim``: chars <= U+0020); stored values
    stay untrimmed, so grouping is never affected."""
    from ledgerline.functions.text import java_trim
    out = rows
    for c in cols:
        if c in rows.columns:
            out = out.withColumn(c, java_trim(F.col(c)))
    return out
