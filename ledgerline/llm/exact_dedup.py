"""Exact dedup by progressive refinement: length, then prefix hash, then the
full hash of those texts only whose length and prefix hash another text has.

Plan: one scan counts (length, prefix hash) groups, with partial counts before
the shuffle. A second scan hashes the full text only of rows in a group of two
or more; texts never enter a shuffle. The table of surviving groups is
broadcast while its counted size is within ``BROADCAST_ROWS``; beyond that the
second scan hashes first, and 40-byte keys meet in a shuffle join.

Defined results: null text counts as empty; texts are compared after each run
of white space became one space. The smallest id stays; null ids come last.
Of rows with the same id and equal texts one stays. An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import BROADCAST_ROWS, cut, fresh, keep_one, normalised, sized, staged, table

PREFIX_CHARS = 128


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix_chars: int = PREFIX_CHARS, digest_all: bool = False,
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, sha256
    (binary; null for rows settled before the full hash, unless
    ``digest_all``)."""
    norm = docs.select(docs[id_col].alias("id"), normalised(docs[text_col]).alias("norm"))
    keyed = norm.withColumns({"len": F.length("norm").cast("long"),
                              "pre": F.xxhash64(F.substring("norm", 1, prefix_chars))})
    by_prefix = keyed.groupBy("len", "pre").agg(F.count("*").alias("n"))
    # length first: a length of one row is settled without looking at its prefix
    by_len = by_prefix.groupBy("len").agg(F.sum("n").alias("n_len")).filter("n_len > 1").select(F.col("len").alias("l2"))
    live = cut(by_prefix.filter("n > 1").join(by_len, F.col("len") == F.col("l2"), "left_semi")
               .select(F.col("len").alias("g_len"), F.col("pre").alias("g_pre")))
    met = (F.col("len") == F.col("g_len")) & (F.col("pre") == F.col("g_pre"))
    small = live.limit(broadcast_rows + 1).count() <= broadcast_rows
    sha = F.unhex(F.sha2(F.col("norm"), 256))
    if small:
        flagged = keyed.join(F.broadcast(live), met, "left").withColumn("live", F.col("g_len").isNotNull())
        hashed = flagged.withColumn("sha", sha if digest_all else F.when(F.col("live"), sha))
        hashed = hashed.select("id", "live", "sha")
    else:
        slim = keyed.select("id", "len", "pre", sha.alias("sha"))
        hashed = slim.join(live, met, "left").select("id", F.col("g_len").isNotNull().alias("live"), "sha")
    rows = staged(hashed.withColumn("row", F.monotonically_increasing_id()), "exact")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    # stored before the join, so that the adaptive join can split a hot group
    groups = cut(rows.filter("live").groupBy(F.col("sha").alias("g_sha")).agg(
        F.min(first).alias("first"), F.count("*").alias("size")).filter("size > 1"))
    joined = rows.join(groups, F.col("live") & (F.col("sha") == F.col("g_sha")), "left")
    alone = F.col("g_sha").isNull()
    return joined.select(
        F.col("id"), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"), F.col("sha").alias("sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies, all columns kept. Rows leave by (id, full
    hash), which does not depend on how Spark splits the input; a row that has
    the same id and text as the one that stays is told apart by its other
    columns' hash, and full repeats collapse."""
    found = cut(exact_groups(docs, id_col, text_col).filter("group_size > 1"))
    gone = found.groupBy("id", "sha256").agg(F.max("kept").alias("any_kept"), F.count("*").alias("n"))
    gone = cut(gone.filter("not any_kept or n > 1").select(
        F.col("id").alias("g_id"), F.col("sha256").alias("g_sha"), "any_kept"))
    sha = fresh(docs, "sha")
    hashed = docs.withColumn(sha, F.unhex(F.sha2(normalised(docs[text_col]), 256)))
    copies = gone.filter("not any_kept")
    same = hashed[id_col].eqNullSafe(F.col("g_id")) & (hashed[sha] == F.col("g_sha"))
    rest = hashed.join(sized(copies), same, "left_anti")
    return keep_one(rest, cut(gone.filter("any_kept").drop("any_kept")), {id_col: "g_id", sha: "g_sha"}).drop(sha)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = exact_groups(docs, digest_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                        F.lower(F.hex("sha256")).alias("text_sha256"))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
