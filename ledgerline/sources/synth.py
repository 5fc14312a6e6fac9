"""Deterministic synthetic transactions (S9) and file fingerprint.

Row i of seed s is derived from ``blake2b(f"{s}:{i}", digest_size=16)``.
Spark has no blake2b, so a vectorised Pandas UDF computes only the 16-byte
digest per row; every field is then derived JVM-side from digest slices.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import contract as C

try:  # executor-side functions of this module ship by value (workers need no install)
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover
    pass

# fixed values: the generator's categories, period and start instant.
CATEGORIES = ["alimentação", "transporte", "moradia", "saúde", "educação", "lazer", "serviços", "outros"]
PERIOD_SECONDS = 731 * 24 * 60 * 60
START_AT = "2024-01-01 00:00:00"
AMOUNT_RANGE = 2_000_001
AMOUNT_OFFSET = 1_000_000


@F.pandas_udf(T.BinaryType())
def _blake2b16(seed: pd.Series, row: pd.Series) -> pd.Series:
    return pd.Series([hashlib.blake2b(f"{s}:{i}".encode("ascii"), digest_size=16).digest()
                      for s, i in zip(seed, row)])


def _uint(digest: Column, start: int, length: int) -> Column:
    """Big-endian unsigned integer of a digest slice, as decimal(20,0)."""
    return F.conv(F.hex(F.substring(digest, start + 1, length)), 16, 10).cast("decimal(20,0)")


def synthetic_rows(rows: DataFrame, seed: int, row_col: str = "row_number") -> DataFrame:
    """The four CSV text fields for each row number in ``rows``."""
    d = _blake2b16(F.lit(seed).cast("long"), F.col(row_col).cast("long"))
    df = rows.select(F.col(row_col).cast("long").alias("row_number"), d.alias("_d"))
    offset = F.pmod(_uint(F.col("_d"), 0, 8), F.lit(PERIOD_SECONDS)).cast("long")
    cents0 = (F.pmod(_uint(F.col("_d"), 8, 4), F.lit(AMOUNT_RANGE)) - AMOUNT_OFFSET).cast("long")
    cents = F.when(cents0 == 0, F.lit(1)).otherwise(cents0)
    cat_idx = F.pmod(_uint(F.col("_d"), 12, 4), F.lit(len(CATEGORIES))).cast("int")
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(START_AT)) + offset)
    absc = F.abs(cents)
    amount = F.concat(F.when(cents < 0, F.lit("-")).otherwise(F.lit("")),
                      (absc / 100).cast("long").cast("string"), F.lit("."),
                      F.lpad(F.pmod(absc, F.lit(100)).cast("string"), 2, "0"))
    return df.select(
        "row_number",
        F.format_string("txn-%012d", F.col("row_number")).alias("transaction_id"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"),
        amount.alias("amount"),
        F.get(cats, cat_idx).alias("category"))


def generate_csv(spark: SparkSession, out_dir: str, n_rows: int, seed: int = 42, files: int = 1) -> str:
    """Write ``n_rows`` rows as ``files`` CSV files (header in each, LF),
    rows split into contiguous ranges; returns ``out_dir``."""
    from ledgerline.plans.derived import write_csv_files
    parts = max(1, files)
    rng = spark.range(1, n_rows + 1, numPartitions=max(parts, spark.sparkContext.defaultParallelism))
    rows = synthetic_rows(rng.withColumnRenamed("id", "row_number"), seed)
    lines = rows.select(((F.col("row_number") - 1) * parts / n_rows).cast("int").alias("part"),
                        "row_number", F.concat_ws(",", "transaction_id", "occurred_at", "amount", "category").alias("value"))
    header = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(0).cast("long").alias("row_number"),
                                       F.lit(",".join(C.EXPECTED_HEADER)).alias("value"))
    ranges = header.unionByName(lines).repartitionByRange("part", "row_number").sortWithinPartitions("part", "row_number")
    return write_csv_files(spark, ranges.select("part", "value"), "part", out_dir)


DIGEST_CHUNK = 8 << 20


def _digests(batches):
    """SHA-256 and size of each file, read in chunks of fixed size."""
    import re
    from urllib.parse import quote

    import pyarrow.fs as pafs
    for pdf in batches:
        out = []
        for p in pdf["path"]:
            if p.startswith(("file:", "/")):
                fs, rel = pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", p)
            else:
                fs, rel = pafs.FileSystem.from_uri(quote(p, safe=":/@"))
            digest, size = hashlib.sha256(), 0
            with fs.open_input_stream(rel) as f:
                while chunk := f.read(DIGEST_CHUNK):
                    digest.update(chunk)
                    size += len(chunk)
            out.append((p, size, digest.hexdigest()))
        yield pd.DataFrame(out, columns=["path", "bytes", "sha256"])


def digests(files: DataFrame) -> DataFrame:
    """path, bytes, sha256 for the files of ``files`` (path), of any size: a
    file is one ordered stream through one task in constant memory."""
    return files.select("path").mapInPandas(_digests, "path string, bytes long, sha256 string")


def fingerprint(spark: SparkSession, paths) -> DataFrame:
    """SHA-256, byte size and data-row count per file. The digest is a
    stream per file, the rows come from the splittable text scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path")
    rows = (spark.read.option("recursiveFileLookup", "true").text(paths)
            .groupBy(F.col("_metadata.file_path").alias("path")).agg((F.count("*") - 1).alias("rows")))
    return digests(files).join(rows, "path", "left")
