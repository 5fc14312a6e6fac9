"""Helpers shared by the operators: staging tables in the shared folder,
size-checked broadcasts, word tables and rolling hashes over Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import shared_root

#: A side is broadcast only if its counted rows are at most this many.
BROADCAST_ROWS = 500_000
#: Text is handled in slices of about this many bytes (a longer document is a
#: slice of its own, never cut).
SLICE_BYTES = 1 << 20
#: The same in operators that are stages of the pipeline.
STAGE_SLICE_BYTES = 1 << 18
#: Rows cross to a Python worker in batches of about this many bytes (a row is
#: never cut) where several stages share the executors' memory.
BATCH_BYTES = 4 << 20
#: White space of the word contracts, as a class of a regular expression.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table under ``spark.checkpoint.dir`` and read it
    back: lineage ends in files every executor can read. The table goes when
    the application ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``staged`` for small intermediate tables. A written table costs one job
    (``checkpoint()`` computes the rows twice) and has a known size."""
    return staged(df, "cut")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by their bytes: a batch of long texts stands
    several times in the memory of the executor and of its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored ``df`` for broadcast if its row count is within the bound;
    beyond it the join stays a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_CLASS + "+", " ")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has (in any case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def keep_one(df: DataFrame, twice: DataFrame, on: dict[str, str]) -> DataFrame:
    """Of the rows of ``df`` that share a key listed in the stored table
    ``twice`` one stays: the smallest hash of all columns. ``on`` maps columns
    of ``df`` to those of ``twice``; nulls are equal."""
    if twice.isEmpty():
        return df
    mark = fresh(df, "mark")
    same = F.lit(True)
    for a, b in on.items():
        same = same & df[a].eqNullSafe(F.col(b))
    marked = df.join(sized(twice), same, "left_semi").withColumn(mark, F.xxhash64(*df.columns))
    least = cut(marked.groupBy(*[F.col(a).alias("p_" + b) for a, b in on.items()]).agg(F.min(mark).alias("p_mark")))
    pick = marked[mark] == F.col("p_mark")
    for a, b in on.items():
        pick = pick & marked[a].eqNullSafe(F.col("p_" + b))
    one = marked.join(sized(least), pick, "left_semi").dropDuplicates(list(on)).drop(mark)
    return df.join(sized(twice), same, "left_anti").unionByName(one)


# ---- Arrow text and words ------------------------------------------------

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 4 * SLICE_BYTES:  # an outlier's table is not kept
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (murmur3's constants)."""
    x = x ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[k] * base**k over i <= k < j."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * powers(base, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of values[lo:hi], the same wherever the run stands."""
    inv = powers(pow(base, -1, 1 << 64), len(sums))
    return mix((sums[hi] - sums[lo]) * inv[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in the bytes) over a
    string column; null counts as empty."""
    col = col.fill_null("").cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, ob, db = col.buffers()
    if len(col) == 0:
        return
    offs = np.frombuffer(ob, dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset:]
    data = np.frombuffer(db, dtype=np.uint8) if db is not None and db.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (in bytes), and how many words stand
    before each row (one entry more than rows)."""
    word = ~_SEP[data]
    start, end = word.copy(), word.copy()
    if len(data):
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        edges = offs[1:-1]
        first = edges[edges < len(data)]
        start[first] = word[first]
        last = edges[edges > 0] - 1
        end[last] = word[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    sums = prefix_sums(data.astype(np.uint64) + np.uint64(1))
    return span_hash(sums, s, e)
