"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``capacity`` ids (a document's ids,
then one end id; only longer ones are cut, the first piece takes the odd
length). Lengths are at most ``capacity``, so a histogram of lengths, whose
size does not grow with the data, holds all that a plan needs:

1. from the longest length down, the gap that it leaves is looked up among
   single lengths, sums of two and sums of three, and every combination that
   fills the gap exactly is consumed as often as its counts allow;
2. what is left goes best fit, longest first, into the open sequence group
   with the smallest gap that still takes it.

The plan is a list of patterns with multiplicities (groups of sequences with
the same lengths). Pieces of one length are numbered without a global sort:
rank inside a hash bucket, plus the count of that length in earlier buckets.
A piece's rank finds its pattern, sequence and offset by binary search. No
task sees more than its bucket; a length that a third of the pieces have is
spread over all buckets.

Defined results: a null or empty text is one piece with the end id alone;
repeated rows are packed once each; null ids are kept; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, sized, staged, table
from ledgerline.llm.encoding import MEMO_CHUNKS, SMALL_MEMO, ChunkEncoder, chunk_encoder, public_path

CAPACITY = 2048
END_ID = 0
#: Pieces a bucket holds on average once there are enough of them.
BUCKET_ROWS = 50_000


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    return public_path(name)


def encoder(path: str) -> ChunkEncoder:
    return chunk_encoder(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           vocabulary: str | None = None, keep_memo: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per token piece. With
    ``keep_memo`` a worker holds the encoder's memo for its next task; a job
    with other stages has a small one and gives its memory back."""
    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = chunk_encoder(vocabulary or public_vocabulary(), False, MEMO_CHUNKS if keep_memo else SMALL_MEMO)
        for b in batches:
            rows, out = [], []
            for r, (_, ids) in enumerate(encoding.column(b.column(1))):
                ids = np.append(ids, np.array(END_ID, dtype="<u4"))
                first = (len(ids) - 1) % capacity + 1
                lo = 0
                for p in range(-(-len(ids) // capacity)):
                    hi = first + p * capacity
                    rows.append(r)
                    out.append((p, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
                    lo = hi
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in cols[1:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if not keep_memo:
            encoding.forget()
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        cut_pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``counts[n]`` pieces of length n. Patterns and how often each is used;
    every piece is used once and no pattern is longer than ``capacity``."""
    c = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        """Consume the pattern as often as its counts allow."""
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        times = min(int(c[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                c[x] -= times * n
            out.append((pattern, times))

    for big in range(capacity, 0, -1):
        gap = capacity - big
        if not c[big]:
            continue
        if gap == 0:
            use((big,))
            continue
        top = min(gap, big)  # partners are no longer than the one that leads
        if gap <= big:
            use((big, gap))
        if c[big]:  # sums of two
            a = np.arange(min(top, gap - 1), (gap - 1) // 2, -1)
            for x in a[(c[a] > 0) & (c[gap - a] > 0)].tolist():
                if not c[big]:
                    break
                use((big, x, gap - x))
        if c[big]:  # sums of three
            have = np.flatnonzero(c[:min(top, max(gap - 2, 0)) + 1])[::-1]
            for x in have.tolist():
                if not c[big] or 3 * x < gap:
                    break
                rest = gap - x
                a = np.arange(min(x, rest - 1), (rest - 1) // 2, -1)
                for y in a[(c[a] > 0) & (c[rest - a] > 0)].tolist():
                    if not c[big] or not c[x]:
                        break
                    use((big, x, y, rest - y))

    groups: dict[int, list[list]] = {}  # gap -> [pattern, multiplicity]
    for n in range(capacity, 0, -1):
        left = int(c[n])
        while left:
            gap = min((g for g in groups if g >= n), default=None)
            if gap is None:
                each = min(left, capacity // n)
                times = left // each
                groups.setdefault(capacity - each * n, []).append([(n,) * each, times])
                left -= each * times
                continue
            pattern, times = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
            each = min(gap // n, left)
            used = min(times, left // each)
            if used < times:
                groups.setdefault(gap, []).append([pattern, times - used])
            groups.setdefault(gap - each * n, []).append([pattern + (n,) * each, used])
            left -= each * used
    out.extend((p, t) for g in groups.values() for p, t in g)
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY):
    """The plan as arrays ordered by length and rank: pieces of length n with
    ranks from ``lo`` on go to sequences from ``seq`` on, at ``offset``."""
    cursor = np.zeros(capacity + 2, dtype=np.int64)
    rows, seq = [], 0
    for pattern, times in patterns:
        at = 0
        for n in pattern:
            rows.append((n, int(cursor[n]), seq, at))
            cursor[n] += times
            at += n
        seq += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    base = np.concatenate(([0], np.cumsum(cursor)))  # pieces of smaller lengths
    return base[a[:, 0]] + a[:, 1], a[:, 1], a[:, 2], a[:, 3], base


def pack(found: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``found`` (stored; see ``pieces``) with sequence_id and offset."""
    spark = found.sparkSession
    hist = found.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in hist:
        counts[r["length"]] = r["n"]
    starts, lo, seq, offset, base = slots(plan(counts, capacity), capacity)

    n_buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // bucket_rows))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)).alias("bucket")
    spread = found.select("*", bucket).repartition("bucket")
    per = found.select("length", bucket).groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = cut(per.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select(
        F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket"), "base"))
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = spread.withColumn("r", F.row_number().over(inside) - 1).join(
        sized(per), (F.col("length") == F.col("b_length")) & (F.col("bucket") == F.col("b_bucket")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("r")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(starts, base[n] + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(seq[at] + rank - lo[at]), pa.array(offset[at])],
                names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   vocabulary: str | None = None, keep_memo: bool = False) -> DataFrame:
    return pack(staged(pieces(docs, id_col, text_col, capacity, vocabulary, keep_memo), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), keep_memo=True)
