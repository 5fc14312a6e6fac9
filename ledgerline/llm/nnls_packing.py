"""Packing by non-negative least squares over shallow length combinations.

A document's ids, then one end id, are cut into windows of ``capacity`` ids and
a remainder; both are pieces. Lengths are at most ``capacity``, so their
histogram, whose size does not grow with the data, holds all that a plan needs:

1. combinations of lengths that fill a window exactly are enumerated: a^m,
   a^m b^n and a + b + c, over the lengths that occur;
2. min |A x - h|, x >= 0, gives how often each is repeated (A: how many pieces
   of a length a combination takes, h: the histogram);
3. x is rounded down, then combinations are repeated while their counts last;
4. residual pieces are packed greedily, longest first, end to end; a piece that
   meets a window's end is cut there. What is left beside whole windows goes
   into sequences of descending powers of two, so nothing is padded.

Every piece knows its rank among the pieces of its length: its place in its
task's count plus the counts of earlier tasks. A rank finds its combination,
sequence and offset by binary search, so no rows are sorted and a length that a
third of the pieces have stays spread over all tasks.

Defined results: a null or empty text is one piece with the end id alone;
repeated rows are packed once each; null ids are kept; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, sized, staged, table
from ledgerline.llm.encoding import chunk_encoder, public_path

CAPACITY = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Steps of the solver, and the relative change of the residual that ends it.
STEPS = 400
TOLERANCE = 1e-7


def window_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                  vocabulary: str | None = None) -> DataFrame:
    """One row per piece: its task and its row there, doc_id, start, length,
    ids_crc32, doc_tokens, its place among the task's pieces of that length,
    and its ids unless it fills a window."""
    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = chunk_encoder(vocabulary or public_path(VOCABULARY), True)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        done = 0
        for b in batches:
            source, out = [], []
            for r, (_, ids) in enumerate(encoding.column(b.column(1))):
                ids = np.append(ids, np.array(END_ID, dtype="<u4"))
                for lo in range(0, len(ids), capacity):
                    raw = ids[lo:lo + capacity].tobytes()
                    n = len(raw) // 4
                    source.append(r)
                    out.append((lo, n, zlib.crc32(raw), len(ids), int(seen[n]), raw if n < capacity else None))
                    seen[n] += 1
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(out), part, dtype=np.int32)), pa.array(np.arange(done, done + len(out))),
                 b.column(0).take(pa.array(source, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[:5]],
                 pa.array(cols[5], pa.binary())],
                names=["part", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "ids"])
            done += len(out)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        cut_windows, "part int, row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                     "nth long, ids binary")


def combinations(have: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and their repeats (rows of three, unused places 0) of the
    combinations of the lengths ``have`` that fill ``capacity`` exactly."""
    have = np.sort(have[(have > 0) & (have <= capacity)])
    occurs = np.zeros(capacity + 1, dtype=bool)
    occurs[have] = True
    lengths, repeats = [], []

    def add(ls: list, rs: list) -> None:
        lengths.append(np.stack(np.broadcast_arrays(*ls), axis=-1).reshape(-1, 3))
        many = np.zeros(len(lengths[-1]), dtype=np.int64)
        repeats.append(np.stack([many + r for r in rs], axis=-1))

    for a in have[::-1].tolist():
        below = have[have < a]
        for m in range(1, capacity // a + 1):
            rest = capacity - m * a
            if rest == 0:
                add([a, 0, 0], [m, 0, 0])
                continue
            b = below[rest % below == 0]
            add([a, b, 0], [m, rest // b, 0])
        c = capacity - a - below
        fits = (c > 0) & (c < below)
        fits[fits] = occurs[c[fits]]
        add([a, below[fits], c[fits]], [1, 1, 1])
    if not lengths:
        return np.zeros((0, 3), dtype=np.int64), np.zeros((0, 3), dtype=np.int64)
    return np.concatenate(lengths).astype(np.int64), np.concatenate(repeats).astype(np.int64)


def solve(counts: np.ndarray, lengths: np.ndarray, repeats: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|: projected gradient steps with
    momentum, each coordinate's step bounded by the column sums of A'A."""
    if not len(lengths):
        return np.zeros(0)
    h = counts.astype(np.float64)
    scale = h.max() or 1.0
    h = h / scale

    def times(x: np.ndarray) -> np.ndarray:  # A x; place 0 of the histogram takes the unused places
        out = np.bincount(lengths.ravel(), (repeats * x[:, None]).ravel(), minlength=len(h))
        out[0] = 0
        return out

    def transposed(r: np.ndarray) -> np.ndarray:
        return (r[lengths] * repeats).sum(axis=1)

    bound = transposed(times(np.ones(len(lengths))))
    x = np.zeros(len(lengths))
    ahead, t, before = x, 1.0, np.inf
    for _ in range(steps):
        residual = times(ahead) - h
        new = np.maximum(ahead - transposed(residual) / bound, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        error = float(residual @ residual)
        if error > before:  # momentum overshot: start it anew
            t_new, ahead = 1.0, new
        else:
            ahead = new + (t - 1) / t_new * (new - x)
        if abs(before - error) <= TOLERANCE * max(error, 1e-30):
            x = new
            break
        x, t, before = new, t_new, error
    return x * scale


def repeat_counts(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns that fill a window and how often each is used; together they
    take at most ``counts[n]`` pieces of length n."""
    left = counts.astype(np.int64).copy()
    lengths, repeats = combinations(np.flatnonzero(left), capacity)
    x = solve(left, lengths, repeats)
    used = np.zeros(len(x), dtype=np.int64)
    order = np.argsort(-x, kind="stable")
    for rounded in (True, False):  # the rounded solution, then what the counts still allow
        for j in order.tolist():
            if rounded and x[j] < 1:
                break
            need = [(n, k) for n, k in zip(lengths[j].tolist(), repeats[j].tolist()) if k]
            most = min(int(left[n]) // k for n, k in need)
            take = min(most, int(x[j])) if rounded else most
            if take:
                used[j] += take
                for n, k in need:
                    left[n] -= take * k
    return [(tuple(n for n, k in zip(lengths[j].tolist(), repeats[j].tolist()) for _ in range(k)), int(used[j]))
            for j in np.flatnonzero(used).tolist()]


def tail_sizes(n: int) -> list[int]:
    """``n`` as descending powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Layout:
    """Where the piece of a length and rank lies: first the patterns' pieces by
    rank, then the residual ones, longest first, on one line of sequences."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY):
        self.capacity = capacity
        patterns = repeat_counts(counts, capacity)
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        rows, seq = [], 0
        for pattern, times in patterns:
            at = 0
            for n in pattern:
                rows.append((n, int(self.used[n]), seq, at))
                self.used[n] += times
                at += n
            seq += times
        rows.sort()
        a = np.array(rows, dtype=np.int64).reshape(-1, 4)
        self.base = np.concatenate(([0], np.cumsum(self.used)))  # planned pieces of smaller lengths
        self.starts, self.lo, self.seq, self.offset = self.base[a[:, 0]] + a[:, 1], a[:, 1], a[:, 2], a[:, 3]
        self.first_poured = seq
        left = counts - self.used
        tokens = left * np.arange(capacity + 1)
        self.line = tokens.sum() - np.cumsum(tokens)  # where the residual pieces of a length begin
        total = int(tokens.sum())
        whole = total // capacity
        # ends of the last sequences; before them every window is full
        self.tail = whole * capacity + np.concatenate(([0], np.cumsum(tail_sizes(total - whole * capacity))))
        self.tail = self.tail.astype(np.int64)

    def place(self, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """row, ids skipped, ids taken, sequence, offset: a row for every part
        of every piece."""
        row = np.arange(len(n))
        planned = rank < self.used[n]
        p = row[planned]
        at = np.searchsorted(self.starts, self.base[n[p]] + rank[p], "right") - 1
        parts = [(p, np.zeros(len(p), dtype=np.int64), n[p], self.seq[at] + rank[p] - self.lo[at], self.offset[at])]
        todo, skip = row[~planned], np.zeros(int((~planned).sum()), dtype=np.int64)
        line = self.line[n[todo]] + (rank[todo] - self.used[n[todo]]) * n[todo]
        while len(todo):
            where = line + skip
            full = where < self.tail[0]
            k = np.searchsorted(self.tail, where, "right") - 1
            begin = np.where(full, where // self.capacity * self.capacity, self.tail[np.maximum(k, 0)])
            end = np.where(full, begin + self.capacity, self.tail[np.minimum(np.maximum(k, 0) + 1, len(self.tail) - 1)])
            seq = self.first_poured + np.where(full, where // self.capacity, self.tail[0] // self.capacity + k)
            take = np.minimum(n[todo] - skip, end - where)
            parts.append((todo, skip, take, seq, where - begin))
            more = skip + take < n[todo]
            todo, skip, line = todo[more], (skip + take)[more], line[more]
        return tuple(np.concatenate(x) for x in zip(*parts))


def pack_windows(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (stored; see ``window_pieces``) placed in sequences: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    per = cut(found.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    layout = Layout(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = cut(per.select(F.col("length").alias("p_length"), F.col("part").alias("p_part"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    ranked = found.join(sized(per), (F.col("length") == F.col("p_length")) & (F.col("part") == F.col("p_part"))).select(
        "part", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(4).to_numpy()
            row, skip, take, seq, offset = layout.place(n, b.column(7).to_numpy())
            of = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*of.columns[:3], pa.array(of.column(3).to_numpy() + skip), pa.array(take),
                 pa.array(of.column(5).to_numpy(), mask=take < n[row]), of.column(6), pa.array(seq), pa.array(offset),
                 pa.array(skip)],
                names=["part", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                       "skip"])

    placed = staged(ranked.mapInArrow(
        place, "part int, row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
               "sequence_id long, offset long, skip long"), "placed")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    parts = placed.filter(F.col("ids_crc32").isNull()).drop("ids_crc32")
    # ids of a cut piece: bytes of its stored ids
    some = F.expr("substring(ids, int(skip * 4 + 1), int(length * 4))")
    stored = found.filter(F.col("ids").isNotNull()).select(F.col("part").alias("p_part"), F.col("row").alias("p_row"), "ids")
    resolved = sized(parts).join(stored, (F.col("part") == F.col("p_part")) & (F.col("row") == F.col("p_row")))
    return placed.filter(F.col("ids_crc32").isNotNull()).select(*names).unionByName(
        resolved.withColumn("ids_crc32", F.crc32(some)).select(*names))


def pack_by_least_squares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                          vocabulary: str | None = None) -> DataFrame:
    return pack_windows(staged(window_pieces(docs, id_col, text_col, capacity, vocabulary), "windows"), capacity)


def op13_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_least_squares(table(spark, sf_dir, "documents"))
