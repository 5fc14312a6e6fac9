"""Substring dedup by seed and extend.

Seeds: the words of every text are winnowed. Of the ``SEED_WORDS``-word hashes
inside each window of ``length`` words the smallest one (the leftmost among
equals) is the window's anchor, a choice that depends on the window's words
alone; so equal windows have equal anchors at equal places. Windows with the
same anchor stand side by side: they make one stretch, the text from the first
window's start to the last one's end.

Join and extend: stretches meet on their anchor hash. Two stretches with the
same anchor and the same words around it are one content (the extension both
ways reaches their ends): all their windows repeat, and the smallest id of a
content comes from one aggregation, so copies are never paired. Contents that
share an anchor but differ further out are extended window by window: the
words left and right of the anchor are compared through the hash of each
window that holds the anchor, one row per distinct content, and the smallest
id of each window again comes from one aggregation. Nothing is paired, so a
passage in a third of the documents costs a row for each of its documents.

Maximal repeats: covered words of adjoining windows unite to runs, which are
removed. Hashes: anchor 64 bits and content or window 128 bits must all agree.

Defined results: null and empty texts have no words; texts of fewer than
``length`` words keep all; rows with the same id are one document for "smaller
id", so a repeat inside one id is never removed; null ids come last, among
themselves nothing is removed; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import common as K
from ledgerline.llm.common import sized, staged, table

LENGTH = 50
SEED_WORDS = 8
_BASE2 = 0xD1342543DE82EF95
_LOW = np.uint64(0xFFFFFF)  # positions inside a slice, under the anchor hashes
#: Null ids as the largest id.
NO_ID = (1 << 63) - 1
#: Ids of documents stay at or below this; numbers above it stand for null ids.
FLOOR = NO_ID - (1 << 40)


def stretches(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = SEED_WORDS):
    """Winnowed stretches of a slice: (row, first window, end of windows,
    words before the row, place of the anchor, anchor hash) and both running
    sums of the word hashes."""
    s, e, first = K.words(data, offs)
    wh = K.word_hashes(data, s, e)
    sums, sums2 = K.prefix_sums(wh), K.prefix_sums(wh, _BASE2)
    n = len(wh)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, first, none, none.astype(np.uint64), sums, sums2
    lo = np.arange(n - k + 1)
    seed = K.span_hash(sums, lo, lo + k)
    # position under a 40-bit hash: the least is the smallest hash, leftmost first
    m = (seed & ~_LOW) | (lo.astype(np.uint64) & _LOW)
    width, have = length - k + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:len(m) - have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[:len(m) - (width - have)], m[width - have:])
    start = np.arange(n - length + 1)
    row = np.searchsorted(first, start, "right") - 1
    inside = start + length <= first[row + 1]
    start, row, m = start[inside], row[inside], m[inside]
    # a slice may be longer than positions reach: the high part comes from the window's start
    at = (m & _LOW).astype(np.int64) | (start & ~np.int64(0xFFFFFF))
    at = np.where(at < start, at + (1 << 24), at)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    f = np.flatnonzero(new)
    end = np.append(start[f[1:] - 1], start[-1]) + 1 if len(f) else none
    return row[f], start[f], end, first, at[f], seed[at[f]], sums, sums2


def _in_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    return K.mix(key.view(np.uint64) + K.mix(row.astype(np.uint64) + np.uint64(1)))


def _listed(lists: pa.Array, row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each key is in its row's list of longs."""
    lists = lists.fill_null([]) if lists.null_count else lists
    n = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
    have = _in_row(np.repeat(np.arange(len(lists)), n), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    return np.isin(_in_row(row, key), have)


def _window_hashes(i: np.ndarray, at: np.ndarray, s1: np.ndarray, s2: np.ndarray, length: int):
    """128 bits of the windows that start at i and have their anchor at ``at``."""
    shift = K.mix((at - i).astype(np.uint64), 7)
    return (K.span_hash(s1, i, i + length) ^ shift).view(np.int64), K.span_hash(s2, i, i + length, _BASE2).view(np.int64)


def _content_hashes(start: np.ndarray, end: np.ndarray, at: np.ndarray, s1: np.ndarray, s2: np.ndarray, length: int):
    shift = K.mix((at - start).astype(np.uint64), 7)  # the anchor's place counts
    hi = end + length - 1
    return (K.span_hash(s1, start, hi) ^ shift).view(np.int64), K.span_hash(s2, start, hi, _BASE2).view(np.int64)


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window) of every window of the stretches."""
    n = end - start
    each = np.repeat(np.arange(len(n)), n)
    return each, start[each] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def seeds(docs: DataFrame, length: int = LENGTH, k: int = SEED_WORDS) -> DataFrame:
    """One row per stretch of ``docs`` (id, text): id, anchor, c1, c2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offs in K.text_slices(b.column(1)):
                row, start, end, _, at, anchor, s1, s2 = stretches(data, offs, length, k)
                c1, c2 = _content_hashes(start, end, at, s1, s2, length)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row + lo)), pa.array(anchor.view(np.int64)), pa.array(c1), pa.array(c2)],
                    names=["id", "anchor", "c1", "c2"])
    return docs.mapInArrow(run, "id long, anchor long, c1 long, c2 long")


def windows(docs: DataFrame, length: int = LENGTH, k: int = SEED_WORDS) -> DataFrame:
    """id, anchor, w1, w2: the windows around the anchors that ``docs`` (id,
    text, anchors: array of long) lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in K.text_slices(b.column(1)):
                row, start, end, _, at, anchor, s1, s2 = stretches(data, offs, length, k)
                mine = _listed(b.column(2).slice(lo, hi - lo), row, anchor)
                row, start, end, at, anchor = row[mine], start[mine], end[mine], at[mine], anchor[mine]
                each, i = _expand(start, end)
                w1, w2 = _window_hashes(i, at[each], s1, s2, length)
                for a in range(0, len(i), 1 << 17):
                    z = slice(a, a + (1 << 17))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row[each[z]] + lo)), pa.array(anchor[each[z]].view(np.int64)),
                         pa.array(w1[z]), pa.array(w2[z])], names=["id", "anchor", "w1", "w2"])
    return docs.mapInArrow(run, "id long, anchor long, w1 long, w2 long")


def cleaned(docs: DataFrame, length: int = LENGTH, k: int = SEED_WORDS) -> DataFrame:
    """``docs`` (id, text, contents, wins: arrays of long to remove) as id,
    n_words, n_removed, kept_sha256, spans (first word and end of each run
    that was removed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in K.text_slices(b.column(1)):
                row, start, end, first, at, anchor, s1, s2 = stretches(data, offs, length, k)
                s, e, _ = K.words(data, offs)
                cover = np.zeros(len(s) + 1, dtype=np.int64)
                contents, wins = (b.column(c).slice(lo, hi - lo) for c in (2, 3))
                if len(start) and (len(contents.flatten()) or len(wins.flatten())):
                    c1, _ = _content_hashes(start, end, at, s1, s2, length)
                    whole = _listed(contents, row, c1)
                    np.add.at(cover, start[whole], 1)
                    np.add.at(cover, end[whole] + length - 1, -1)
                    some = ~whole & np.isin(row, np.flatnonzero(pa.compute.list_value_length(wins).fill_null(0).to_numpy(
                        zero_copy_only=False)))
                    each, i = _expand(start[some], end[some])
                    w1, _ = _window_hashes(i, at[some][each], s1, s2, length)
                    hit = i[_listed(wins, row[some][each], w1)]
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed, sha, spans = [], [], []
                raw = data.tobytes()
                for r in range(hi - lo):
                    w = slice(first[r], first[r + 1])
                    g = gone[w]
                    n = int(g.sum())
                    text = raw[offs[r]:offs[r + 1]]
                    parts = text.split() if not n else [raw[x:y] for x, y in zip(s[w][~g].tolist(), e[w][~g].tolist())]
                    if n:
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
                        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                    else:
                        spans.append([])
                    removed.append(n)
                    sha.append(hashlib.sha256(b" ".join(parts)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), pa.array(removed, pa.int64()),
                     pa.array(sha, pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["id", "n_words", "n_removed", "kept_sha256", "spans"])
    return docs.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string, "
                                "spans array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   k: int = SEED_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, spans."""
    # rows without id stand behind all others, each text under a number of its own; FLOOR is
    # their common rank, so none of them counts as smaller than another
    text = F.coalesce(docs[text_col], F.lit(""))
    spread = F.lit(NO_ID) - F.pmod(F.xxhash64(text), F.lit(NO_ID - FLOOR))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), spread).alias("id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = staged(seeds(rows, length, k), "sub-seeds")
    content = found.groupBy("anchor", "c1", "c2").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    content = staged(content, "sub-contents")
    # whole stretches that a smaller id has as well
    many = content.filter("n > 1").select(F.col("anchor").alias("m_anchor"), F.col("c1").alias("m1"),
                                          F.col("c2").alias("m2"), "least")
    whole = found.join(many, (F.col("anchor") == F.col("m_anchor")) & (F.col("c1") == F.col("m1"))
                       & (F.col("c2") == F.col("m2")) & (F.col("least") < F.least("id", F.lit(FLOOR)))).select("id", "c1")
    # anchors with several contents: their first documents are compared window by window
    open_ = content.groupBy("anchor").agg(F.count("*").alias("contents"), F.min("least").alias("lo"),
                                          F.max("least").alias("hi")).filter(
        (F.col("contents") > 1) & (F.col("lo") < F.least("hi", F.lit(FLOOR))))
    open_ = staged(open_.select(F.col("anchor").alias("o_anchor")), "sub-open")
    want = staged(content.join(open_, F.col("anchor") == F.col("o_anchor")).groupBy(F.col("least").alias("w_id")).agg(
        F.collect_set("anchor").alias("anchors")), "sub-want")
    some = rows.join(sized(want.select("w_id")), F.col("id") == F.col("w_id"), "left_semi")
    win = staged(windows(some.join(want, F.col("id") == F.col("w_id")).select("id", "text", "anchors"), length, k),
                 "sub-windows")
    least = win.groupBy(F.col("anchor").alias("l_anchor"), F.col("w1").alias("l1"), F.col("w2").alias("l2")).agg(
        F.min("id").alias("least"), F.max("id").alias("most")).filter(
        F.col("least") < F.least("most", F.lit(FLOOR))).drop("most")
    least = staged(least, "sub-least")
    part = win.join(least, (F.col("anchor") == F.col("l_anchor")) & (F.col("w1") == F.col("l1"))
                    & (F.col("w2") == F.col("l2")) & (F.col("least") < F.least("id", F.lit(FLOOR)))).select("id", "w1")
    none = F.lit(None).cast("long")
    marks = whole.select("id", F.col("c1").alias("c"), none.alias("w")).union(
        part.select("id", none.alias("c"), F.col("w1").alias("w")))
    marks = staged(marks.groupBy(F.col("id").alias("k_id")).agg(
        F.collect_set("c").alias("contents"), F.collect_set("w").alias("wins")), "sub-marks")
    # texts with nothing to remove stay out of the shuffle
    ids = sized(marks.select("k_id"))
    empty = F.array().cast("array<long>")
    hit = rows.join(ids, F.col("id") == F.col("k_id"), "left_semi").join(marks, F.col("id") == F.col("k_id")).select(
        "id", "text", "contents", "wins")
    rest = rows.join(ids, F.col("id") == F.col("k_id"), "left_anti").select(
        "id", "text", empty.alias("contents"), empty.alias("wins"))
    out = cleaned(hit.unionByName(rest), length, k)
    return out.withColumn("id", F.when(F.col("id") <= FLOOR, F.col("id")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
