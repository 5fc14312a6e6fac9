"""Packing by least squares: round trips against the library's own ids."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import nnls_packing as N

SCHEMA = "doc_id long, text string, length long, part int, row string, n int"


def reference(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in rows]


def check(rows, got, capacity=N.CAPACITY):
    docs = reference(rows)
    by_id = {}
    for i, ids in docs:
        by_id.setdefault(i, []).append(ids)
    for g in got:
        assert any(g.doc_tokens == len(ids) and zlib.crc32(np.array(ids[g.start:g.start + g.length], dtype="<u4").tobytes())
                   == g.ids_crc32 for ids in by_id[g.doc_id]), g
    spans = {}
    for g in got:
        spans.setdefault((g.doc_id, g.doc_tokens), []).append((g.start, g.length))
    for i, lists in by_id.items():
        for size in {len(x) for x in lists}:
            copies = sum(len(x) == size for x in lists)
            cover = np.zeros(size, dtype=int)
            for lo, n in spans.get((i, size), []):
                cover[lo:lo + n] += 1
            assert (cover == copies).all()
    seqs = {}
    for g in got:
        seqs.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in seqs.values():
        at = 0
        for lo, n in sorted(parts):
            assert lo == at and n > 0
            at += n
        assert at <= capacity and at & (at - 1) == 0  # nothing is padded


def test_documents(spark):
    r = np.random.default_rng(5)
    words = ["the", "cat's", "Überfluß", "2024", "<|endoftext|>", "x\x1cy", "don't", "naïve"]
    rows = [(k, " ".join(r.choice(words, int(r.integers(0, 900))))) for k in range(80)]
    rows += [(900, "long " * 9000), (901, None), (902, ""), (903, " \n"), (None, "no id"), (None, "no id"), (5, rows[5][1])]
    rows += [(1000 + k, "a hot length") for k in range(400)]
    df = spark.createDataFrame([(*x, 1, 2, "r", 3) for x in rows], SCHEMA).repartition(5)
    got = N.pack_by_least_squares(df).collect()
    check(rows, got)
    assert N.pack_by_least_squares(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, N.op13_least_squares_packing(spark, sf).collect())


@pytest.mark.parametrize("capacity", [16, 64])
def test_combinations(capacity):
    r = np.random.default_rng(capacity)
    have = np.unique(r.integers(1, capacity + 1, 12))
    lengths, repeats = N.combinations(have, capacity)
    got = {tuple(sorted((n, k) for n, k in zip(a, b) if k)) for a, b in zip(lengths.tolist(), repeats.tolist())}
    want = set()
    for a in have.tolist():
        for m in range(1, capacity // a + 1):
            if m * a == capacity:
                want.add(((a, m),))
            for b in have.tolist():
                rest = capacity - m * a
                if a != b and rest > 0 and rest % b == 0:
                    want.add(tuple(sorted(((a, m), (b, rest // b)))))
        for b in have.tolist():
            c = capacity - a - b
            if a > b > c > 0 and c in have:
                want.add(tuple(sorted(((a, 1), (b, 1), (c, 1)))))
    assert got == want and len(got) == len(lengths)


def test_solver_meets_its_conditions():
    r = np.random.default_rng(3)
    counts = np.zeros(65)
    counts[1:] = r.integers(0, 1000, 64)
    lengths, repeats = N.combinations(np.flatnonzero(counts), 64)
    x = N.solve(counts, lengths, repeats, steps=4000)
    a = np.zeros((65, len(x)))
    for j in range(len(x)):
        for n, k in zip(lengths[j], repeats[j]):
            if k:
                a[n, j] += k
    grad = a.T @ (a @ x - counts)
    assert (x >= 0).all() and grad.min() > -2 and np.abs(x * grad).max() < 2 * x.max()
    packed = N.repeat_counts(counts.astype(int), 64)
    used = np.zeros(65, dtype=int)
    for pattern, times in packed:
        assert sum(pattern) == 64
        for n in pattern:
            used[n] += times
    left = counts - used
    assert (left >= 0).all()
    for a, b in zip(lengths, repeats):  # no combination is left in the counts
        assert any(left[n] < k for n, k in zip(a, b) if k)
    assert sum(x) >= 0.9 * sum(t for _, t in packed)  # rounding keeps near the solution


def test_tail():
    assert N.tail_sizes(0) == [] and N.tail_sizes(2047) == [1 << k for k in range(10, -1, -1)] and N.tail_sizes(5) == [4, 1]
