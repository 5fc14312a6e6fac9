"""Whitening against exact rational arithmetic and numpy."""

from fractions import Fraction

import numpy as np
import pytest

from ledgerline.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, i int, d string"


def integers(v):
    return [int(np.floor(float(c) * 1024)) + 100_000 for c in v]


def usable(rows):
    return [(i, integers(v)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]


def check(rows, got):
    """``rows`` all of one length, ``got`` the query's rows for them."""
    kept = usable(rows)
    n, d = len(kept), len(kept[0][1])
    s = [sum(x[k] for _, x in kept) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for _, x in kept), n ** 3))
                     for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == n * min(8, d)
    deviation = sorted((i is None, i or 0, sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in kept)
    one = sorted((r.vec_id is None, r.vec_id or 0, int(r.deviation_exact)) for r in got if r.component == 1)
    assert one == deviation
    assert all(r.deviation == (int(r.deviation_exact) if int(r.deviation_exact) < 2**63 else None) for r in got)
    x = {i: np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)]) for i, x in kept}
    for c in range(min(8, d)):
        mine = [r for r in got if r.component == c + 1]
        if e[c] <= 1e-12 * e[0]:
            assert all(r.whitened is None for r in mine)
            continue
        assert all(abs(r.explained - e[c] / np.trace(cov)) <= 1e-6 * r.explained for r in mine)
        a = np.array([r.whitened for r in mine])
        b = np.array([x[r.vec_id] @ v[:, c] / np.sqrt(e[c]) for r in mine])
        if min((abs(e[c] - e[k]) for k in range(d) if k != c), default=1) > 1e-6 * e[0]:
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_random_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in r.normal(size=12) * np.arange(1, 13) / 9 + 3]) for k in range(300)]
    rows += [(300, rows[5][1]), (5, rows[5][1]), (301, None), (302, [None] * 12), (303, [float("nan")] * 12),
             (304, [1.0] * 11 + [float("inf")]), (305, [])]
    df = spark.createDataFrame([(*x, 1, 2, "d") for x in rows], SCHEMA).repartition(5)
    got = W.whiten(df).collect()
    # copies of id 5 have equal values, so one entry each
    check([x for x in rows], got)


def test_few_large_and_mixed_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, ""), (2, [1.0, 3.0], 0, 0, ""), (3, [4.0], 0, 0, ""),
                                (None, [5.0], 0, 0, "")], SCHEMA)
    got = W.whiten(df).collect()
    check([(3, [4.0]), (None, [5.0])], [r for r in got if r.vec_id in (3, None)])
    two = sorted(((r.vec_id, r.component), r) for r in got if r.vec_id in (1, 2))
    assert [k for k, _ in two] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert [r.n for _, r in two] == [2] * 4 and two[1][1].whitened is None and abs(abs(two[0][1].whitened) - 1) < 1e-12
    same = W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, "")] * 3, SCHEMA)).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(3, 0, None, None, None)}
    huge = [(k, [3e38 if k == 1 else float(k * 1000), 0.5 * k]) for k in range(6)]
    big = W.whiten(spark.createDataFrame([(*x, 1, 2, "") for x in huge], SCHEMA)).collect()
    assert len(big) == 12 and all(int(r.deviation_exact) > 0 for r in big) and big[0].identity_error < 1e-4


def test_empty(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_square_sums_stay_exact():
    y = np.array([[1 << 60, 3], [-(1 << 60), 4]])
    assert W._square_sums(y) == [1 << 121, 25]
    assert W._exact_sums(np.array([[(1 << 60)], [(1 << 60)], [-5]] * 9)) == [18 * (1 << 60) - 45]
    for v in (0, 7, -(1 << 130) - 12345, 1 << 190):
        assert sum(x << W._LIMB * k for k, x in enumerate(W._limbs(v))) == v


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query(spark, sf):
    got = W.op12_whitening(spark, f"/root/testdata/{sf}").collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    check(rows[:0] + rows, got)
