"""Recall of the nearest neighbours at the registered factor, many cells."""

import numpy as np

from ledgerline.llm import vantage_tree


def test_recall_at_the_registered_factor(spark):
    r = np.random.default_rng(11)
    centres = r.normal(size=(40, 16)) * 2
    v = centres[r.integers(0, 40, 3000)] + r.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for x in vantage_tree.nearest(df, df.filter("vec_id % 20 = 0"), factor=vantage_tree.FACTOR, shard_rows=64).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    assert set(got) == set(range(0, 3000, 20))
    found = 0
    for q, ids in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        found += len(ids & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert found >= 0.9 * 10 * len(got)
