"""Short near copies that share a single sketch are one class."""

import numpy as np
import pyarrow as pa

from ledgerline.llm import common, order_minhash


def test_pairs_with_one_common_sketch(spark):
    r = np.random.default_rng(7)
    texts = []
    for _ in range(4000):  # 4 and 5 shingles: similarity 0.8
        w = ["".join(x) for x in r.choice(list("abcdefgh"), (9, 6))]
        texts += [" ".join(w[:8]), " ".join(w)]
    _, _, data, offs = next(common.text_slices(pa.array(texts)))
    keys, before, _, _ = order_minhash.shingles(data, offs)
    sk = order_minhash.sketches(keys, before)
    once = np.flatnonzero((sk[::2] == sk[1::2]).sum(axis=1) == 1)
    assert len(once) > 3
    rows = [(int(2 * k + x), texts[2 * k + x]) for k in once for x in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.id: (x.class_id, x.class_size) for x in order_minhash.near_classes(df).collect()}
    assert got == {i: (i - i % 2, 2) for i, _ in rows}
