"""run() on the fixture against plain Python for all five stages."""

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from ledgerline.llm import packing
from test_whole_mix import plain_mix

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def kept(rows):
    """Documents with a letter, one of equal texts, one of each near class."""
    rows = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r)
    rows = list(first.values())
    sets = []
    for r in rows:
        w = re.findall(WORD, r.text)
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                lo, hi = sorted((find(x), find(y)))
                parent[hi] = lo
    return [r for k, r in enumerate(rows) if find(k) == k]


def test_run_equals_plain_python(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.public_vocabulary("byte_bpe_50k.json"))
    rows = kept(spark.read.parquet(f"{SF}/documents.parquet").collect())
    text = {r.doc_id: r.text for r in rows}
    want = Counter()
    for i, times in plain_mix(rows)[0].items():
        ids = np.array(tok.encode(text[i], add_special_tokens=False).ids + [0], dtype="<u4")
        lo = 0
        for p in range(-(-len(ids) // 2048)):
            hi = (len(ids) - 1) % 2048 + 1 + p * 2048
            want[i, p, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += times
            lo = hi
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
