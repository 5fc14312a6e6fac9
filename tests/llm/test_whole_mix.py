"""The pipeline's mix takes whole documents: compared with plain Python."""

import hashlib
import re
from collections import Counter

import corpus_pipeline

SF = "/root/testdata/sf0.001"
WEIGHTS = (3.0, 1.0, 2.0)


def plain_mix(rows):
    """How often each id is taken, and each source's target."""
    sources = {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        key = int(hashlib.md5("\n".join([str(r.doc_id), r.source or "", r.text or ""]).encode()).hexdigest()[:15], 16)
        sources.setdefault(r.source, []).append((key, r.doc_id, n))
    names = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for *_, n in sources[s]) for s in names}
    w = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    wanted, open_, goal = 1.5 * sum(size.values()), set(names), {}
    while open_:
        level = (wanted - sum(goal.values())) / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > 2 * size[s]]
        for s in full or list(open_):
            goal[s] = 2 * size[s] if full else level * w[s]
            open_.discard(s)
    taken = Counter()
    for s in names:
        for k in range(2):
            at = k * size[s]
            for _, i, n in sorted(sources[s]):
                if n and at + n / 2 < round(goal[s]):
                    taken[i] += 1
                at += n
    return taken, goal


def test_mix_takes_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    text, source = {r.doc_id: r.text for r in rows}, {r.doc_id: r.source for r in rows}
    taken, goal = plain_mix(rows)
    got = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert all(r.text == text[r.doc_id] and r.source == source[r.doc_id] for r in got)
    assert Counter(r.doc_id for r in got) == taken
    for s, target in goal.items():
        sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in got if r.source == s]
        largest = max(len((r.text or "").split()) for r in rows if r.source == s)
        assert abs(sum(sizes) - target) <= largest / 2 + 0.5
