"""Texts that only the contract's encoder handles: markers and very long runs."""

import zlib

import numpy as np

from ledgerline.llm import packing, token_counts

TEXTS = [
    (1, "<|endoftext|> a"), (2, " " * 1_000_000), (3, "one\ntwo <|endoftext|>\n\n<|endoftext|>x é漢字\U0001F600\nend"),
    (4, "a" + " " * 5 + "\n" * 3 + "  b\r\n\tc"), (5, ""), (6, None), (7, "漢" * 3000 + "\n" + "été ß\n" * 200),
]


def reference():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.public_vocabulary("byte_bpe_50k.json"))


def test_pieces_of_markers_and_long_runs(spark):
    tok, want = reference(), []
    for i, t in TEXTS:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        if i == 1:
            assert len(ids) == 3  # the marker is one id
        lo = 0
        for p in range(-(-len(ids) // 2048)):
            hi = (len(ids) - 1) % 2048 + 1 + p * 2048
            want.append((i, p, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
            lo = hi
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pieces(df).collect()]
    assert sorted(got) == sorted(want)


def test_sections_of_markers_and_long_runs(spark):
    """A token belongs to the line that holds its first character (by the
    library's offsets; a token inside a character starts at that character)."""
    tok, want = reference(), {}
    for i, t in TEXTS:
        t = t or ""
        line = np.cumsum([0] + [c == "\n" for c in t])
        n = max(1, len(t.split("\n")) - t.endswith("\n"))
        counts = [0] * n
        for lo, _ in tok.encode(t, add_special_tokens=False).offsets:
            counts[line[lo]] += 1
        want[i] = counts
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    got = {}
    for r in sorted(token_counts.section_tokens(df).collect(), key=lambda r: (r.id, r.section)):
        got.setdefault(r.id, []).append(int(r.n_tokens))
    assert got == want
