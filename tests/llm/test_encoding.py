"""Chunk-wise ids equal the library's."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.encoding import BATCH_CHARS, ChunkEncoder, public_path

KINDS = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]
ODD = ["a\x1c b\x1d", " \t  x", "x \n \n", "<|endoftext|> a", "a<|startoftext|>b <|end", " " * 1_000_000, "x" * 100_000 + " y",
       "é́ ́a", "ΑΣ ΣΑΣ.", "don't can 't", "İ ı ﬁ", "", None, "  a 　", "1234 5 6\r\n\r\nq",
       "ab cd " * (BATCH_CHARS // 4) + "\n\n end"]


@pytest.fixture(scope="module")
def encoders():
    return [ChunkEncoder(public_path(n), d, memo_chunks=50) for n, d in KINDS]


def same(e, texts):
    for text, ids in zip(texts, [i for _, i in e.column(pa.array(texts))], strict=True):
        assert np.array_equal(ids, e.whole([text or ""])[0]), (text or "")[:60]


def test_odd_texts(encoders):
    for e in encoders:
        same(e, ODD)
        for t in ODD:
            same(e, [t])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="ab'sS \t\n\r\x1c\x85  é́Σσ1<|>.,!")), max_size=6))
def test_any_text(texts):
    for n, d in KINDS:
        same(_encoder(n, d), texts or [""])


_HELD: dict = {}


def _encoder(n, d):
    if n not in _HELD:
        _HELD[n] = ChunkEncoder(public_path(n), d, memo_chunks=200)
    return _HELD[n]
