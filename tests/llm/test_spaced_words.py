"""Words of the byte-level vocabulary are looked up, not encoded anew with every mark."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm.encoding import BATCH_CHARS, ChunkEncoder, public_path

KINDS = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]
LETTERS = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2070)]))
MARKED = "Wort wort, Wort. Wort!! (Größe) “Wort” Wort’s don't 'sWort \n\n  Wort\tWort 12ab 1½ \r\n"


def test_a_word_is_encoded_once_beside_any_mark():
    e = ChunkEncoder(public_path("byte_bpe_50k.json"))
    text = MARKED.replace("½", "")
    want = e.whole([text])[0]
    calls, words = [], []
    whole, model = e.whole, e.words.tokenize
    e.whole = lambda t: calls.append(t) or whole(t)
    e.words.tokenize = lambda w: words.append(w) or model(w)
    (_, ids), = e.column(pa.array([text]))
    assert np.array_equal(ids, want) and not calls
    assert len(words) == len(set(words))


@pytest.mark.parametrize("name, drops", KINDS)
def test_words_beside_any_letter_mark_or_space(name, drops):
    e = ChunkEncoder(public_path(name), drops, memo_chunks=300)
    texts = [x for a in LETTERS for x in (
        a, f" {a}", f"x{a}y", f"X {a} {a}Y", f"{a}'s 's{a}", f"'{a}", f" '{a}", f"1{a}1 {a}2", f".{a}! {a}.", f"{a}\n{a} ")]
    spaces = ["a  b", "a \n b", "\n\n", " \x0b\x0c x", "x\t\t\ty ", "\r\n \r\n", "  ", "!  \n! "]
    texts += spaces + [f"漢 {MARKED}", MARKED, MARKED * 3, "x<|endoftext|> y", "a" * 100_000, "ab, " * (BATCH_CHARS // 2)]
    for t, (_, ids) in zip(texts, e.column(pa.array(texts)), strict=True):
        assert np.array_equal(ids, e.whole([t])[0]), t[:80]
