"""Words are looked up in the memo, not encoded anew with every mark."""

import numpy as np
import pyarrow as pa

from ledgerline.llm.encoding import ChunkEncoder, public_path


def test_a_word_is_encoded_once_beside_any_mark():
    e = ChunkEncoder(public_path("word_bpe_49k.json"), True)
    want = e.whole(["Wort wort, WORT. Wort!! Größe (größe) GRÖSSE's grösse"])[0]
    calls = []
    whole = e.whole
    e.whole = e.words.whole = lambda t: calls.append(t) or whole(t)
    text = "Wort wort, WORT. Wort!! Größe (größe) GRÖSSE's grösse"
    (_, ids), = e.column(pa.array([text]))
    assert np.array_equal(ids, want) and not calls
    letters = "".join(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x250)]))
    texts = [x for a in letters for x in (a, f"x{a}y", f"{a}'s", f"'{a}", f"1{a}1", f"Ab{a}.", f".{a}!", f"{a}́ {a}")]
    e.whole = e.words.whole = whole
    for t, (_, ids) in zip(texts, e.column(pa.array(texts)), strict=True):
        assert np.array_equal(ids, whole([t])[0]), t
