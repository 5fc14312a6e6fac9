"""Token ids of whole texts, each distinct word or chunk encoded once.

Where the vocabulary's own rules are known (``WORDS``), a text of Latin
letters, digits, common marks and white space is cut into words as they cut it.
No token reaches over such a cut, so a text's ids are its words' ids in order:
common words come from a bounded memo of two generations, and a word that the
memo lacks costs one call of the library's model, whatever marks it stands
beside.

Other texts are cut into chunks: a run of white space with the other characters
that follow it, or, for a vocabulary that drops white space, the run of other
characters alone. These come from such a memo too; of the chunks that it lacks
those of the characters above are cut into words, the rest go to `tokenizers`
together, one of its added tokens between them. Texts with an added token's own
spelling, or with a separator control character (white space to some and not to
others), go to it whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts handled at once (a longer text is handled in segments, never cut).
BATCH_ROWS = 64
BATCH_CHARS = 1 << 20
#: A generation of a memo has about this many chunks, or twice as many words; two
#: are held, and what occurs again of the older one moves to the newer. Longer
#: chunks and words stay out.
MEMO_CHUNKS = 250_000
#: The same for jobs whose other stages need the memory.
SMALL_MEMO = 50_000
MEMO_CHARS = 48

_SPACE = r" \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_BORDER = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
_ODD = re.compile(r"[\x1c-\x1f]")
# ASCII and composed Latin letters: in lower case they stay in the range and the
# rules see the same classes as the pattern (a capital I with a dot becomes two characters)
_LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f"
# marks: neither letters nor digits nor white space to the rules, and never composed
_MARKS = r"!-/:-@\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7\u2010-\u2027\u2030-\u205e"
_SIMPLE = re.compile(f"[ \\t\\n\\r\\x0b\\x0c0-9{_LETTERS}{_MARKS}]+")
#: Rules of vocabularies whose words need no context beside a space, and the
#: words of a simple text under them. Byte-level, as GPT-2 has it:
SPACED_RULES = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
}
_SPACED = re.compile(
    f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+").findall
#: Composed characters, lower case, then contractions, letters, digits and marks:
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_LOWER = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s0-9{_LETTERS}]+").findall
WORDS: list[tuple[bool, dict, Callable[[str], list[str]]]] = [
    (False, SPACED_RULES, _SPACED), (True, WORD_RULES, lambda text: _LOWER(text.lower()))]
# how a byte-level vocabulary spells bytes: printable ones as themselves
_SPELLED_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_UNSPELLED_BYTES = sorted(set(range(256)).difference(_SPELLED_BYTES))
_BYTE_CHARS = "".join(chr(0x100 + _UNSPELLED_BYTES.index(b) if b in _UNSPELLED_BYTES else b) for b in range(256))
_WHITE = frozenset(" \t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
                   + "".join(map(chr, range(0x2000, 0x200B))))


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordMemo(dict):
    """Ids of words, as bytes, found at first use, in two generations."""

    def __init__(self, model, words: int):
        super().__init__()
        self.tokenize, self.words = model.tokenize, words
        self.older: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> bytes:
        if len(self) > self.words:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, words))

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            ids = [t.id for t in self.tokenize(charmap_decode(word.encode(), "strict", _BYTE_CHARS)[0])]
            found = array("I", ids).tobytes()
        if len(word) <= MEMO_CHARS:
            self[word] = found
        return found

    def forget(self) -> None:
        self.older = {}
        self.clear()


class ChunkEncoder:
    """``tokenizers`` with ``add_special_tokens=False``; ``drops_space`` says
    that the vocabulary ignores white space between words."""

    def __init__(self, path: str, drops_space: bool = False, memo_chunks: int = MEMO_CHUNKS):
        # a Spark task has one core; the library reads this at every call
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.memo_chunks = memo_chunks
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder()
        self.marker_id, self.marker = next(((i, t.content) for i, t in sorted(added.items())), (None, None))
        self.sizes = self.byte_sizes()
        rules = json.loads(self.tokenizer.to_str())
        self.words = WordMemo(self.tokenizer.model, 2 * memo_chunks)
        self.cut_words = next((cut for drops, known, cut in WORDS
                               if drops == drops_space and all(rules[k] == v for k, v in known.items())), None)
        self.spelled = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)")

    def forget(self) -> None:
        """Give the memo's memory back: the worker of this task serves others."""
        self.memo, self.older = {}, {}
        self.words.forget()
        pa.default_memory_pool().release_unused()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The library's own answer."""
        return [np.array(e.ids, dtype="<u4")
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks, none of which spells an added token."""
        out: dict[str, bytes] = {}
        if self.cut_words:
            out = {c: self.words.ids(self.cut_words(c)) for c in chunks if _SIMPLE.fullmatch(c)}
            chunks = [c for c in chunks if c not in out]
        if not self.drops_space:  # chunks that begin with white space make a text: cut its ids by byte length
            joined = [c for c in chunks if c[0] in _WHITE and c[-1] not in _WHITE]
            if len(joined) < len(chunks):
                chunks = list(set(chunks).difference(joined))
            else:
                chunks = []
            if joined:
                ids = self.whole(["".join(joined)])[0]
                bytes_before = np.cumsum(self.sizes[ids])
                ends = np.searchsorted(bytes_before, np.cumsum([len(c.encode()) for c in joined])) + 1
                self._cut(out, joined, ids, ends, 0)
        if chunks:
            ids = self.whole([self.marker.join(chunks)])[0]
            self._cut(out, chunks, ids, np.append(np.flatnonzero(ids == self.marker_id), len(ids)), 4)
        return out

    @staticmethod
    def _cut(out: dict[str, bytes], chunks: list[str], ids: np.ndarray, ends: np.ndarray, skip: int) -> None:
        raw, lo = ids.tobytes(), 0
        for chunk, hi in zip(chunks, (ends * 4).tolist()):
            out[chunk] = raw[lo:hi]
            lo = hi + skip

    def _segments(self, text: str) -> Iterator[str]:
        """Pieces of a long text, cut before a run of white space."""
        lo = 0
        while len(text) - lo > BATCH_CHARS:
            m = _BORDER.search(text, lo + BATCH_CHARS)
            if not m:
                break
            yield text[lo:m.start()]
            lo = m.start()
        yield text[lo:] if lo else text

    def _ids(self, pieces: list[list[str]]) -> list[bytes]:
        """Ids of every list of chunks; what the memo lacks is learned in one call."""
        if len(self.memo) > self.memo_chunks:
            self.older, self.memo = self.memo, {}
        known: dict[str, bytes] = self.memo
        seen: set[str] = set()
        for p in pieces:
            seen.update(p)
        lacking = seen.difference(known)
        again = self.older.keys() & lacking if self.older else ()
        if again:
            known.update((c, self.older[c]) for c in again)
            lacking.difference_update(again)
        lacking = list(lacking)
        if lacking:
            found = self._learn(lacking)
            long = [c for c in lacking if len(c) > MEMO_CHARS]
            if long:
                known = {c: found[c] if c in found else known[c] for c in seen}
                for c in long:
                    del found[c]
            self.memo.update(found)
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    def _by_words(self, text: str) -> np.ndarray | None:
        """Ids of a simple text."""
        if self.cut_words is None or not _SIMPLE.fullmatch(text) or self.spelled.search(text):
            return None
        return np.frombuffer(b"".join(self.words.ids(self.cut_words(s)) for s in self._segments(text)), dtype="<u4")

    def _batch(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        found = [self._by_words(t) for t in texts]
        others = [k for k, ids in enumerate(found) if ids is None]
        if len(texts) == 1 and others and len(texts[0]) > BATCH_CHARS and not self._whole_only(texts[0]):
            raw = [self._ids([self._split(s)])[0] for s in self._segments(texts[0])]
            yield texts[0], np.frombuffer(b"".join(raw), dtype="<u4")
            return
        split = {k: None if self._whole_only(texts[k]) else self._split(texts[k]) for k in others}
        ids = iter(self._ids([c for c in split.values() if c is not None]))
        for k, chunks in split.items():
            found[k] = self.whole([texts[k]])[0] if chunks is None else np.frombuffer(next(ids), dtype="<u4")
        yield from zip(texts, found)

    def _whole_only(self, text: str) -> bool:
        return self.marker is None or bool(_ODD.search(text) or self.spelled.search(text))

    def _split(self, text: str) -> list[str]:
        return text.split() if self.drops_space else _CHUNK.findall(text)

    def column(self, col: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
        """(text, ids) of every row; null is empty."""
        held: list[str] = []
        chars = 0
        for x in col:
            text = x.as_py() or ""
            if held and chars + len(text) > BATCH_CHARS or len(held) >= BATCH_ROWS:
                yield from self._batch(held)
                held, chars = [], 0
            held.append(text)
            chars += len(text)
        if held:
            yield from self._batch(held)

    def encode_ordinary(self, text: str) -> list[int]:
        return self.whole([text])[0].tolist()

    def byte_sizes(self) -> np.ndarray:
        """UTF-8 bytes of every id's token in a byte-level vocabulary: an entry
        spells each byte as one character, an added token its own spelling."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        sizes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            sizes[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            sizes[i] = len(token.content.encode())
        return sizes


@lru_cache(maxsize=2)
def chunk_encoder(path: str, drops_space: bool = False, memo_chunks: int = MEMO_CHUNKS) -> ChunkEncoder:
    return ChunkEncoder(path, drops_space, memo_chunks)
