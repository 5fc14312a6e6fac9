"""Token counts by offset-mapped attribution.

Each whole document is encoded once. Byte-level tokens, and the marker, are exact
pieces of the text's UTF-8 bytes, so the running sum of token byte lengths gives
every token's span. Token spans meet section spans in an interval join (binary
search of sorted borders inside the task). A token that crosses a border goes
by an explicit rule:

- ``first``: to the section that holds its first byte (the default)
- ``last``: to the section that holds its last byte
- ``most``: to the section with the larger share, ties to the earlier one
- ``split``: to each section by its share of the token's bytes

Sections: the lines of a text, each with its line end, so that sections cover
the text and their counts add up to the document's count under every rule; or
spans in characters from a column (array of start, end; sorted, disjoint), in
which case tokens outside all spans are counted as section -1.

Defined results: a null or empty text is one empty section without tokens;
null ids and repeated rows are kept; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table
from ledgerline.llm.packing import encoder, public_vocabulary

RULES = ("first", "last", "most", "split")


def allocate(ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section [lo, hi), how many of its tokens cross its end,
    and tokens outside all sections. Sections are sorted and disjoint."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    a = np.searchsorted(hi, starts, "right")  # first section that ends after the token's start
    b = np.searchsorted(lo, ends, "left") - 1  # last section that starts before the token's end
    live = a <= b
    count = np.zeros(len(lo))
    crossing = np.zeros(len(lo), dtype=np.int64)
    over = live & (ends > hi[np.minimum(a, max(len(hi) - 1, 0))]) if len(hi) else np.zeros(len(ends), dtype=bool)
    np.add.at(crossing, a[over], 1)
    simple = live & (a == b)
    count += np.bincount(a[simple], minlength=len(lo))[:len(lo)]
    for t in np.flatnonzero(live & (a < b)):
        s = np.arange(a[t], b[t] + 1)
        share = np.minimum(hi[s], ends[t]) - np.maximum(lo[s], starts[t])
        if rule == "first":
            count[s[0]] += 1
        elif rule == "last":
            count[s[-1]] += 1
        elif rule == "most":
            count[s[int(share.argmax())]] += 1
        else:
            count[s] += share / (ends[t] - starts[t])
    if rule == "split":  # a token that only partly lies in its one section
        for t in np.flatnonzero(simple):
            part = min(hi[a[t]], ends[t]) - max(lo[a[t]], starts[t])
            count[a[t]] -= 1 - part / (ends[t] - starts[t])
    return count, crossing, float(len(ends) - count.sum())


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None,
                   rule: str = "first", vocabulary: str | None = None) -> DataFrame:
    """id, section, char_start, char_end, n_tokens, n_crossing: a row for
    every section of every row of ``docs``. Map only."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary or public_vocabulary())
        sizes = encoding.sizes
        for b in batches:
            rows, parts = [], []
            for r, (text, ids) in enumerate(encoding.column(b.column(1))):
                ends = np.cumsum(sizes[ids])
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                if len(raw) != (ends[-1] if len(ends) else 0):
                    raise ValueError("tokens do not cover the text: not a byte-level vocabulary")
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters before each byte
                if spans_col is None:
                    cuts = np.flatnonzero(raw == 10) + 1
                    lo = np.concatenate(([0], cuts[cuts < len(raw)])).astype(np.int64)
                    hi = np.append(lo[1:], len(raw))
                else:
                    spans = b.column(2)[r].as_py() or []
                    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each character
                    lo = at[np.array([s["start"] for s in spans], dtype=np.int64)]
                    hi = at[np.array([s["end"] for s in spans], dtype=np.int64)]
                count, crossing, outside = allocate(ends, lo, hi, rule)
                section = np.arange(len(lo))
                if spans_col is not None and outside > 1e-9:
                    section, lo, hi = np.append(section, -1), np.append(lo, 0), np.append(hi, 0)
                    count, crossing = np.append(count, outside), np.append(crossing, 0)
                rows.append(np.full(len(section), r))
                parts.append((section, chars[lo], chars[hi], count, crossing))
            cols = [np.concatenate(x) if x else np.zeros(0) for x in zip(*parts)] if parts else [np.zeros(0)] * 5
            at = np.concatenate(rows) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at.astype(np.int64))), pa.array(cols[0].astype(np.int32)),
                 pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.int64)),
                 pa.array(cols[3].astype(np.float64)), pa.array(cols[4].astype(np.int64))],
                names=["id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])
    cols = [docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")]
    if spans_col is not None:
        cols.append(docs[spans_col].alias("spans"))
    return docs.select(*cols).mapInArrow(
        run, "id long, section int, char_start long, char_end long, n_tokens double, n_crossing long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = section_tokens(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "section", "char_start", "char_end",
                        F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")
