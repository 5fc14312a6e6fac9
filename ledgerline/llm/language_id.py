"""Language identification as multilingual mixture inference.

Training: byte trigrams (lower case, centred on every letter byte, so word
edges count) of labelled documents are counted per language into ``DIM`` hash
buckets, on the executors, and summed by one aggregation. The labelled sample
is bounded: about ``TRAIN_ROWS`` distinct texts a language, chosen by a hash of
the text (all of them if there are fewer, one at least). The model is languages
x DIM floats.

Prediction, on whole texts: a word's likelihood under a language is the
product of its trigram probabilities. A document is a mixture: expectation
maximisation over its words estimates each language's proportion. The set of
languages is selected by penalised likelihood (log likelihood minus ``PENALTY``
times the number of languages times log of the number of words), dropping the
language of the smallest proportion in turn. The prediction is the language of
the largest proportion in the selected set, the score that proportion; for a set
of one language, where it would always be 1, the score is the language's
proportion in the mixture of all languages.

Defined results: `und` with score 0 if the text is null, has no letter or no
language was learned; ties go to the language first by code point. Null ids
are allowed (their text form counts as empty). Repeated rows are predicted
each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ledgerline.llm import common as K
from ledgerline.llm.common import cut, fresh, staged, table

DIM = 1 << 16
#: Bound of the labelled sample: documents a language, on average.
TRAIN_ROWS = 4000
SMOOTHING = 0.05
PENALTY = 1.5
EM_ROUNDS = 8
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, dtype=np.uint8)  # other bytes than letters separate
for _b in range(ord("a"), ord("z") + 1):
    _FOLD[_b] = _FOLD[_b - 32] = _b
_FOLD[0x80:] = np.arange(0x80, 0x100)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray  # DIM x languages, float32


def grams(data: np.ndarray, offs: np.ndarray):
    """(bucket of the trigram at each letter byte, first letter of each word
    among them, row of each word)."""
    x = _FOLD[data]
    # Latin-1 capitals in UTF-8 (C3 80..9E) to small letters
    upper = np.flatnonzero((x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[:-1] == 0xC3)) + 1
    x[upper] += 0x20
    pad = np.empty(len(x) + 2, dtype=np.uint32)
    pad[0] = pad[-1] = 0x20
    pad[1:-1] = x
    left, right = pad[:-2].copy(), pad[2:].copy()
    edges = offs[1:-1]
    left[edges[edges < len(x)]] = 0x20
    right[edges[edges > 0] - 1] = 0x20
    at = np.flatnonzero(x != 0x20)
    v = (left[at] << np.uint32(16)) | (pad[1:-1][at] << np.uint32(8)) | right[at]
    bucket = ((v * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    first = np.flatnonzero(left[at] == 0x20)
    row = np.searchsorted(offs, at[first], "right") - 1
    return bucket, first, row


def _sampled(docs: DataFrame, text: Column, lang: Column, train_rows: int) -> DataFrame:
    """About ``train_rows`` distinct labelled texts a language, one at least.
    Which ones is decided on hashes; only their texts are brought together."""
    rows = docs.select(text.alias("text"), lang.alias("lang")).filter("lang is not null and text is not null").withColumn(
        "h", F.xxhash64("text"))
    texts = staged(rows.select("lang", "h").distinct(), "lang-texts")
    unit = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = texts.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct(unit.alias("u"), "h"))["h"].alias("first")).select(
        F.col("lang").alias("s_lang"), (F.lit(float(train_rows)) / F.col("n")).alias("share"), "first")
    picked = cut(texts.join(K.sized(cut(share)), F.col("lang") == F.col("s_lang")).filter(
        (unit < F.col("share")) | (F.col("h") == F.col("first"))).select(F.col("lang").alias("p_lang"), F.col("h").alias("p_h")))
    found = rows.join(K.sized(picked), (F.col("lang") == F.col("p_lang")) & (F.col("h") == F.col("p_h")))
    return found.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          train_rows: int = TRAIN_ROWS) -> Model:
    """The model of ``docs``'s labelled rows. Counts are summed in Spark; the
    driver receives languages x DIM counts at most, whatever the data's size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), dtype=object)
            for lo, hi, data, offs in K.text_slices(b.column(1), K.STAGE_SLICE_BYTES):
                bucket, first, row = grams(data, offs)
                of = np.repeat(row, np.diff(np.append(first, len(bucket))))
                names = lang[lo:hi]
                for name in set(names):
                    here = bucket[(names == name)[of]] if len(of) else bucket
                    sums[name] = sums.get(name, 0) + np.bincount(here, minlength=DIM)
        for name, c in sums.items():
            hit = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(c[hit].astype(np.int64))],
                names=["lang", "bucket", "n"])
    counted = _sampled(docs, docs[text_col], docs[lang_col], train_rows).mapInArrow(
        count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    names = got.column("lang").to_pylist()
    langs = tuple(sorted(set(names)))
    of = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((DIM, max(1, len(langs))))
    if len(langs):
        counts[got.column("bucket").to_numpy(), [of[x] for x in names]] = got.column("n").to_numpy()
    total = counts.sum(axis=0, keepdims=True)
    logp = np.log((counts + SMOOTHING) / (total + SMOOTHING * DIM))
    return Model(langs, logp.astype(np.float32))


def _em(like: np.ndarray, row: np.ndarray, first: np.ndarray, words: np.ndarray, allowed: np.ndarray,
        rounds: int) -> np.ndarray:
    """Proportions (rows x languages) of mixtures restricted to ``allowed``."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = like * pi[row]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        pi = np.add.reduceat(r, first, axis=0) / words[:, None]
    return pi


def infer(model: Model, data: np.ndarray, offs: np.ndarray):
    """(language index or -1, score, proportions) of each row."""
    n_rows, n_lang = len(offs) - 1, len(model.langs)
    best, score, share = np.full(n_rows, -1), np.zeros(n_rows), np.zeros((n_rows, max(1, n_lang)))
    bucket, first, row = grams(data, offs)
    if not n_lang or not len(first):
        return best, score, share
    ll = np.add.reduceat(model.logp[bucket], first, axis=0).astype(np.float64)
    peak = ll.max(axis=1)
    like = np.exp(ll - peak[:, None])
    live, doc_first, doc = np.unique(row, return_index=True, return_inverse=True)
    words = np.diff(np.append(doc_first, len(row))).astype(np.float64)
    fee = PENALTY * np.log(words + 1)

    def fit(rows: np.ndarray, allowed: np.ndarray):
        """EM and log likelihood for some of the documents."""
        at = np.zeros(len(live), dtype=bool)
        at[rows] = True
        unit = at[doc]
        lk = like if unit.all() else like[unit]
        sub_first = np.concatenate(([0], np.cumsum(words[rows][:-1]))).astype(np.int64)
        sub_row = np.repeat(np.arange(len(rows)), words[rows].astype(np.int64))
        pi = _em(lk, sub_row, sub_first, words[rows], allowed, EM_ROUNDS)
        mixed = np.log(np.maximum((lk * pi[sub_row]).sum(axis=1), 1e-300))
        return pi, np.add.reduceat(mixed, sub_first)

    every = np.arange(len(live))
    pi, gain = fit(every, np.ones((len(live), n_lang)))
    alone = np.add.reduceat(np.log(np.maximum(like, 1e-300)), doc_first, axis=0)
    single = alone.argmax(axis=1)
    chosen = np.zeros((len(live), n_lang))
    chosen[every, single] = 1
    value = alone.max(axis=1) - fee
    # the whole mixture bounds every smaller one: most documents are settled by one comparison
    todo = np.flatnonzero(gain - 2 * fee > value)
    allowed, cur_pi, cur_ll = np.ones((len(todo), n_lang)), pi[todo], gain[todo]
    pick = pi.copy()
    for k in range(n_lang, 1, -1):
        better = cur_ll - k * fee[todo] > value[todo]
        chosen[todo[better]] = allowed[better]
        pick[todo[better]] = cur_pi[better]
        value[todo[better]] = (cur_ll - k * fee[todo])[better]
        if k == 2 or not len(todo):
            break
        least = np.where(allowed > 0, cur_pi, np.inf).argmin(axis=1)
        allowed = allowed.copy()
        allowed[np.arange(len(todo)), least] = 0
        cur_pi, cur_ll = fit(todo, allowed)
    shown = np.where(chosen > 0, pick, 0)
    best[live] = shown.argmax(axis=1)
    share[live] = shown
    score[live] = np.clip(shown.max(axis=1), 0, 1)
    return best, score, share


def _lettered(col: pa.Array, data: np.ndarray, offs: np.ndarray, lo: int) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are looked at one by one."""
    ascii_letter = np.concatenate(([0], np.cumsum((_FOLD[data] != 0x20) & (data < 0x80))))
    out = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in (col[lo + int(i)].as_py() or ""))
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score. Map only."""
    names = np.array([*model.langs, UNKNOWN], dtype=object)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = [], []
            for lo, _, data, offs in K.text_slices(b.column(where), K.STAGE_SLICE_BYTES):
                best, s, _ = infer(model, data, offs)
                known = _lettered(b.column(where), data, offs, lo) & bool(model.langs)
                # letters, but no word that the model can read: the first language, score 0
                best = np.where(known, np.maximum(best, 0), -1)
                lang.extend(names[best])
                score.append(np.where(known, s, 0.0))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())],
                names=[*b.schema.names, lang_out, score_out])
    schema = StructType([*docs.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def keep_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that have no language (`und`)."""
    model = train(docs.filter(~held_out(docs[id_col])), text_col, lang_col)
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    return predict(docs, model, text_col, lang, score).filter(F.col(lang) != UNKNOWN).select(*docs.columns)


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(docs["doc_id"])))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
