"""Language mixtures against all subsets by plain EM; samples that keep every
language; URLs with very many labels; null ids."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import language_id as L
from ledgerline.llm import substring_dedup, url_filter

ALPHABETS = ("abcde", "fghij", "aklmn")


def text(r, lang, n):
    return " ".join("".join(r.choice(list(ALPHABETS[lang]), int(r.integers(2, 7)))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = np.random.default_rng(1)
    rows = [(text(r, k % 3, 60), f"l{k % 3}") for k in range(90)]
    return L.train(spark.createDataFrame(rows, "text string, lang string"))


def by_subsets(model, raw):
    """Penalised likelihood of every set of languages; EM word by word."""
    data = np.frombuffer(raw, np.uint8)
    bucket, first, _ = L.grams(data, np.array([0, len(data)]))
    ends = [*first[1:], len(bucket)]
    ll = [[float(sum(model.logp[b][k] for b in bucket[lo:hi])) for k in range(len(model.langs))] for lo, hi in zip(first, ends)]
    like = [[math.exp(x - max(w)) for x in w] for w in ll]
    fee = L.PENALTY * math.log(len(like) + 1)

    def em(langs):
        pi = {k: 1 / len(langs) for k in langs}
        for _ in range(L.EM_ROUNDS):
            new = dict.fromkeys(langs, 0.0)
            for w in like:
                total = sum(w[k] * pi[k] for k in langs)
                for k in langs:
                    new[k] += w[k] * pi[k] / max(total, 1e-300) / len(like)
            pi = new
        return pi, sum(math.log(max(sum(w[k] * pi[k] for k in langs), 1e-300)) for w in like)

    every = range(len(model.langs))
    best = max(((em(s)[1] - len(s) * fee, s) for n in (1, 2, 3) for s in itertools.combinations(every, n)), key=lambda x: x[0])[1]
    pi = em(best)[0]
    return best, (em(tuple(every))[0] if len(best) == 1 else pi)


def test_sets_equal_all_subsets(model):
    r = np.random.default_rng(2)
    for trial in range(40):
        parts = [text(r, int(k), int(r.integers(15, 60))) for k in r.choice(3, int(r.integers(1, 4)), replace=False)]
        raw = " ".join(parts).encode()
        best, score, share = L.infer(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        want, pi = by_subsets(model, raw)
        assert tuple(np.flatnonzero(share[0] > 0)) == want == tuple(sorted(want)), trial
        top = max(want, key=lambda k: pi[k])
        assert best[0] == top and abs(score[0] - min(1, pi[top])) < 1e-5
        assert len(want) == len(parts)


def test_sample_keeps_every_language(spark):
    r = np.random.default_rng(3)
    rows = [("one text, said again", "rare")] * 200 + [(text(r, 0, 30), "often") for _ in range(300)] + [("a single row", "once")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    got = L._sampled(df, df["text"], df["lang"], 20).groupBy("lang").agg(F.count("*").alias("n")).collect()
    n = {x.lang: x.n for x in got}
    assert n["rare"] == n["once"] == 1 and 5 <= n["often"] <= 45
    assert set(L.train(df, train_rows=20).langs) == {"rare", "often", "once"}
    assert set(L.train(df, train_rows=1).langs) == {"rare", "often", "once"}


def test_hosts_of_very_many_labels(spark):
    deep = "http://" + "a." * 16_000 + "example.org/es/x"
    df = spark.createDataFrame([(1, deep), (2, "http://x.com/fr/" + "p" * 200_000), (3, "http://org/"), (4, None)] + [(5, deep)] * 3,
                               "page_id long, url string")
    rules = url_filter.rule_table(spark)
    url_filter.filter_urls(df.limit(1), rules).collect()  # warm
    start = time.time()
    got = {r.id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert time.time() - start < 30
    assert got == {1: ("example.org/es/", "block"), 2: ("com/fr/", "allow"), 3: ("org/", "allow"), 4: (None, "allow"),
                   5: ("example.org/es/", "block")}


def test_null_ids_stand_behind_all_and_not_among_themselves(spark):
    r = np.random.default_rng(4)
    words = lambda n: " ".join("".join(r.choice(list("abcdefgh"), 6)) for _ in range(n))
    shared, only_null, plain = words(60), words(60), words(20)
    rows = [(1, shared + " " + plain), (None, plain + " " + shared), (None, only_null + " x"), (None, only_null + " y"),
            (None, only_null + " x"), (2, words(70))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by = sorted((g.id is None, g.id or 0, g.n_removed) for g in got)
    assert by == [(False, 1, 0), (False, 2, 0), (True, 0, 0), (True, 0, 0), (True, 0, 0), (True, 0, 60)]
