"""Training-data operators: edge cases on a small fixture and brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import curriculum, exact_dedup, html_text, language_id, order_minhash, packing
from ledgerline.llm import substring_dedup, token_counts, url_filter, vantage_tree

WORD = r"[^\x20\x09-\x0D]+"
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size long, key string"


def sentence(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(n))


BASE = sentence(1, 150)
NEAR = BASE.replace(BASE.split()[70], "other", 1)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace(" ", " \n\t"), "en", None), (4, NEAR, "en", "b"),
    (5, None, None, "b"), (6, "", "de", "b"), (7, " \n ", None, None), (8, "12 34 !!", "en", "c"),
    (9, "kurz", "de", "c"), (10, sentence(2, 60) + " " + " ".join(BASE.split()[20:90]), "en", "c"),
    (None, sentence(3, 40), "en", "a"), (None, BASE, "en", "a"), (11, sentence(4, 30000), "en", "a"),
    (12, "one two", "en", "a"), (12, "one two", "en", "a"), (13, "été Ünïcode ß", "fr", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, 7, "x", 1, "k") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(WORD, t or "")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_groups(docs, digest_all=True).collect()
    assert len(got) == len(ROWS)
    for g in got:
        same = [r for r in ROWS if hashlib.sha256(norm(r[1]).encode()).digest() == bytes(g.sha256)]
        ids = [r[0] for r in same if r[0] is not None]
        assert g.group_size == len(same) and g.keep_id == (min(ids) if ids else None)
    assert sum(g.kept for g in got) == len({norm(r[1]) for r in ROWS})
    # beyond the broadcast bound the groups are the same
    far = exact_dedup.exact_groups(docs, broadcast_rows=0).collect()
    assert sorted((str(r.id), str(r.keep_id), r.group_size) for r in far) == sorted(
        (str(r.id), str(r.keep_id), r.group_size) for r in got)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len({norm(r[1]) for r in ROWS})
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_near_dedup(docs, none):
    got = {(r.id, r.class_id, r.class_size) for r in order_minhash.near_classes(docs).collect() if r.id is not None}
    assert {(i, 1, 5) for i in (1, 2, 3, 4)} <= got
    assert all((i, i, 1) in got for i in (5, 6, 7, 8, 9, 10, 11, 13))
    left = order_minhash.drop_near(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 5, 6, 7, 8, 9, 10, 11, 12, 13, None]))
    assert order_minhash.near_classes(none).count() == 0


def test_near_dedup_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    got = order_minhash.near_classes(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.id: r.class_id for r in got} == {i: find(i) for i in ids}


def test_alignment():
    a = np.arange(100, dtype=np.uint32)
    assert order_minhash.aligned(a, a) == 1
    assert order_minhash.aligned(a, a[10:]) == 0.9
    assert order_minhash.aligned(a, a[::-1].copy()) < 0.1


def test_substring_dedup(docs, none):
    seen, want = {}, {}
    order = sorted((r[0] if r[0] is not None else 1 << 62, k) for k, r in enumerate(ROWS))
    for i, k in order:
        w = words(ROWS[k][1])
        for a in range(len(w) - 49):
            seen.setdefault(tuple(w[a:a + 50]), i)
    for i, k in order:
        w = words(ROWS[k][1])
        g = [False] * len(w)
        for a in range(len(w) - 49):
            if seen[tuple(w[a:a + 50])] < i:
                g[a:a + 50] = [True] * 50
        kept = " ".join(x for x, y in zip(w, g) if not y)
        want.setdefault(str(ROWS[k][0]), []).append((len(w), sum(g), hashlib.sha256(kept.encode()).hexdigest()))
    got = {}
    for r in substring_dedup.remove_repeats(docs).collect():
        got.setdefault(str(r.id), []).append((r.n_words, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert substring_dedup.remove_repeats(none).count() == 0


def test_language(docs, none, spark):
    model = language_id.train(docs)
    got = {str(r.doc_id): (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert got["5"] == got["6"] == got["7"] == got["8"] == ("und", 0.0)
    assert got["1"][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.keep_languages(docs).columns == docs.columns
    assert language_id.keep_languages(none).count() == 0
    real = spark.read.parquet(f"{SF}/documents.parquet")
    held = language_id.held_out(real.doc_id)
    out = language_id.predict(real.filter(held), language_id.train(real.filter(~held))).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) >= 0.95


def test_mixture_of_two_languages(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(real)
    text = {r.lang: r.text for r in real.filter(F.length("text") > 1500).collect()}
    both = (text["en"][:900] + " " + text["de"][:600]).encode()
    _, score, share = language_id.infer(model, np.frombuffer(both, np.uint8), np.array([0, len(both)]))
    assert set(np.flatnonzero(share[0] > 0.2)) == {model.langs.index("en"), model.langs.index("de")}
    assert 0.45 < score[0] < 0.75


def test_mix(docs, none):
    got = curriculum.mix(docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and len(r.takes) == len(r.positions)
        assert all(0 <= p <= 1 for p in r.positions)
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    for source, rows in by.items():
        taken, largest = sum(r.taken for r in rows), max(r.size for r in rows)
        assert abs(taken - rows[0].target) <= largest / 2 + 0.5 and taken <= 2 * rows[0].source_size
        assert all(x == r.size for r in rows for x in r.takes)  # whole documents only
    assert abs(sum(r.target for r in {r.source: r for r in got}.values()) - 1.5 * total) <= 1e-6 * total
    again = curriculum.mix(docs.repartition(5)).collect()
    key = lambda r: (str(r.id), r.key, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = curriculum.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in got)
    assert curriculum.mix(none).count() == 0 and curriculum.mixed_documents(none).count() == 0


def test_schedule_inverse(spark):
    f = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(x,) for x in f], "f double").select(
        "f", curriculum.invert_schedule(F.col("f"), F.array(F.lit(1.5), F.lit(1.0), F.lit(0.5))).alias("t"))
    for r in df.collect():  # demand of a straight line from 1.5 to 0.5
        assert abs(1.5 * r.t - 0.5 * r.t ** 2 - r.f) < 1e-9


def test_packing(docs, none):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.public_vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = packing.pack_documents(docs).collect()
    want = []
    for i, t, *_ in ROWS:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        lo = 0
        for p in range(-(-len(ids) // 2048)):
            hi = (len(ids) - 1) % 2048 + 1 + p * 2048
            want.append((str(i), p, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
            lo = hi
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 2048
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack_documents(none).count() == 0


def test_packing_plan():
    r = np.random.default_rng(5)
    counts = np.bincount(np.minimum(r.geometric(1 / 300, 20000), 2048), minlength=2049)
    counts[1500] += 7000
    plan = packing.plan(counts)
    used = np.zeros(2049, dtype=np.int64)
    for pattern, times in plan:
        assert sum(pattern) <= 2048 and times > 0
        for n in pattern:
            used[n] += times
    assert (used == counts).all()
    # pieces of 1500 share no sequence, and none with a piece over 548
    long = counts.copy()
    long[:549] = long[1500] = 0
    least = int(counts[1500]) - (-int((long * np.arange(2049)).sum()) // 2048)
    assert sum(t for _, t in plan) <= 1.02 * least


def test_url_filter(spark):
    urls = ["http://Example.ORG/es/x", "https://a.example.org/en/17?x", "https://b.org", "https://b.org/?q", "ftp://x.com/de/",
            "http://com/fr/1#a", None, "no scheme", "", "http://notexample.org/es/", "http://net/fr/"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] + [(None, urls[0], "x", "y")],
                                  "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect()
    by = {r.id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(urls) + 1 and by[None] == by[0] == ("example.org", "/es/x", "example.org/es/", "block")
    assert by[1] == ("a.example.org", "/en/17", "example.org/en/1", "block")
    assert by[2] == ("b.org", "", None, "allow") and by[3] == ("b.org", "/", "org/", "allow")
    assert by[4][2:] == ("com/de/", "block") and by[5][2:] == ("com/fr/", "allow")
    assert by[6] == by[7] == by[8] == ("", "", None, "allow")
    assert by[9][2] == "org/" and by[10][2] is None
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_html(spark):
    m = html_text.main_text
    assert m(None) == m("") == m("<script>x</script>") == ""
    page = ("<html><body><header><h1>Site</h1></header><nav><a>x</a></nav><div class='ad'>Buy, now.</div><main><h1>T &amp; x</h1>"
            "<p>One <a href=x>link</a> two.&nbsp;x<p>Three<b>fo</b>ur.<ul><li>item one<li>item two</ul></main>"
            "<div id=comments><p>Nice post, I liked it.</p></div><form>Mail</form><footer>c</footer>")
    assert m(page) == "T & x One link two. x Threefour. item one item two"
    df = spark.createDataFrame([(1, None, page, "a"), (None, "u", None, "b"), (2, "u", "", "c")],
                               "page_id long, url string, html string, text string")
    got = {r.id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got[1] == (m(page), len(m(page))) and got[None] == got[2] == ("", 0)
    assert html_text.extract(df.limit(0)).count() == 0


def test_token_counts(docs, none, spark):
    enc = packing.encoder(packing.public_vocabulary())
    got = {}
    for r in token_counts.section_tokens(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect():
        got.setdefault(r.id, []).append(r)
    for i, t, *_ in ROWS:
        if i is not None:
            assert sum(r.n_tokens for r in got[i]) == len(enc.encode_ordinary(t or ""))
            assert max(r.char_end for r in got[i]) == len(t or "")
    assert token_counts.section_tokens(none).count() == 0
    ends, lo, hi = np.array([2, 6, 8]), np.array([0, 3]), np.array([3, 8])  # the second token crosses at 3
    assert token_counts.allocate(ends, lo, hi, "first")[0].tolist() == [2, 1]
    assert token_counts.allocate(ends, lo, hi, "last")[0].tolist() == [1, 2]
    assert token_counts.allocate(ends, lo, hi, "most")[0].tolist() == [1, 2]
    assert token_counts.allocate(ends, lo, hi, "split")[0].tolist() == [1.25, 1.75]
    assert token_counts.allocate(ends, lo, hi, "first")[1].tolist() == [1, 0]
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs, rule="none")


def test_nearest(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(900, 8))
    v[100:400] = v[100]  # one vector in a third of the rows
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] + [1.0] * 7, 1), (None, v[0].tolist(), 1),
             (5, v[5].tolist(), 2), (1100, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for x in vantage_tree.nearest(df, df.filter("vec_id % 100 = 0"), factor=1.0, shard_rows=128).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert set(got) == set(range(0, 900, 100))  # 1000 takes no part, 1100 has no neighbour
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        found.sort()
        assert [f[1] for f in found] == best.tolist() and np.allclose([f[2] for f in found], d[best])
    assert vantage_tree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:3]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) and len(texts) > 0.8 * docs.count()
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
