"""Percentiles by narrowing (A10, A11), streamed digest (A15), the published
generator digest (S9), canonical order (L5), job events from one pass."""

import hashlib
import random
import resource
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import metrics
from ledgerline.operators.analytics import canonical_order
from ledgerline.plans import derived
from ledgerline.sources import synth


def nearest(values, q):
    s = sorted(values)
    return s[max(1, -(-len(s) * q // 1)).__int__() - 1]


def between(values, q):
    s = sorted(values)
    at = (len(s) - 1) * q
    k = int(at)
    return s[k] if at == k else s[k] + (s[k + 1] - s[k]) * (at - k)


@pytest.mark.parametrize("kind", ["double", "long", "decimal(12,2)"])
def test_narrowing_is_exact(spark, monkeypatch, kind):
    rng = random.Random(5)
    rows = [(g, round(rng.choice([rng.random(), rng.random() * 1e6, 7.0]) * 100) / 100 if kind != "long" else rng.randrange(3000))
            for g in "abc" for _ in range(700)]
    rows += [("d", 3.0 if kind != "long" else 3)] * 50 + [("e", None), ("f", 1.0 if kind != "long" else 1)]
    df = spark.createDataFrame(rows, "g string, v " + ("long" if kind == "long" else "double")).withColumn("v", F.col("v").cast(kind))
    monkeypatch.setattr(metrics, "SKETCH", 20)  # a wide bracket
    monkeypatch.setattr(metrics, "FINAL_VALUES", 3)
    monkeypatch.setattr(metrics, "BUCKETS", 4)
    got = {r.g: r for r in metrics._values_at(df, ["g"], "v", [("a", 0.5, kind == "double"), ("b", 0.95, False), ("c", 0.0, False),
                                                                ("d", 1.0, False)]).collect()}
    for g in "abcdf":
        v = [x for k, x in rows if k == g]
        r = got[g]
        middle = between(v, 0.5) if kind == "double" else nearest(v, 0.5)
        assert abs(float(r.a) - middle) < 1e-9 and (r._n, float(r._least), float(r._most)) == (len(v), min(v), max(v))
        assert [float(x) for x in (r.b, r.c, r.d)] == pytest.approx([nearest(v, 0.95), min(v), max(v)], abs=1e-9)
    assert (got["e"]._n, got["e"].a, got["e"].b) == (0, None, None)


def test_timestamps_and_no_group(spark, monkeypatch):
    monkeypatch.setattr(metrics, "FINAL_VALUES", 2)
    df = spark.range(500).select(F.timestamp_seconds(F.col("id") * 60).alias("t"))
    assert metrics.percentile_disc(df, [], "t", 0.5, "p").first().p == datetime(1970, 1, 1, 4, 9)
    assert metrics.percentile_disc(df.limit(0), [], "t", 0.5, "p").first().p is None


def test_two_ranks_share_their_scans(spark, tmp):
    spark.range(20_000).select((F.col("id") % 5).alias("g"), F.col("id").cast("double").alias("v")).write.parquet(f"{tmp}/t")
    out = metrics.latency_summary(spark.read.parquet(f"{tmp}/t"), ["g"], "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp}/t" not in plan  # both ranks come from two stored passes
    r = out.filter("g = 0").first()
    assert (r.samples, r.min_ms, r.max_ms, r.p50_ms, r.p95_ms) == (4000, 0.0, 19995.0, 9997.5, 18995.0)


def test_digest_of_a_file_over_two_gigabytes(spark, tmp):
    size = (2 << 30) + 12_345
    with open(f"{tmp}/big.csv", "wb") as f:  # a sparse file
        f.truncate(size)
    want, left, zero = hashlib.sha256(), size, bytes(1 << 24)
    while left:
        n = min(left, len(zero))
        want.update(zero[:n])
        left -= n
    chunks = list(synth._digests(iter([__import__("pandas").DataFrame({"path": [f"{tmp}/big.csv"]})])))
    assert chunks[0].values.tolist() == [[f"{tmp}/big.csv", size, want.hexdigest()]]
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    got = synth.digests(spark.createDataFrame([(f"file:{tmp}/big.csv",)], "path string")).first()
    assert (got.bytes, got.sha256) == (size, want.hexdigest())
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss - before < 1 << 20


def test_generator_gives_the_published_file(spark, tmp):
    """One million rows with seed 42: bytes and SHA-256 as published."""
    synth.generate_csv(spark, f"{tmp}/gen", 1_000_000, seed=42, files=1)
    r = synth.fingerprint(spark, f"{tmp}/gen").first()
    assert (r.bytes, r.rows) == (55_640_069, 1_000_000)
    assert r.sha256 == "65e6aa1e5ceb2b977ac316808b0cbc2d6fe90e1bdd9e73a7b58cb9e48fdfa012"


def test_canonical_order(spark):
    rows = [("i", "MONTH", None, "2025-02"), ("i", "CATEGORY", "b", None), ("i", "TOTAL", None, None), ("h", "TOTAL", None, None),
            ("i", "CATEGORY", "a", None), ("i", "MONTH", None, "2024-12"), ("i", "CATEGORY", "é", None)]
    df = spark.createDataFrame(rows, "import_id string, aggregation_type string, category string, month string")
    got = [(r.import_id, r.position, r.category or r.month) for r in canonical_order(df).collect()]
    assert got == [("h", 1, None), ("i", 1, None), ("i", 2, "a"), ("i", 3, "b"), ("i", 4, "é"), ("i", 5, "2024-12"), ("i", 6, "2025-02")]


def test_job_events_read_each_table_once(spark):
    plan = derived.job_events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
