"""Generator (S9) against a brute-force Python rendering, percentile (A10),
ledger fold (A9), first-wins (W3), streaming (R1–R5)."""

import hashlib
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from conftest import write
from ledgerline.operators.metrics import latency_summary
from ledgerline.operators.sink import first_wins
from ledgerline.sources.synth import CATEGORIES, generate_csv, synthetic_rows


def brute_row(i, seed):
    d = hashlib.blake2b(f"{seed}:{i}".encode("ascii"), digest_size=16).digest()
    off = int.from_bytes(d[0:8], "big") % (731 * 86400)
    cents = int.from_bytes(d[8:12], "big") % 2_000_001 - 1_000_000
    cents = 1 if cents == 0 else cents
    ts = (datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=off)).isoformat().replace("+00:00", "Z")
    a = abs(cents)
    return (f"txn-{i:012d}", ts, f"{'-' if cents < 0 else ''}{a // 100}.{a % 100:02d}",
            CATEGORIES[int.from_bytes(d[12:16], "big") % 8])


def test_generator_matches_brute_force(spark):
    rows = spark.range(1, 2001).withColumnRenamed("id", "row_number")
    got = [tuple(r)[1:] for r in synthetic_rows(rows, 42).orderBy("row_number").collect()]
    assert got == [brute_row(i, 42) for i in range(1, 2001)]


def test_generated_file_bytes(spark, tmp):
    import glob
    generate_csv(spark, f"{tmp}/gen", 10, seed=42, files=1)
    f = glob.glob(f"{tmp}/gen/**/*.csv", recursive=True)
    assert len(f) == 1
    text = open(f[0], encoding="utf-8").read()
    expect = "transaction_id,occurred_at,amount,category\n" + "".join(",".join(brute_row(i, 42)) + "\n" for i in range(1, 11))
    assert text == expect


def test_percentiles(spark):
    df = spark.createDataFrame([("q", float(v)) for v in [1, 2, 3, 4, 100]], "query string, ms double")
    r = latency_summary(df, ["query"], "ms").first()
    assert (r.samples, r.min_ms, r.p50_ms, r.p95_ms, r.max_ms) == (5, 1.0, 3.0, 100.0, 100.0)


def test_first_wins_is_deterministic(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "z"), (1, 1, "a"), (2, 5, "c")], "k int, o int, v string")
    out = sorted(tuple(r) for r in first_wins(df, ["k"], ["o"]).collect())
    assert out == [(1, 1, "a"), (2, 5, "c")]


def test_ledger_fold_terminal_sticky(spark):
    from ledgerline import contract as C
    from ledgerline.operators.ledger import current_jobs, ledger_audit
    t = datetime(2025, 1, 1)
    ev = [("j", 1, C.RECEIVED, 0, 0, t), ("j", 2, C.QUEUED, 0, 0, t + timedelta(1)),
          ("j", 3, C.PROCESSING, 0, 0, t + timedelta(2)), ("j", 4, "BATCH", 2, 1, t + timedelta(3)),
          ("j", 5, C.COMPLETED_WITH_ERRORS, 0, 0, t + timedelta(3)), ("j", 6, C.PROCESSING, 0, 0, t + timedelta(4))]
    df = spark.createDataFrame(ev, "import_id string, seq long, status string, accepted_rows long, "
                                   "rejected_rows long, event_at timestamp")
    for c in ("original_filename", "failure_reason"):
        df = df.withColumn(c, F.lit("f.csv" if c == "original_filename" else None).cast("string"))
    df = df.withColumn("import_no", F.lit(1).cast("long"))
    job = current_jobs(df).first()
    assert (job.status, job.accepted_rows, job.rejected_rows) == (C.COMPLETED_WITH_ERRORS, 2, 1)


def test_stream_ingest_idempotent(spark, tmp):
    from ledgerline.plans.ingest import read_jobs
    from ledgerline.streaming.file_stream import start_ingest_stream
    hdr = "transaction_id,occurred_at,amount,category\n"
    write(f"{tmp}/watch/a.csv", hdr + "a,2025-01-02T03:04:05Z,1.00,x\n")
    write(f"{tmp}/watch/b.csv", hdr + "b,2025-01-02T03:04:05Z,0.00,x\n")
    write(f"{tmp}/watch/poison.csv", "nope\n")
    q = start_ingest_stream(spark, f"{tmp}/watch", f"{tmp}/store", f"{tmp}/ckpt", max_files_per_trigger=1,
                            available_now=True)
    q.awaitTermination()
    st = sorted((r.original_filename, r.status) for r in read_jobs(spark, f"{tmp}/store").collect())
    assert st == [("a.csv", "COMPLETED"), ("b.csv", "COMPLETED_WITH_ERRORS"), ("poison.csv", "FAILED")]
    # restart from the same checkpoint: nothing new, nothing duplicated
    q = start_ingest_stream(spark, f"{tmp}/watch", f"{tmp}/store", f"{tmp}/ckpt", available_now=True)
    q.awaitTermination()
    assert read_jobs(spark, f"{tmp}/store").count() == 3
