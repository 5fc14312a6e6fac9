"""The slow path in chunks of lines: no window holds a split, no aggregate sorts the records."""

import csv
import glob
import io
import random

import pytest
from pyspark.sql import functions as F

from conftest import write
from ledgerline.plans import files as FI
from ledgerline.plans.ingest import ingest, read_errors, read_transactions
from ledgerline.sources import csvscan

HDR = "transaction_id,occurred_at,amount,category\n"


def _file(path, n):
    cat = lambda i: f'"two\nlines of {i}"' if i % 9 == 0 else f"c{i}"
    write(path, HDR + "".join(f"t{i},2025-01-02T03:04:05Z,1.00,{cat(i)}\n" for i in range(n)))


def test_lines_of_a_split_go_to_many_tasks(spark, tmp):
    _file(f"{tmp}/in/a.csv", 60_000)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")  # one split
    try:
        staged = csvscan.stage_records(spark, csvscan.manifest(spark, f"{tmp}/in"), f"{tmp}/staged")
        assert staged.summary.count() == 1
        got = staged.records().agg(F.count("*"), F.countDistinct("record_no"), F.max("record_no"), F.count("fault")).first()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert tuple(got) == (60_001, 60_001, 60_001, 0)
    held = [spark.read.parquet(p).count() for p in glob.glob(f"{tmp}/staged/slowlines/*.parquet")]
    # before, the one split was sorted and held by one task
    assert sum(held) == 60_001 + 6_667 and max(held) < sum(held)


@pytest.mark.parametrize("bound", ["10m", "-1"])
def test_records_across_chunks(spark, tmp, monkeypatch, bound):
    """Chunks of four lines, records of up to nine, summaries broadcast or joined."""
    monkeypatch.setattr(csvscan, "CHUNK_BITS", 2)
    if bound == "-1":
        monkeypatch.setattr(csvscan, "BROADCAST_SUMMARY_BYTES", 0)
    rng = random.Random(5)
    want = {}
    for k in range(2):
        body = "".join(f't{i},2025-01-02T03:04:05Z,1.00,"' + "".join(rng.choice(['x', '\n', '""', ',', '\n']) for _ in range(rng.randint(1, 9)))
                       + '"\n' if rng.random() < 0.5 else rng.choice(["\n", f"t{i},2025-01-02T03:04:05Z,1.00,c\n"]) for i in range(300))
        write(f"{tmp}/in/f{k}.csv", HDR + body)
        want[f"f{k}.csv"] = list(csv.reader(io.StringIO(HDR + body, newline="")))[1:]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    try:
        rep = ingest(spark, f"{tmp}/in", f"{tmp}/store")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rep["imports"]) == 2
    for imp in rep["imports"]:
        recs = want[imp["path"].rsplit("/", 1)[-1]]
        assert imp["fault"] is None and imp["accepted"] + imp["rejected"] == len(recs)
        tx = {r.source_row: r.category for r in read_transactions(spark, f"{tmp}/store", imp["import_id"]).collect()}
        bad = {r.source_row for r in read_errors(spark, f"{tmp}/store", imp["import_id"]).collect()}
        assert set(tx) | bad == set(range(2, len(recs) + 2)) and not set(tx) & bad
        assert all(recs[n - 2][3] == c for n, c in tx.items())


def test_verdicts_sort_no_records(spark, tmp):
    _file(f"{tmp}/in/a.csv", 20)
    _file(f"{tmp}/in/b.csv", 4)
    write(f"{tmp}/in/c.csv", "id,b\n" + 'x,"open\n')  # header and record 2 at fault: the first one counts
    write(f"{tmp}/in/d.csv", HDR + "a,2025-01-02T03:04:05Z,1.00,x\n" + 'b,"y"z\n' + "x" * 5000 + "\n")
    files = csvscan.manifest(spark, f"{tmp}/in").withColumn("max_chars", F.lit(4096))
    staged = csvscan.stage_records(spark, files, f"{tmp}/staged")
    v = csvscan.file_verdicts(spark, files, staged.records(), staged.read_bytes(), 2)
    got = {r.original_filename: (r.fault, r.bad_record, r.cut_row) for r in v.collect()}
    assert got == {"a.csv": (None, None, 22), "b.csv": (None, None, 6), "c.csv": ("HEADER_MISMATCH", 1, 2),
                   "d.csv": ("CSV_SYNTAX", 3, 2)}
    assert "received [id, b]" in v.filter("fault = 'HEADER_MISMATCH'").first()["failure_reason"]
    assert "SortAggregate" not in v._jdf.queryExecution().executedPlan().toString()


def test_fault_rows_broadcast_no_orders(spark, tmp):
    spark.range(20).select(
        F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"),
        F.lit("2025-01-02 03:04:05").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit("5-LOW").alias("o_orderpriority")).write.parquet(f"{tmp}/orders.parquet")
    assert FI._priority_records(spark, tmp).count() == 20
    plan = FI._priority_records(spark, tmp).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
