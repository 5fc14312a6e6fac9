"""Consuming batch runs, text report, pattern characters in a stream, lazy ladder."""

import os

from pyspark.sql import functions as F

from conftest import write
from ledgerline.functions.csvfields import raw_fields
from ledgerline.operators import ladder
from ledgerline.plans.ingest import ingest, read_jobs, read_transactions, report_text
from ledgerline.streaming.file_stream import start_ingest_stream

HEAD = "transaction_id,occurred_at,amount,category\n"
ROW = "t,2025-01-01T00:00:00Z,1.00,c\n"


def test_consume_deletes_terminal_files_only(spark, tmp):
    write(f"{tmp}/in/good one.csv", HEAD + ROW)
    write(f"{tmp}/in/bad[1].csv", "a,b\n")
    write(f"{tmp}/in/other.txt", "x")
    report = ingest(spark, f"{tmp}/in", f"{tmp}/store", consume=True)
    assert sorted(i["status"] for i in report["imports"]) == ["COMPLETED", "FAILED"]
    assert [n for n in os.listdir(f"{tmp}/in") if not n.startswith(".")] == ["other.txt"]  # a refused file is not ours
    assert read_transactions(spark, f"{tmp}/store").count() == 1
    text = report_text(report).split("\n")
    assert "COMPLETED 1" in text[0] and "FAILED 1" in text[0] and "refused 1" in text[0]
    assert len(text) == 4 and any("1 accepted, 0 rejected" in x for x in text)


def test_consume_after_a_run_that_kept_its_file(spark, tmp):
    write(f"{tmp}/in/a.csv", HEAD + ROW)
    ingest(spark, f"{tmp}/in", f"{tmp}/store")
    report = ingest(spark, f"{tmp}/in", f"{tmp}/store", consume=True)
    assert len(report["skipped_terminal"]) == 1 and not os.path.exists(f"{tmp}/in/a.csv")
    assert read_transactions(spark, f"{tmp}/store").count() == 1


def test_stream_takes_names_with_pattern_characters(spark, tmp):
    write(f"{tmp}/in/data[1].csv", HEAD + ROW)
    write(f"{tmp}/in/a {{b}}.csv", HEAD + ROW)
    q = start_ingest_stream(spark, f"{tmp}/in", f"{tmp}/store", f"{tmp}/ckpt", available_now=True)
    q.awaitTermination()
    assert [r.status for r in read_jobs(spark, f"{tmp}/store").collect()] == ["COMPLETED"] * 2


def test_ladder_is_lazy_and_filters_stay_above_it(spark):
    rec = spark.createDataFrame([(2, ROW.strip()), (3, "t,x,1.00,c"), (4, "t")], "source_row long, record string")
    c = ladder.classify(rec.select("source_row", raw_fields(F.col("record")).alias("fields")), "fields", quoted=True)
    bad = ladder.rejected(c, ["source_row"])
    assert [(r.source_row, r.error_code) for r in bad.orderBy("source_row").collect()] == [
        (3, "OCCURRED_AT_INVALID"), (4, "COLUMN_COUNT")]
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    condition = [line for line in plan.split("\n") if "Filter" in line]
    assert condition and all(len(line) < 200 for line in condition)
