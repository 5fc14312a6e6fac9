"""Sinks and reports (K6–K8), trim on read (P6), failure reason (P9),
transition audit (A9) and the physical plans the design relies on."""

import glob
import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import write
from ledgerline import contract as C
from ledgerline.operators.ledger import bounded_failure_reason, transition_audit
from ledgerline.operators.pages import keyset_page, trimmed
from ledgerline.plans.ingest import (ingest, purge_import, read_errors, read_events, read_jobs, read_transactions,
                                     write_run_report)

HDR = "transaction_id,occurred_at,amount,category\n"


def _plan(df) -> str:
    """The formatted physical plan (what ``df.explain("formatted")`` prints)."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_purge_and_report(spark, tmp):
    write(f"{tmp}/in/a.csv", HDR + "a,2025-01-02T03:04:05Z,1.00,x\nb,2025-01-02T03:04:05Z,abc,x\n")
    write(f"{tmp}/in/b.csv", HDR + "c,2025-01-02T03:04:05Z,2.00,y\n")
    write(f"{tmp}/in/n.txt", "x")
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store")
    df = write_run_report(spark, rep, f"{tmp}/report")
    lines = [json.loads(x) for f in glob.glob(f"{tmp}/report/*.json") for x in open(f)]
    assert sorted(r["kind"] for r in lines) == ["import", "import", "refused"] and df.count() == 3
    a = next(i for i in rep["imports"] if i["path"].endswith("a.csv"))["import_id"]
    purge_import(spark, f"{tmp}/store", a)  # K8: cascade of a deleted job
    assert read_transactions(spark, f"{tmp}/store").filter(F.col("import_id") == a).count() == 0
    assert read_errors(spark, f"{tmp}/store").filter(F.col("import_id") == a).count() == 0
    assert read_transactions(spark, f"{tmp}/store").count() == 1
    # the job is gone from the ledger, the other one is untouched
    assert [r["import_id"] for r in read_jobs(spark, f"{tmp}/store").collect()] == [
        i["import_id"] for i in rep["imports"] if i["import_id"] != a]
    purge_import(spark, f"{tmp}/store", "unknown")
    # the file is let in again, under a new number
    again = ingest(spark, f"{tmp}/in", f"{tmp}/store")
    assert [(i["import_id"], i["accepted"], i["rejected"]) for i in again["imports"]] == [(a, 1, 1)]
    assert len(again["skipped_terminal"]) == 1
    jobs = {r["import_id"]: r for r in read_jobs(spark, f"{tmp}/store").collect()}
    assert jobs[a]["import_no"] == 3 and jobs[a]["accepted_rows"] == 1 and jobs[a]["status"] == C.COMPLETED_WITH_ERRORS
    assert read_transactions(spark, f"{tmp}/store").count() == 2 and read_errors(spark, f"{tmp}/store").count() == 1
    audit = transition_audit(read_events(spark, f"{tmp}/store")).collect()
    assert [r["illegal_steps"] for r in audit] == [0, 0]


def test_stream_archives_consumed_files(spark, tmp):
    """K6: with an archive folder the source moves processed inputs away."""
    from ledgerline.streaming.file_stream import start_ingest_stream
    write(f"{tmp}/watch/a.csv", HDR + "a,2025-01-02T03:04:05Z,1.00,x\n")
    q = start_ingest_stream(spark, f"{tmp}/watch", f"{tmp}/store", f"{tmp}/ckpt", available_now=True,
                            archive_dir=f"{tmp}/archive")
    q.awaitTermination()
    write(f"{tmp}/watch/b.csv", HDR + "b,2025-01-02T03:04:05Z,1.00,x\n")  # a later batch triggers the clean-up
    q = start_ingest_stream(spark, f"{tmp}/watch", f"{tmp}/store", f"{tmp}/ckpt", available_now=True,
                            archive_dir=f"{tmp}/archive")
    q.awaitTermination()
    archived = glob.glob(f"{tmp}/archive/**/*.csv", recursive=True)
    assert any(p.endswith("a.csv") for p in archived)
    assert not os.path.exists(f"{tmp}/watch/a.csv")


def test_trim_on_read(spark):
    df = spark.createDataFrame([(" a\t", "x ")], "transaction_id string, category string")
    r = trimmed(df).first()
    assert (r.transaction_id, r.category) == ("a", "x")


def test_bounded_failure_reason(spark):
    rows = [(None,), ("   ",), ("  boom  ",), ("x" * 1500,)]
    out = [r[0] for r in spark.createDataFrame(rows, "r string").select(bounded_failure_reason(F.col("r"))).collect()]
    assert out[0] == out[1] == C.DEFAULT_FAILURE_REASON
    assert out[2] == "boom" and len(out[3]) == C.FAILURE_REASON_MAX


def test_transition_audit(spark):
    t = datetime(2025, 1, 1)
    ev = [("ok", 1, C.RECEIVED), ("ok", 2, C.QUEUED), ("ok", 3, C.PROCESSING), ("ok", 4, "BATCH"),
          ("ok", 5, C.PROCESSING), ("ok", 6, C.COMPLETED),
          ("skip", 1, C.RECEIVED), ("skip", 2, C.PROCESSING),
          ("after", 1, C.RECEIVED), ("after", 2, C.QUEUED), ("after", 3, C.FAILED), ("after", 4, C.PROCESSING)]
    df = spark.createDataFrame([(i, s, st, t + timedelta(seconds=s)) for i, s, st in ev],
                               "import_id string, seq long, status string, event_at timestamp")
    out = {r.import_id: (r.illegal_steps, r.first_illegal) for r in transition_audit(df).collect()}
    assert out == {"ok": (0, None), "skip": (1, "RECEIVED->PROCESSING"), "after": (1, "FAILED->PROCESSING")}


def test_keyset_page_plan(spark, tmp):
    """L1 + P3: partition pruning on import_id, Parquet pushdown of the
    cursor, and a top-n (no full sort)."""
    body = "".join(f"t{i},2025-01-02T03:04:05Z,1.00,c\n" for i in range(50))
    write(f"{tmp}/in/a.csv", HDR + body)
    write(f"{tmp}/in/b.csv", HDR + body)
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store")
    imp = rep["imports"][0]["import_id"]
    page = keyset_page(read_transactions(spark, f"{tmp}/store", imp), imp, "source_row", 10, 20)
    plan = _plan(page)
    assert "TakeOrderedAndProject" in plan
    assert "PartitionFilters: [isnotnull(import_id" in plan and f"(import_id#" in plan and imp in plan
    assert "GreaterThan(source_row,20)" in plan
    assert [r.source_row for r in page.orderBy("source_row").collect()] == list(range(21, 31))


def test_analytics_plan_aggregates_before_shuffle(spark):
    """A1: the facts are aggregated partially before any exchange; no
    Expand over the fact rows."""
    from ledgerline.operators.analytics import import_analytics
    from decimal import Decimal
    facts = spark.createDataFrame([("X", "a", datetime(2025, 1, 1), Decimal("1.00"))] * 10,
                                  "import_id string, category string, occurred_at timestamp, amount decimal(19,2)")
    plan = _plan(import_analytics(facts))
    assert "Expand" not in plan
    assert "partial_count" in plan or "partial_sum" in plan
