"""End-to-end ingest: golden fixture, file verdicts, numbering, prefix,
idempotency, pages, analytics (reference test strategy, on Spark)."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import write
from ledgerline.operators.analytics import import_analytics
from ledgerline.operators.pages import InvalidPagination, keyset_page
from ledgerline.plans.ingest import ingest, read_errors, read_jobs, read_transactions

HDR = "transaction_id,occurred_at,amount,category\n"


def _one(rep, name):
    return next(i for i in rep["imports"] if i["path"].endswith(name))


def test_golden_end_to_end(spark, tmp):
    write(f"{tmp}/in/golden.csv", HDR + "txn-e2e-001,2025-01-10T10:00:00Z,100.00,Alimentação\n"
          "txn-e2e-002,2025-01-11T10:00:00Z,valor-inválido,Transporte\n"
          "txn-e2e-003,2025-02-01T10:00:00Z,-25.50,Alimentação\n")
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store", batch_size=2)
    imp = _one(rep, "golden.csv")
    assert (imp["status"], imp["accepted"], imp["rejected"]) == ("COMPLETED_WITH_ERRORS", 2, 1)
    errs = read_errors(spark, f"{tmp}/store").collect()
    assert [(e.source_row, e.error_code) for e in errs] == [(3, "AMOUNT_INVALID")]
    a = {(r.aggregation_type, r.category, r.month): (r.transaction_count, str(r.total_amount)) for r in
         import_analytics(read_transactions(spark, f"{tmp}/store"), read_jobs(spark, f"{tmp}/store")).collect()}
    assert a[("TOTAL", None, None)] == (2, "74.50")
    assert a[("CATEGORY", "Alimentação", None)] == (2, "74.50")
    assert a[("MONTH", None, "2025-01")] == (1, "100.00")
    assert a[("MONTH", None, "2025-02")] == (1, "-25.50")
    # Redelivery of a terminal import changes nothing
    rep2 = ingest(spark, f"{tmp}/in", f"{tmp}/store", batch_size=2)
    assert rep2["imports"] == [] and len(rep2["skipped_terminal"]) == 1
    assert read_transactions(spark, f"{tmp}/store").count() == 2


def test_file_verdicts(spark, tmp):
    d = f"{tmp}/in"
    write(f"{d}/header.csv", "id,occurred_at,amount,category\n")
    write(f"{d}/syntax.csv", HDR + 'txn-0001,2025-01-02T03:04:05Z,10.50,"categoria sem fechamento\n')
    write(f"{d}/utf8.csv", HDR.encode() + bytes([0xC3, 0x28]))
    write(f"{d}/oversize.csv", HDR + "txn-0001,2025-01-02T03:04:05Z,10.50," + "x" * 4097 + "\n")
    write(f"{d}/multi_oversize.csv", HDR + 'txn-0001,2025-01-02T03:04:05Z,10.50,"' + "trecho\n" * 800 + '"\n')
    write(f"{d}/junk.csv", HDR + 'a,2025-01-02T03:04:05Z,1.00,"x"y\n')
    write(f"{d}/bom.csv", "﻿" + HDR + "a,2025-01-02T03:04:05Z,1.00,x\n")
    write(f"{d}/crlf.csv", HDR.replace("\n", "\r\n") + "a,2025-01-02T03:04:05Z,1.00,x\r\n")
    write(f"{d}/nofinalnl.csv", HDR + "a,2025-01-02T03:04:05Z,1.00,x")
    write(f"{d}/empty.csv", "")
    write(f"{d}/notes.txt", HDR)
    rep = ingest(spark, d, f"{tmp}/store")
    assert _one(rep, "header.csv")["fault"] == "HEADER_MISMATCH"
    assert _one(rep, "syntax.csv")["fault"] == "CSV_SYNTAX"
    assert _one(rep, "utf8.csv")["fault"] == "INVALID_UTF8"
    ov = _one(rep, "oversize.csv")
    assert ov["fault"] == "RECORD_TOO_LARGE" and "record 2" in ov["failure_reason"] and "4096" in ov["failure_reason"]
    assert _one(rep, "multi_oversize.csv")["fault"] == "RECORD_TOO_LARGE"
    assert _one(rep, "multi_oversize.csv")["bad_record"] == 2
    assert _one(rep, "junk.csv")["fault"] == "CSV_SYNTAX"
    assert _one(rep, "crlf.csv")["status"] == "COMPLETED"
    assert _one(rep, "nofinalnl.csv")["status"] == "COMPLETED"
    refused = {os.path.basename(r["path"]): r["reason"] for r in rep["refused"]}
    assert refused == {"empty.csv": "REFUSED_EMPTY", "notes.txt": "REFUSED_NAME"}
    for name in ("header.csv", "syntax.csv", "utf8.csv", "oversize.csv"):
        assert _one(rep, name)["status"] == "FAILED"


def test_bom_is_a_header_mismatch(spark, tmp):
    write(f"{tmp}/in/bom.csv", "﻿" + HDR + "a,2025-01-02T03:04:05Z,1.00,x\n")
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store")
    assert _one(rep, "bom.csv")["status"] == "FAILED"


def test_committed_prefix_and_numbering(spark, tmp):
    """K5: bad record at data ordinal 5, batch 2 -> first 4 records stay."""
    good = "a{},2025-01-02T03:04:05Z,1.00,x\n"
    body = "".join(good.format(i) for i in range(4)) + 'bad,2025-01-02T03:04:05Z,1.00,"open\n' + good.format(9)
    write(f"{tmp}/in/prefix.csv", HDR + body)
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store", batch_size=2)
    imp = _one(rep, "prefix.csv")
    assert imp["status"] == "FAILED" and imp["bad_record"] == 6 and imp["accepted"] == 4
    rows = sorted(r.source_row for r in read_transactions(spark, f"{tmp}/store").collect())
    assert rows == [2, 3, 4, 5]


def test_numbering_many_splits_multiline(spark, tmp):
    """S5/S6 across many splits: blank lines, quoted newlines and rejected
    rows consume numbers; several files in one scan."""
    lines = []
    expect = {}
    row = 2
    for i in range(3000):
        if i % 97 == 0:
            lines.append("")  # blank line -> COLUMN_COUNT, consumes a number
        elif i % 31 == 0:
            lines.append(f'm{i},2025-01-02T03:04:05Z,1.00,"two\nlines, ""quoted"""')
            expect[row] = f'two\nlines, "quoted"'
        else:
            lines.append(f"t{i},2025-01-02T03:04:05Z,1.00,c{i}")
            expect[row] = f"c{i}"
        row += 1
    text = HDR + "\n".join(lines) + "\n"
    write(f"{tmp}/in/a.csv", text)
    write(f"{tmp}/in/b.csv", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rep = ingest(spark, f"{tmp}/in", f"{tmp}/store")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for imp in rep["imports"]:
        assert imp["status"] == "COMPLETED_WITH_ERRORS" and imp["accepted"] == len(expect)
        got = {r.source_row: r.category for r in read_transactions(spark, f"{tmp}/store", imp["import_id"]).collect()}
        assert got == expect


def test_pages(spark, tmp):
    """Keyset pages with look-ahead cursors."""
    rows = {2: "a", 5: "b", 8: "c", 13: "d", 21: "e"}
    lines = []
    for r in range(2, 22):
        lines.append(f"t{r},2025-01-02T03:04:05Z,1.00,{rows[r]}" if r in rows else "")
    write(f"{tmp}/in/x.csv", HDR + "\n".join(lines) + "\n")
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store")
    imp = rep["imports"][0]["import_id"]
    tx = read_transactions(spark, f"{tmp}/store", imp)
    cursor, pages = 0, []
    while cursor is not None:
        page = keyset_page(tx, imp, "source_row", 2, cursor).orderBy("source_row").collect()
        pages.append([p.source_row for p in page])
        cursor = page[-1].next_cursor if page else None
    assert pages == [[2, 5], [8, 13], [21]]
    errs = read_errors(spark, f"{tmp}/store", imp)
    first = keyset_page(errs, imp, "source_row", 200, None).collect()
    assert len(first) == 15 and first[0].next_cursor is None
    with pytest.raises(InvalidPagination):
        keyset_page(tx, imp, "id", 0, 0)
    with pytest.raises(InvalidPagination):
        keyset_page(tx, imp, "id", 10, -1)


def test_empty_and_unknown_import_analytics(spark):
    """an import known to the ledger but without rows has a zero TOTAL."""
    facts = spark.createDataFrame([], "import_id string, category string, occurred_at timestamp, amount decimal(19,2)")
    imports = spark.createDataFrame([("X",)], "import_id string")
    out = import_analytics(facts, imports).collect()
    assert [(r.aggregation_type, r.transaction_count, str(r.total_amount)) for r in out] == [("TOTAL", 0, "0.00")]


def test_isolation(spark):
    """analytics of one import ignore other imports."""
    from decimal import Decimal
    from datetime import datetime
    rows = [("X", "alimentação", datetime(2025, 1, 5, 10), Decimal("100.00")),
            ("X", "alimentação", datetime(2025, 1, 31, 23, 59, 59), Decimal("-25.50")),
            ("X", "transporte", datetime(2025, 2, 1), Decimal("50.25")),
            ("Y", "outros", datetime(2025, 1, 1), Decimal("999.99"))]
    facts = spark.createDataFrame(rows, "import_id string, category string, occurred_at timestamp, amount decimal(19,2)")
    out = {(r.aggregation_type, r.category, r.month): (r.transaction_count, str(r.total_amount))
           for r in import_analytics(facts.filter(F.col("import_id") == "X")).collect()}
    assert out[("TOTAL", None, None)] == (3, "124.75")
    assert out[("MONTH", None, "2025-01")] == (2, "74.50") and out[("MONTH", None, "2025-02")] == (1, "50.25")
