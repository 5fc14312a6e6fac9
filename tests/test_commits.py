"""Commits of record ranges (K4), snapshots (R5), zone map (S10, L1), folding
(A9), I/O faults (R4), separators inside quotes (S5), many files (K3, R1)."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import write
from ledgerline import contract as C
from ledgerline.operators.analytics import import_analytics
from ledgerline.operators.ledger import current_jobs, status_view, transition_audit
from ledgerline.operators.pages import ImportNotFound
from ledgerline.plans import store
from ledgerline.plans.ingest import ingest, read_errors, read_events, read_history, read_jobs, read_page, read_transactions

HDR = "transaction_id,occurred_at,amount,category\n"


def body(n, bad_every=7):
    return "".join(f"t{i},2025-01-02T03:04:05Z,{'0.00' if i % bad_every == 3 else '1.00'},c{i % 3}\n" for i in range(n))


class Killed(Exception):
    pass


def killer(after):
    seen = []

    def hook(name):
        seen.append(name)
        if len(seen) == after:
            raise Killed
    return hook


def stored(spark, root, imp=None):
    snap = store.Snapshot(spark, root)
    rows = sorted([r.source_row for r in snap.rows("transactions", imp).collect()]
                  + [r.source_row for r in snap.rows("errors", imp).collect()])
    return rows, {r.import_id: r for r in snap.jobs().collect()}


def test_killed_run_leaves_whole_ranges_and_goes_on(spark, tmp):
    write(f"{tmp}/in/a.csv", HDR + body(100))
    with pytest.raises(Killed):
        ingest(spark, f"{tmp}/in", f"{tmp}/store", batch_size=10, commit_batches=2, on_commit=killer(3))
    rows, jobs = stored(spark, f"{tmp}/store")
    (imp, job), = jobs.items()
    assert rows == list(range(2, 62)) and job.accepted_rows + job.rejected_rows == 60 and job.status == C.PROCESSING
    view = status_view(read_jobs(spark, f"{tmp}/store")).first()
    assert (view.processed_rows, view.terminal) == (60, False)
    # uncommitted data of a cut-off attempt is not seen
    os.makedirs(f"{tmp}/store/transactions/attempt=dead/import_id={imp}", exist_ok=True)
    some = next(r["file"] for r in store.Snapshot(spark, f"{tmp}/store").files().collect() if r["table"] == "transactions")
    data = open(f"{tmp}/store/transactions/{some}", "rb").read()
    open(f"{tmp}/store/transactions/attempt=dead/import_id={imp}/p.parquet", "wb").write(data)
    assert stored(spark, f"{tmp}/store")[0] == list(range(2, 62))
    # another range length goes on behind the last record
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store", batch_size=7, commit_batches=3)
    assert [(i["status"], i["accepted"] + i["rejected"]) for i in rep["imports"]] == [("COMPLETED_WITH_ERRORS", 100)]
    rows, jobs = stored(spark, f"{tmp}/store")
    assert rows == list(range(2, 102)) and jobs[imp].rejected_rows == len([i for i in range(100) if i % 7 == 3])
    # a replay adds nothing
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store", batch_size=10, commit_batches=2)
    assert rep["imports"] == [] and rep["skipped_terminal"] == [imp]
    assert stored(spark, f"{tmp}/store")[0] == list(range(2, 102))
    assert [r.illegal_steps for r in transition_audit(read_events(spark, f"{tmp}/store")).collect()] == [0]


def test_failed_file_keeps_its_prefix_over_ranges(spark, tmp):
    write(f"{tmp}/in/a.csv", HDR + body(25) + 'x,2025-01-02T03:04:05Z,1.00,"open\n' + body(5))
    write(f"{tmp}/in/b.csv", HDR + body(3))
    write(f"{tmp}/in/c.csv", HDR)
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store", batch_size=4, commit_batches=2)
    got = {os.path.basename(i["path"]): (i["status"], i["accepted"] + i["rejected"]) for i in rep["imports"]}
    assert got == {"a.csv": ("FAILED", 24), "b.csv": ("COMPLETED", 3), "c.csv": ("COMPLETED", 0)} or \
        got == {"a.csv": ("FAILED", 24), "b.csv": ("COMPLETED_WITH_ERRORS", 3), "c.csv": ("COMPLETED", 0)}


def test_reader_during_a_run_sees_one_state(spark, tmp):
    write(f"{tmp}/in/a.csv", HDR + body(60))
    seen = []

    def look(name):
        snap = store.Snapshot(spark, f"{tmp}/store")
        job = snap.jobs().first()
        rows = snap.rows("transactions", job.import_id)
        total = import_analytics(rows, snap.jobs()).filter("aggregation_type = 'TOTAL'").first()
        page = snap.page("transactions", job.import_id, "source_row", 200).count()
        seen.append((job.accepted_rows + job.rejected_rows, job.accepted_rows, total.transaction_count, page, snap.version))
    ingest(spark, f"{tmp}/in", f"{tmp}/store", batch_size=10, commit_batches=2, on_commit=look)
    assert [s[0] for s in seen] == [20, 40, 60]
    assert all(s[1] == s[2] == s[3] for s in seen)
    # an earlier version is still readable as it was
    old = store.Snapshot(spark, f"{tmp}/store", seen[0][4])
    assert old.jobs().first().accepted_rows == seen[0][1] == old.rows("transactions").count()


def test_page_opens_the_files_of_the_cursor(spark, tmp):
    write(f"{tmp}/in/a.csv", HDR + body(400, 1000))
    write(f"{tmp}/in/b.csv", HDR + body(30, 1000))
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store", batch_size=10, commit_batches=5)
    imp = next(i["import_id"] for i in rep["imports"] if i["path"].endswith("a.csv"))
    snap = store.Snapshot(spark, f"{tmp}/store")
    assert snap.files().filter((F.col("import_id") == imp) & (F.col("table") == "transactions")).count() >= 8
    for key in ("source_row", "id"):
        ids = {r.source_row: r[key] for r in snap.rows("transactions", imp).collect()}
        after = ids[220]
        page = read_page(spark, f"{tmp}/store", "transactions", imp, key, 10, after)
        assert len(page.inputFiles()) == 1
        assert sorted(r.source_row for r in page.collect()) == list(range(221, 231))
        cursor, seen = 0, []
        while cursor is not None:
            rows = read_page(spark, f"{tmp}/store", "transactions", imp, key, 150, cursor).orderBy(key).collect()
            seen += [r.source_row for r in rows]
            cursor = rows[-1].next_cursor if rows else None
        assert seen == sorted(ids)
    with pytest.raises(ImportNotFound):
        read_page(spark, f"{tmp}/store", "transactions", "none")
    assert read_page(spark, f"{tmp}/store", "errors", imp).count() == len([i for i in range(400) if i % 1000 == 3])


def test_page_files_overlap():
    r = lambda a, b, n, no=1: {"first_row": a, "last_row": b, "rows": n, "import_no": no, "file": f"{a}-{b}"}
    files = [r(2, 50, 10), r(20, 30, 5), r(40, 90, 20), r(91, 200, 90), r(201, 300, 50)]
    names = lambda limit, after: [f["file"] for f in store.page_files(files, "source_row", limit, after)]
    assert names(200, 0) == [f["file"] for f in files]
    assert names(3, 0) == ["2-50", "20-30"]  # five rows lie in 20-30, so nothing after 30 is needed
    assert names(30, 60) == ["40-90", "91-200"]
    assert names(3, 42) == ["2-50", "40-90"]  # of the 20 rows in 40-90 at most three lie before the cursor
    assert names(89, 90) == ["91-200"] and names(90, 90) == ["91-200", "201-300"]
    rng = random.Random(4)
    for _ in range(300):
        rows = rng.sample(range(2, 400), rng.randrange(1, 120))
        pool, parts = rows[:], []
        while pool:
            take = [pool.pop() for _ in range(min(len(pool), rng.randrange(1, 20)))]
            parts.append(sorted(take))
        zones = [{"first_row": p[0], "last_row": p[-1], "rows": len(p), "import_no": 0, "at": k} for k, p in enumerate(parts)]
        after, limit = rng.randrange(0, 400), rng.randrange(1, 50)
        chosen = store.page_files(zones, "source_row", limit, after)
        got = sorted(x for z in chosen for x in parts[z["at"]] if x > after)[:limit + 1]
        assert got == sorted(x for x in rows if x > after)[:limit + 1]


def test_io_fault_is_tried_again_and_spares_the_others(spark, tmp):
    """A wrong checksum file makes the local file system fail in the middle."""
    good = HDR + body(50)
    write(f"{tmp}/in/a.csv", good)
    write(f"{tmp}/in/bad.csv", good)
    write(f"{tmp}/in/.bad.csv.crc", b"crc\0\0\0\2\0" + b"\1\2\3\4" * 8)
    write(f"{tmp}/in/z.csv", good)
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store")
    got = {os.path.basename(i["path"]): (i["status"], i["accepted"] + i["rejected"], i["fault"]) for i in rep["imports"]}
    assert got == {"a.csv": ("COMPLETED_WITH_ERRORS", 50, None), "z.csv": ("COMPLETED_WITH_ERRORS", 50, None),
                   "bad.csv": ("FAILED", 0, "IO_FAULT")}
    history = [r.status for r in read_history(spark, f"{tmp}/store").orderBy("seq").collect()]
    assert history.count("IO_FAULT") == 2 and history[-1] == "FAILED"
    assert "could not be read" in next(i for i in rep["imports"] if i["path"].endswith("bad.csv"))["failure_reason"]


def test_io_fault_that_passes(spark, tmp):
    """The file is whole again at the second attempt of the same run."""
    write(f"{tmp}/in/a.csv", HDR + body(5))
    write(f"{tmp}/in/bad.csv", HDR + body(9))
    write(f"{tmp}/in/.bad.csv.crc", b"crc\0\0\0\2\0" + b"\1\2\3\4")
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store", on_commit=lambda n: os.path.exists(f"{tmp}/in/.bad.csv.crc")
                 and os.remove(f"{tmp}/in/.bad.csv.crc"))
    assert {(os.path.basename(i["path"]), i["accepted"] + i["rejected"], i["fault"]) for i in rep["imports"]} == {
        ("a.csv", 5, None), ("bad.csv", 9, None)}


def test_separators_inside_quotes(spark, tmp):
    crlf = HDR.replace("\n", "\r\n") + 'a,2025-01-02T03:04:05Z,1.00,"one\r\ntwo"\r\nb,2025-01-02T03:04:05Z,1.00,x\r\n' \
        'c,2025-01-02T03:04:05Z,1.00,"p\rq\nr\r\n"\r\n'
    write(f"{tmp}/in/crlf.csv", crlf)
    write(f"{tmp}/in/cr.csv", crlf.replace("\r\n", "\r"))
    write(f"{tmp}/in/mixed.csv", HDR + "a,2025-01-02T03:04:05Z,1.00,x\r\rb,2025-01-02T03:04:05Z,1.00,y\r\n"
                                       "\r\nc,2025-01-02T03:04:05Z,1.00,\"z\"\r")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in (old, "23"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            rep = ingest(spark, f"{tmp}/in", f"{tmp}/store{split}")
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        ids = {os.path.basename(i["path"]): i["import_id"] for i in rep["imports"]}
        rows = lambda n: {r.source_row: r.category for r in read_transactions(spark, f"{tmp}/store{split}", ids[n]).collect()}
        assert rows("crlf.csv") == {2: "one\r\ntwo", 3: "x", 4: "p\rq\nr\r\n"}
        assert rows("cr.csv") == {2: "one\rtwo", 3: "x", 4: "p\rq\nr\r"}
        assert rows("mixed.csv") == {2: "x", 4: "y", 6: "z"}
        assert sorted(r.source_row for r in read_errors(spark, f"{tmp}/store{split}", ids["mixed.csv"]).collect()) == [3, 5]


def test_crlf_counts_two_characters(spark, tmp):
    head = 'a,2025-01-02T03:04:05Z,1.00,"'
    fits = "x\r\n" * 160 + "y" * (512 - len(head) - 1 - 480)
    write(f"{tmp}/in/fits.csv", HDR + head + fits + '"\n')
    write(f"{tmp}/in/long.csv", HDR + head + fits + 'y"\n')
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store", max_chars=512)
    got = {os.path.basename(i["path"]): i["fault"] for i in rep["imports"]}
    assert got == {"fits.csv": None, "long.csv": "RECORD_TOO_LARGE"}


def random_events(rng, n):
    t0, out = datetime(2025, 1, 1), []
    statuses = [C.RECEIVED, C.QUEUED, C.PROCESSING, "BATCH", "BATCH", "BATCH", *C.TERMINAL_STATUSES, "PURGED", "IO_FAULT"]
    for s in range(1, n + 1):
        st = rng.choice(statuses)
        out.append((f"i{rng.randrange(6)}", s, f"a{s}" if st == "BATCH" else None, rng.choice([None, "f.csv"]), None,
                    rng.randrange(9), st, rng.randrange(5) if st == "BATCH" else 0, rng.randrange(3) if st == "BATCH" else 0,
                    None, None, "why" if st == C.FAILED else None, t0 + timedelta(seconds=rng.randrange(10_000))))
    return out


def test_folding_changes_no_job(spark):
    for seed in range(4):
        rng = random.Random(seed)
        events = random_events(rng, 80)
        k = rng.randrange(10, 70)
        df = lambda rows: spark.createDataFrame(rows, C.LEDGER_SCHEMA)
        folded = store.fold_events(df(events[:k]))
        assert folded.count() <= k + 6
        whole = sorted(map(str, current_jobs(store.after_purge(df(events))).collect()))
        assert sorted(map(str, current_jobs(store.after_purge(folded.unionByName(df(events[k:])))).collect())) == whole


def test_compaction_keeps_the_store(spark, tmp):
    write(f"{tmp}/in/a.csv", HDR + body(40))
    write(f"{tmp}/in/b.csv", HDR + body(15))
    root = f"{tmp}/store"
    ingest(spark, f"{tmp}/in", root, batch_size=5, commit_batches=2, max_commits=2)
    before = (stored(spark, root)[0], sorted(map(str, read_jobs(spark, root).collect())))
    assert store.compact(spark, root) is not None and store.compact(spark, root) is None
    snap = store.Snapshot(spark, root)
    assert snap.tail == [] and (stored(spark, root)[0], sorted(map(str, snap.jobs().collect()))) == before
    ingest(spark, f"{tmp}/in", root, batch_size=5)
    assert len(store.Snapshot(spark, root).tail) >= 1
    rows, jobs = stored(spark, root)
    assert rows == sorted([*range(2, 42), *range(2, 17)]) and {j.status for j in jobs.values()} == {C.COMPLETED_WITH_ERRORS}
    store.compact(spark, root)
    assert stored(spark, root)[0] == rows
    assert read_history(spark, root).count() > store.Snapshot(spark, root).history_since_fold().count()


def test_three_thousand_files(spark, tmp):
    for k in range(3000):
        write(f"{tmp}/in/{k % 7}/f{k:04d}.csv", HDR + f"t{k},2025-01-02T03:04:05Z,{'x' if k % 10 == 0 else '1.00'},c\n")
    write(f"{tmp}/in/none.csv", "")
    rep = ingest(spark, f"{tmp}/in", f"{tmp}/store")
    jobs = read_jobs(spark, f"{tmp}/store")
    by = {r.status: r.n for r in jobs.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert by == {C.COMPLETED: 2700, C.COMPLETED_WITH_ERRORS: 300}
    assert jobs.agg(F.count_distinct("import_no"), F.min("import_no"), F.max("import_no")).first()[:] == (3000, 1, 3000)
    order = [r.original_filename for r in jobs.orderBy("import_no").collect()]
    assert order == sorted(order, key=lambda n: (int(n[1:5]) % 7, n))
    assert read_transactions(spark, f"{tmp}/store").count() == 2700
    assert rep.frame.count() == 3001 and len(rep["refused"]) == 1


def test_stream_takes_files_by_bytes(spark, tmp):
    from ledgerline.streaming.file_stream import start_ingest_stream
    for k, n in enumerate((200, 2, 2, 200, 2)):
        write(f"{tmp}/watch/f{k}.csv", HDR + body(n))
        os.utime(f"{tmp}/watch/f{k}.csv", (1_700_000_000 + 60 * k,) * 2)  # the source goes by time
    reports = []
    q = start_ingest_stream(spark, f"{tmp}/watch", f"{tmp}/store", f"{tmp}/ckpt", available_now=True,
                            max_files_per_trigger=None, max_bytes_per_trigger=1000, reports=reports)
    q.awaitTermination()
    assert read_jobs(spark, f"{tmp}/store").count() == 5 and 2 <= len(reports) <= 4
    assert sum(len(r["imports"]) for r in reports) == 5
    with pytest.raises(ValueError):
        start_ingest_stream(spark, f"{tmp}/watch", f"{tmp}/store", f"{tmp}/ckpt2", max_files_per_trigger=2,
                            max_bytes_per_trigger=5)
