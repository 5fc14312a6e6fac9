"""Batch ingest: manifest -> scan -> verdicts -> commits of record ranges.

A run scans the text once and stages numbered, classified records. Then it
writes record ranges in order and commits each as a unit (K4): rows, counters
and zone map of a range become visible together, a run that is cut off leaves
a prefix of whole ranges, and the next run goes on behind it. What is known of
files - listing, numbers, verdicts, counters, events - stays in DataFrames; the
driver sees totals.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import contract as C
from ledgerline.operators import ladder
from ledgerline.operators.ledger import BATCH, IO_FAULT, PURGED, bounded_failure_reason, is_terminal, terminal_status
from ledgerline.operators.sink import ID_SHIFT, append_attempt, exists, table_path
from ledgerline.plans.store import (COMPACT_AFTER, Snapshot, commit, compact, delete, event_columns, numbered,
                                    zone_map)
from ledgerline.session import apply_conf, scratch_dir
from ledgerline.sources import csvscan

#: Unless told otherwise a commit takes this many batches of every file, and
#: more for very long files: a run makes at most MAX_COMMITS commits.
COMMIT_BATCHES = 1000
MAX_COMMITS = 32


# --------------------------------------------------------------------------- readers
def read_history(spark: SparkSession, root: str) -> DataFrame:
    """Every ledger event ever appended, purged imports included."""
    return Snapshot(spark, root).history()


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """The events of imports that exist, whole: those after an import's last purge."""
    from ledgerline.operators.ledger import after_purge
    return after_purge(read_history(spark, root))


def read_jobs(spark: SparkSession, root: str) -> DataFrame:
    return Snapshot(spark, root).jobs()


def read_transactions(spark: SparkSession, root: str, import_id: str | None = None) -> DataFrame:
    """Committed transactions (optionally one import: its files only)."""
    return Snapshot(spark, root).rows("transactions", import_id)


def read_errors(spark: SparkSession, root: str, import_id: str | None = None) -> DataFrame:
    return Snapshot(spark, root).rows("errors", import_id)


def read_page(spark: SparkSession, root: str, name: str, import_id: str, key: str = "source_row",
              limit: int | None = None, after: int | None = None) -> DataFrame:
    """L1-L4: a page of one import's rows, from the files that hold it."""
    return Snapshot(spark, root).page(name, import_id, key, limit, after)


def purge_import(spark: SparkSession, root: str, import_id: str) -> None:
    """K8: delete a job with its rows. The ledger event is the commit point: from
    then on readers see neither the job nor its files, and the file may be
    ingested again. The data folders go afterwards; a purge that was cut off
    there can be repeated. An unknown import is left alone."""
    snap = Snapshot(spark, root)
    last = (snap.history().filter(F.col("import_id") == import_id)
            .agg(F.max("seq").alias("seq"), F.max("import_no").alias("import_no")).first())
    if last["seq"] is None:
        return
    # folders of all attempts that ever held the import, from the commits' own zone maps
    parts = [p for p in snap._parts("files", snap.commits, False) if exists(spark, p)]
    attempts = [r["attempt"] for r in spark.read.parquet(*parts).filter(F.col("import_id") == import_id)
                .select("attempt").distinct().collect()] if parts else []
    now = _now()
    commit(spark, root, spark.range(1).select(*event_columns(
        import_id=F.lit(import_id), seq=F.lit(max(_seq(now), last["seq"] + 1)), status=F.lit(PURGED),
        import_no=F.lit(last["import_no"]), event_at=F.lit(now))))
    for name in ("transactions", "errors"):
        for a in attempts:
            delete(spark, os.path.join(table_path(root, name), f"attempt={a}", f"import_id={import_id}"))


# --------------------------------------------------------------------------- run
class _Trace:
    """Step timings on stderr when LEDGERLINE_TRACE is set (driver-side only)."""

    def __init__(self) -> None:
        self.on = bool(os.environ.get("LEDGERLINE_TRACE"))
        self.t = time.time()

    def __call__(self, step: str) -> None:
        if self.on:
            now = time.time()
            print(f"[ledgerline] {step}: {now - self.t:.2f}s", file=sys.stderr, flush=True)
            self.t = now


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _seq(at: dt.datetime) -> int:
    return int(at.timestamp() * 1_000_000) * 16


class Report(dict):
    """K7: ``run_id`` and the run's outcome, a row per file in ``frame``.

    ``imports``, ``refused`` and ``skipped_terminal`` are lists made from it
    when asked for; a run over very many files is read as a DataFrame."""

    FIELDS = ("import_id", "path", "status", "accepted", "rejected", "fault", "bad_record", "failure_reason")

    def __init__(self, run_id: str, frame: DataFrame):
        super().__init__(run_id=run_id)
        self.frame = frame

    def __missing__(self, key: str):
        kinds = {"imports": "import", "refused": "refused", "skipped_terminal": "skipped_terminal"}
        rows = self.frame.filter(F.col("kind") == kinds[key]).orderBy("path").collect()
        self[key] = ([{f: r[f] for f in self.FIELDS} for r in rows] if key == "imports" else
                     [{"path": r["path"], "reason": r["fault"]} for r in rows] if key == "refused" else
                     [r["import_id"] for r in rows])
        return self[key]


class _Run:
    """One call of :func:`ingest`: its folder of staged tables and its clock."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root, run_id
        self.folder = scratch_dir(spark, "staging")
        self.seq = 0
        self.commits = 0
        self.trace = _Trace()

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def next_seq(self, n: int = 1) -> tuple[int, dt.datetime]:
        """``n`` sequence numbers above all before, and the time."""
        now = _now()
        first = max(_seq(now), self.seq + 1)
        self.seq = first + n - 1
        return first, now


def ingest(spark: SparkSession, paths: list[str] | str, root: str,
           batch_size: int = C.BATCH_SIZE_DEFAULT,
           max_chars: int = C.MAX_RECORD_CHARS_DEFAULT,
           run_id: str | None = None, keep_staging: bool = False, consume: bool = False,
           commit_batches: int | None = None, max_commits: int | None = None,
           on_commit: Callable[[str], None] | None = None) -> Report:
    """Ingest every admitted CSV file under ``paths`` as one import each.

    Idempotent: imports already terminal in the ledger are skipped (R3), a
    resumed import goes on behind its last committed record (K1/K2), and
    counters count rows actually written (K3). ``commit_batches`` batches of
    every file make a commit; ``max_commits`` ends the run early, with the
    imports in PROCESSING; ``on_commit`` hears the name of every commit. A file
    that cannot be read to its end is tried once more after the others, then its
    import fails (R4). With ``consume`` the files of terminal imports are deleted
    after the commit (K6), those of an earlier run that was cut off before it
    included."""
    if not (C.BATCH_SIZE_MIN <= batch_size <= C.BATCH_SIZE_MAX):
        raise ValueError("batch_size out of range")
    if not (C.MAX_RECORD_CHARS_MIN <= max_chars <= C.MAX_RECORD_CHARS_MAX):
        raise ValueError("max_chars out of range")
    if commit_batches is not None and commit_batches < 1 or max_commits is not None and max_commits < 1:
        raise ValueError("commit_batches and max_commits must be positive")
    apply_conf(spark)
    run = _Run(spark, root, run_id or ("a" + uuid.uuid4().hex[:16]))
    files = run.staged(csvscan.manifest(spark, paths), "files")
    run.trace("manifest")
    snap = Snapshot(spark, root)
    known = snap.events()
    top = known.unionByName(snap.history_since_fold()).agg(F.max("import_no").alias("no"), F.max("seq").alias("seq")).first()
    run.seq = top["seq"] or 0
    faults = known.filter(F.col("status") == IO_FAULT).groupBy(F.col("import_id").alias("f_id")).agg(
        F.count("*").alias("io_faults"))
    jobs = snap.jobs().select(F.col("import_id").alias("j_id"), F.col("status").alias("j_status"),
                              F.col("import_no").alias("j_no"), F.col("accepted_rows").alias("prior_accepted"),
                              F.col("rejected_rows").alias("prior_rejected"))
    listed = files.filter("admitted").join(jobs, F.col("import_id") == F.col("j_id"), "left").join(
        faults, F.col("import_id") == F.col("f_id"), "left").drop("f_id")
    listed = run.staged(listed, "listed")
    ended = F.coalesce(is_terminal(F.col("j_status")), F.lit(False))
    skipped = listed.filter(ended)
    # numbers of purged imports are not given again
    new = numbered(listed.filter(~ended & F.col("j_id").isNull()), "path", "_nth", f"{run.folder}/new")
    new = new.withColumn("import_no", F.col("_nth") + F.lit((top["no"] or 0) + 1)).drop("_nth")
    todo = new.unionByName(listed.filter(~ended & F.col("j_id").isNotNull()).withColumn("import_no", F.col("j_no")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    todo = run.staged(todo.select(
        "path", "import_id", "original_filename", "file_size", "modification_time", "import_no",
        F.col("j_id").isNotNull().alias("resumed"), F.lit(max_chars).alias("max_chars"),
        zero("prior_accepted"), zero("prior_rejected"), zero("io_faults")), "todo")
    run.trace("ledger lookup")
    todo_files, fresh = todo.agg(F.count("*"), F.count_if(~F.col("resumed"))).first()
    if fresh:
        seq, now = run.next_seq(3)
        states = F.array(*[F.struct(F.lit(seq + k).alias("s"), F.lit(st).alias("st"))
                           for k, st in enumerate((C.RECEIVED, C.QUEUED, C.PROCESSING))])
        born = todo.filter(~F.col("resumed")).select("*", F.inline(states))
        commit(spark, root, born.select(*event_columns(
            **{c: F.col(c) for c in ("import_id", "original_filename", "path", "import_no")},
            seq=F.col("s"), status=F.col("st"), event_at=F.lit(now))))
    run.trace("ledger: processing events")
    verdicts = None
    if todo_files:
        limits = dict(batch_size=batch_size, max_chars=max_chars, commit_batches=commit_batches,
                      max_commits=max_commits, on_commit=on_commit)
        verdicts = _attempt(run, todo, "1", **limits)
        again = verdicts.filter(F.col("io_fault") & (F.col("io_faults") == 0)).select(*todo.columns)
        again = run.staged(again.withColumn("io_faults", F.lit(1).cast("long")), "again")
        if not again.isEmpty():  # R4: the others are done, these once more
            second = _attempt(run, again, "2", **limits)
            verdicts = verdicts.join(again.select("path"), "path", "left_anti").unionByName(second)
    final = Snapshot(spark, root)
    frame = _report_frame(run, files, skipped, verdicts, final)
    if consume:
        gone = skipped.select("path")
        if verdicts is not None:
            gone = gone.unionByName(frame.filter((F.col("kind") == "import") & is_terminal(F.col("status"))).select("path"))
        csvscan.delete_files(gone)
    if len(final.tail) > COMPACT_AFTER:
        compact(spark, root)
    if not keep_staging:  # this run's own staging folder only
        delete(spark, run.folder)
    run.trace("report")
    return Report(run.run_id, frame)


def _report_frame(run: _Run, files: DataFrame, skipped: DataFrame, verdicts: DataFrame | None,
                  final: Snapshot) -> DataFrame:
    """The run's outcome, stored beside the ledger: a row per file."""
    none = lambda t: F.lit(None).cast(t)
    refused = files.filter(~F.col("admitted")).select(
        F.lit("refused").alias("kind"), "path", none("string").alias("import_id"), none("string").alias("status"),
        F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("rejected"), F.col("refusal").alias("fault"),
        none("long").alias("bad_record"), none("string").alias("failure_reason"))
    out = refused.unionByName(skipped.select(
        F.lit("skipped_terminal").alias("kind"), "path", "import_id", F.col("j_status").alias("status"),
        F.col("prior_accepted").alias("accepted"), F.col("prior_rejected").alias("rejected"), none("string").alias("fault"),
        none("long").alias("bad_record"), none("string").alias("failure_reason")))
    if verdicts is not None:
        j = final.jobs().select(F.col("import_id").alias("j_id"), "status", F.col("accepted_rows").alias("accepted"),
                                F.col("rejected_rows").alias("rejected"), F.col("failure_reason").alias("j_reason"))
        fault = F.when(F.col("io_fault"), F.lit(IO_FAULT)).otherwise(F.col("fault"))
        out = out.unionByName(verdicts.drop("failure_reason").join(j, F.col("import_id") == F.col("j_id")).select(
            F.lit("import").alias("kind"), "path", "import_id", "status", "accepted", "rejected", fault.alias("fault"),
            F.when(~F.col("io_fault"), F.col("bad_record")).alias("bad_record"), F.col("j_reason").alias("failure_reason")))
    path = os.path.join(table_path(run.root, "runs"), run.run_id)
    out.write.mode("overwrite").parquet(path)
    return run.spark.read.schema(out.schema).parquet(path)


def _attempt(run: _Run, todo: DataFrame, tag: str, batch_size: int, max_chars: int, commit_batches: int | None,
             max_commits: int | None, on_commit: Callable[[str], None] | None) -> DataFrame:
    """Scan the files of ``todo`` and commit their records range by range;
    returns the verdicts. Files with an I/O fault commit no record."""
    spark, root = run.spark, run.root
    staged = csvscan.stage_records(spark, todo, f"{run.folder}/scan{tag}", max_chars)
    run.trace("stage records")
    verdicts = run.staged(csvscan.file_verdicts(spark, todo, staged.records(), staged.read_bytes(), batch_size),
                          f"verdicts{tag}")
    run.trace("verdicts")
    good = verdicts.filter(~F.col("io_fault")).withColumn("kept", F.col("cut_row") - 2).withColumn(
        "done", F.least(F.col("prior_accepted") + F.col("prior_rejected"), F.col("cut_row") - 2))
    size = good.agg(F.count("*").alias("n"), F.max("kept").alias("most"), F.min("done").alias("done")).first()
    if size["n"]:
        batches = -(-size["most"] // batch_size)
        span = batch_size * (commit_batches or max(COMMIT_BATCHES, -(-batches // MAX_COMMITS)))
        for k in range(size["done"] // span, max(1, -(-size["most"] // span))):
            if max_commits is not None and run.commits >= max_commits:
                break
            name = _commit_range(run, good, staged, f"{run.run_id}-{tag}-{k:06d}", k * span, (k + 1) * span,
                                 k == size["done"] // span, batch_size)
            run.commits += 1
            run.trace(f"range {k}")
            if on_commit:
                on_commit(name)
    bad = verdicts.filter("io_fault")
    if not bad.isEmpty():
        _commit_faults(run, bad)
    return verdicts


def _commit_range(run: _Run, good: DataFrame, staged: csvscan.Staged, attempt: str, lo: int, hi: int, first: bool,
                  batch_size: int) -> str:
    """K4: the records at places lo..hi-1 of every file as one unit. Imports
    that end in the range get their terminal status in the same commit."""
    spark, root = run.spark, run.root
    here = good.filter((F.col("kept") > lo) & (F.col("done") < hi))
    cut = here.select("path", "import_id", "import_no", "cut_row", (F.col("done") + 2).alias("_from"))
    kept = (staged.between(lo + 2, hi + 1).filter(F.col("record_no") >= 2).join(cut, "path")
            .filter((F.col("record_no") >= F.col("_from")) & (F.col("record_no") < F.col("cut_row")))
            .withColumnRenamed("record_no", "source_row"))
    # classification happened while staging: only stored columns are filtered here
    acc = (ladder.accepted(kept, ["import_id", "import_no", "source_row"])
           .withColumn("id", F.col("import_no") * F.lit(ID_SHIFT) + F.col("source_row")))
    rej = (ladder.rejected(kept, ["import_id", "source_row"])
           .withColumn("reason", ladder.reason_for(F.col("error_code"))))  # derived, not staged
    append_attempt(acc.select(*C.TRANSACTION_SCHEMA.fieldNames()), table_path(root, "transactions"), attempt, ["id"])
    append_attempt(rej.select(*C.ERROR_SCHEMA.fieldNames()), table_path(root, "errors"), attempt, ["source_row"])
    seq, now = run.next_seq(2)
    files = run.staged(zone_map(spark, root, attempt, seq), f"map-{attempt}")
    # K3: counters of rows actually written by this attempt
    is_tx = F.col("table") == "transactions"
    counts = files.groupBy(F.col("import_id").alias("n_id")).agg(
        F.sum(F.when(is_tx, F.col("rows")).otherwise(0)).alias("n_acc"),
        F.sum(F.when(is_tx, 0).otherwise(F.col("rows"))).alias("n_rej"))
    before = Snapshot(spark, root).events().filter(F.col("status") == BATCH).groupBy(F.col("import_id").alias("b_id")).agg(
        F.sum("accepted_rows").alias("b_acc"), F.sum("rejected_rows").alias("b_rej"))
    ends = (F.col("kept") <= hi) & ((F.col("kept") > lo) | F.lit(first))
    in_range = F.col("path").isNotNull() & (ends | ((F.col("kept") > lo) & (F.col("done") < hi)))
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    state = run.staged(
        good.filter(in_range).join(counts, F.col("import_id") == F.col("n_id"), "left")
        .join(before, F.col("import_id") == F.col("b_id"), "left")
        .select("import_id", "kept", "fault", "failure_reason", ends.alias("ends"), c("n_acc").alias("acc"), c("n_rej").alias("rej"),
                (c("n_acc") + c("b_acc")).alias("all_acc"), (c("n_rej") + c("b_rej")).alias("all_rej")), f"state-{attempt}")
    # Persisted counters must equal what the scan handed to the sink
    off = state.filter((F.col("all_acc") + F.col("all_rej")) != F.least(F.col("kept"), F.lit(hi))).first()
    if off:
        raise RuntimeError(f"counters of {off['import_id']} do not reconcile: {off['all_acc']}+{off['all_rej']} "
                           f"of {off['kept']} records up to {hi}")
    batch = state.select(*event_columns(
        import_id=F.col("import_id"), seq=F.lit(seq), attempt=F.lit(attempt), status=F.lit(BATCH),
        accepted_rows=F.col("acc"), rejected_rows=F.col("rej"), first_batch=F.lit(lo // batch_size),
        last_batch=F.ceil(F.least(F.col("kept"), F.lit(hi)) / batch_size) - 1, event_at=F.lit(now)))
    failed = F.col("fault").isNotNull()
    end = state.filter("ends").select(*event_columns(
        import_id=F.col("import_id"), seq=F.lit(seq + 1), status=terminal_status(F.col("all_rej"), failed),
        failure_reason=F.when(failed, F.col("failure_reason")), event_at=F.lit(now)))  # bounded (P9) in the verdicts
    return commit(spark, root, batch.unionByName(end), files)


def _commit_faults(run: _Run, bad: DataFrame) -> None:
    """An attempt that could not read its file is on record; the second one
    fails the import, with the I/O fault as its reason."""
    seq, now = run.next_seq(2)
    why = F.concat(F.lit("The file could not be read completely ("), F.col("file_size").cast("string"),
                   F.lit(" bytes listed)."))
    tried = bad.select(*event_columns(import_id=F.col("import_id"), seq=F.lit(seq), status=F.lit(IO_FAULT),
                                      failure_reason=why, event_at=F.lit(now)))
    failed = bad.filter("io_faults > 0").select(*event_columns(
        import_id=F.col("import_id"), seq=F.lit(seq + 1), status=F.lit(C.FAILED),
        failure_reason=bounded_failure_reason(why), event_at=F.lit(now)))
    commit(run.spark, run.root, tried.unionByName(failed))


# --------------------------------------------------------------------------- report
def report_text(report: dict) -> str:
    """K7: the run report as text, one line per file."""
    n = {s: sum(i["status"] == s for i in report["imports"]) for s in C.TERMINAL_STATUSES}
    lines = [f"run {report['run_id']}: " + ", ".join(f"{s} {k}" for s, k in n.items())
             + f", refused {len(report['refused'])}, already terminal {len(report['skipped_terminal'])}"]
    lines += [f"{i['status']} {i['path']}: {i['accepted']} accepted, {i['rejected']} rejected"
              + (f" ({i['failure_reason']})" if i["failure_reason"] else "") for i in report["imports"]]
    lines += [f"REFUSED {r['path']}: {r['reason']}" for r in report["refused"]]
    return "\n".join(lines)


def write_run_report(spark: SparkSession, report: Report, path: str) -> DataFrame:
    """K7: the run report as JSON, one line per file; returns its DataFrame."""
    df = report.frame.select(F.lit(report["run_id"]).alias("run_id"), "kind", "path", "import_id", "status", "accepted",
                             "rejected", "fault", "bad_record", F.col("failure_reason").alias("reason"))
    df.write.mode("overwrite").json(path)
    return df
