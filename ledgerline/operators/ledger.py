"""Import ledger: status fold (A9), counters (A6, K3), terminal rule (A8),
reconcile (A7), status projection (P4), audits (P7, P8), failure reason
bounding (P9), snapshot label (P10), stalled report (L6), existence gate
(J1), referential check (J3), throughput (A13) and outcome metrics (A14).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import contract as C
from ledgerline.functions.text import sql_btrim_blank

BATCH = "BATCH"  # ledger event carrying counters of committed rows
PURGED = "PURGED"  # ledger event that ends a job: earlier events no longer count
IO_FAULT = "IO_FAULT"  # ledger event of an attempt that could not read its file
#: Events that say nothing about a job's status.
NOT_STATUS = (BATCH, PURGED, IO_FAULT)


def is_terminal(status: Column) -> Column:
    return status.isin(*C.TERMINAL_STATUSES)


def terminal_status(rejected: Column, failed: Column) -> Column:
    """FAILED on a structural verdict, else COMPLETED iff no rejection."""
    return (F.when(failed, F.lit(C.FAILED))
            .when(rejected == 0, F.lit(C.COMPLETED))
            .otherwise(F.lit(C.COMPLETED_WITH_ERRORS)))


def bounded_failure_reason(reason: Column) -> Column:
    """Blank -> default text; strip; cut to 1000 chars."""
    stripped = F.regexp_replace(reason, r"^\p{javaWhitespace}+|\p{javaWhitespace}+\z", "")
    return (F.when(reason.isNull() | (F.length(stripped) == 0), F.lit(C.DEFAULT_FAILURE_REASON))
            .otherwise(F.substring(stripped, 1, C.FAILURE_REASON_MAX)))


def after_purge(events: DataFrame) -> DataFrame:
    """K8: the events after the last purge of their import. The purge side is
    one row per purged import; the adaptive join picks its strategy."""
    gone = events.filter(F.col("status") == PURGED).groupBy("import_id").agg(F.max("seq").alias("_gone"))
    live = F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))
    return events.join(gone, "import_id", "left").filter(live).select(*events.columns)


def current_jobs(events: DataFrame) -> DataFrame:
    """Fold an append-only event history into one job row per import.

    Status is the latest status event; terminal is sticky (a later
    non-terminal event never overrides it); counters accumulate over BATCH
    events. One aggregate — partial per key before the shuffle."""
    term = F.col("_is_status") & is_terminal(F.col("status"))
    # ordering key: any terminal beats any non-terminal; the first terminal
    # wins among terminals, the latest event among the others
    order = F.struct(F.when(term, 1).otherwise(0).alias("t"),
                     F.when(term, -F.col("seq")).otherwise(F.col("seq")).alias("s"))
    jobs = events.withColumn("_is_status", ~F.col("status").isin(*NOT_STATUS)).groupBy("import_id").agg(
        F.max_by(F.struct("status", "failure_reason"),
                 F.when(F.col("_is_status"), order)).alias("_last"),
        F.sum(F.col("accepted_rows")).alias("accepted_rows"),
        F.sum(F.col("rejected_rows")).alias("rejected_rows"),
        F.max("original_filename").alias("original_filename"),
        F.max("import_no").alias("import_no"),
        F.min(F.when(F.col("status") == C.RECEIVED, F.col("event_at"))).alias("created_at"),
        F.min(F.when(F.col("status") == C.QUEUED, F.col("event_at"))).alias("queued_at"),
        F.min(F.when(F.col("status") == C.PROCESSING, F.col("event_at"))).alias("started_at"),
        F.min(F.when(term, F.col("event_at"))).alias("finished_at"),
        F.max("event_at").alias("updated_at"))
    return jobs.select(
        "import_id", "original_filename", "import_no",
        F.col("_last.status").alias("status"),
        F.coalesce("accepted_rows", F.lit(0)).cast("long").alias("accepted_rows"),
        F.coalesce("rejected_rows", F.lit(0)).cast("long").alias("rejected_rows"),
        "created_at", "queued_at", "started_at", "finished_at", "updated_at",
        F.col("_last.failure_reason").alias("failure_reason"))


def status_view(jobs: DataFrame) -> DataFrame:
    """Status read model — processed = accepted + rejected, terminal flag,
    ISO-8601 instants (fraction only when non-zero), null-safe."""
    def iso(c: str) -> Column:
        col = F.col(c)
        frac = F.unix_micros(col) % 1000000
        return F.when(col.isNull(), F.lit(None)).when(
            frac == 0, F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
            F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss."),
                     F.regexp_replace(F.lpad(frac.cast("string"), 6, "0"), "(000)+$", ""), F.lit("Z")))
    return jobs.select(
        "import_id", "original_filename", "status",
        (F.col("accepted_rows") + F.col("rejected_rows")).alias("processed_rows"),
        "accepted_rows", "rejected_rows",
        is_terminal(F.col("status")).alias("terminal"),
        *[iso(c).alias(c) for c in ("created_at", "queued_at", "started_at", "finished_at", "updated_at")],
        "failure_reason")


def ledger_audit(jobs: DataFrame) -> DataFrame:
    """Per job, which state rules it breaks (empty list = consistent)."""
    s = F.col("status")
    cr, qu, st, fi, up = (F.col(c) for c in ("created_at", "queued_at", "started_at", "finished_at", "updated_at"))
    acc, rej, reason = F.col("accepted_rows"), F.col("rejected_rows"), F.col("failure_reason")
    nn = lambda c: c.isNotNull()
    rules = {
        "filename_not_blank": F.coalesce(~sql_btrim_blank(F.col("original_filename")), F.lit(False)),
        "status_valid": s.isin(*C.STATUSES),
        "counters_non_negative": (acc >= 0) & (rej >= 0),
        "timestamps_ordered": (
            (up >= cr) & (qu.isNull() | (qu >= cr))
            & (st.isNull() | (nn(qu) & (st >= qu)))
            & (fi.isNull() | (fi >= F.coalesce(st, qu, cr)))
            & (up >= F.coalesce(st, qu, cr))),
        "state_consistent": (
            ((s == C.RECEIVED) & (up == cr) & qu.isNull() & st.isNull() & fi.isNull()
             & reason.isNull() & (acc == 0) & (rej == 0))
            | ((s == C.QUEUED) & nn(qu) & (up == qu) & st.isNull() & fi.isNull()
               & reason.isNull() & (acc == 0) & (rej == 0))
            | ((s == C.PROCESSING) & nn(qu) & nn(st) & (up >= st) & fi.isNull() & reason.isNull())
            | ((s == C.COMPLETED) & nn(qu) & nn(st) & nn(fi) & (up == fi) & reason.isNull() & (rej == 0))
            | ((s == C.COMPLETED_WITH_ERRORS) & nn(qu) & nn(st) & nn(fi) & (up == fi)
               & reason.isNull() & (rej > 0))
            | ((s == C.FAILED) & nn(fi) & (up == fi) & nn(reason) & ~sql_btrim_blank(reason))),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()]))
    return jobs.select("import_id", "status", broken.alias("violations"),
                       (F.size(broken) == 0).alias("consistent"))


def record_audit(transactions: DataFrame, errors: DataFrame, jobs: DataFrame) -> DataFrame:
    """P8 + J3: per import, counts of rows breaking each record rule:
    source_row >= 2, non-blank texts, amount <> 0, key uniqueness, and
    orphans (import absent from the ledger)."""
    t = transactions.groupBy("import_id").agg(
        F.count("*").alias("transactions"),
        F.count_if(F.col("source_row") < 2).alias("bad_source_row"),
        F.count_if(sql_btrim_blank(F.col("transaction_id"))).alias("blank_transaction_id"),
        F.count_if(sql_btrim_blank(F.col("category"))).alias("blank_category"),
        F.count_if(F.col("amount") == 0).alias("zero_amount"))
    dup = (transactions.groupBy("import_id", "source_row").count().filter(F.col("count") > 1)
           .groupBy("import_id").agg(F.count("*").alias("duplicate_keys")))
    e = errors.groupBy("import_id").agg(
        F.count("*").alias("errors"),
        F.count_if((F.col("source_row") < 2) | sql_btrim_blank(F.col("error_code"))
                   | sql_btrim_blank(F.col("reason"))).alias("bad_errors"))
    ids = transactions.select("import_id").union(errors.select("import_id")).distinct()
    orphan = ids.join(jobs.select("import_id"), "import_id", "left_anti").withColumn("orphan", F.lit(True))
    out = ids.join(t, "import_id", "left").join(dup, "import_id", "left").join(e, "import_id", "left") \
        .join(orphan, "import_id", "left")
    return out.select("import_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (
        "transactions", "bad_source_row", "blank_transaction_id", "blank_category", "zero_amount",
        "duplicate_keys", "errors", "bad_errors")], F.coalesce("orphan", F.lit(False)).alias("orphan"))


def orphan_rows(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent key is absent (left anti join; Catalyst
    broadcasts the parent when its size is known to be small)."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def completion_reconcile(jobs: DataFrame, scan_counts: DataFrame) -> DataFrame:
    """Persisted counters must equal the counters seen by the scan."""
    j = jobs.select("import_id", "accepted_rows", "rejected_rows")
    s = scan_counts.select("import_id", F.col("accepted_rows").alias("scan_accepted"),
                           F.col("rejected_rows").alias("scan_rejected"))
    out = j.join(s, "import_id", "full_outer")
    return out.select(
        "import_id",
        F.coalesce("accepted_rows", F.lit(0)).alias("accepted_rows"),
        F.coalesce("rejected_rows", F.lit(0)).alias("rejected_rows"),
        F.coalesce("scan_accepted", F.lit(0)).alias("scan_accepted"),
        F.coalesce("scan_rejected", F.lit(0)).alias("scan_rejected"),
        ((F.coalesce("accepted_rows", F.lit(0)) == F.coalesce("scan_accepted", F.lit(0)))
         & (F.coalesce("rejected_rows", F.lit(0)) == F.coalesce("scan_rejected", F.lit(0)))).alias("reconciled"))


def stalled_imports(jobs: DataFrame, now: Column, older_than_seconds: int, n: int) -> DataFrame:
    """Non-terminal imports not updated for a while, oldest first, top n."""
    due = jobs.filter(~is_terminal(F.col("status"))
                      & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(older_than_seconds))))
    return due.orderBy(F.coalesce("started_at", "queued_at", "created_at"), "import_id").limit(n)


def throughput(jobs: DataFrame) -> DataFrame:
    """Rows per second of processing; null when unfinished or <= 0 s."""
    secs = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    rows = F.col("accepted_rows") + F.col("rejected_rows")
    return jobs.select("import_id", rows.alias("processed_rows"), secs.alias("seconds"),
                       F.when(secs > 0, rows / secs).alias("rows_per_second"))


def outcome_metrics(runs: DataFrame, outcome: str = "outcome", duration: str = "seconds") -> DataFrame:
    """Count and duration sum per outcome (a low-cardinality key)."""
    return runs.groupBy(outcome).agg(F.count("*").alias("runs"), F.sum(duration).alias("total_seconds"))


def snapshot_label(status: Column) -> Column:
    """P10: which snapshot an analytics read represents."""
    return (F.when(status.isin(C.COMPLETED, C.COMPLETED_WITH_ERRORS), F.lit("final"))
            .when(status == C.FAILED, F.lit("before_failure"))
            .otherwise(F.lit("partial")))


# fixed values: the legal status transitions of a job.
LEGAL_TRANSITIONS = [
    (C.RECEIVED, C.QUEUED), (C.QUEUED, C.PROCESSING), (C.PROCESSING, C.PROCESSING),
    (C.PROCESSING, C.COMPLETED), (C.PROCESSING, C.COMPLETED_WITH_ERRORS),
    (C.RECEIVED, C.FAILED), (C.QUEUED, C.FAILED), (C.PROCESSING, C.FAILED),
]


def transition_audit(events: DataFrame) -> DataFrame:
    """A9 (history check): every status event must follow a legal step from
    the previous status of the same import (``lag`` over the import's own
    status history, ordered by seq); the first must be RECEIVED; terminal is
    sticky. One row per import with counts and the first illegal step."""
    from pyspark.sql import Window
    st = events.filter(~F.col("status").isin(*NOT_STATUS)).select("import_id", "seq", "status")
    w = Window.partitionBy("import_id").orderBy("seq")
    prev = F.lag("status").over(w)
    legal = F.lit(False)
    for a, b in LEGAL_TRANSITIONS:
        legal = legal | ((F.col("prev") == a) & (F.col("status") == b))
    ok = F.when(F.col("prev").isNull(), F.col("status") == C.RECEIVED).otherwise(legal)
    steps = st.withColumn("prev", prev).withColumn("ok", ok)
    bad_step = F.when(~F.col("ok"), F.struct("seq", F.concat_ws("->", F.coalesce("prev", F.lit("START")), "status").alias("t")))
    return steps.groupBy("import_id").agg(
        F.count("*").alias("status_events"),
        F.count_if(~F.col("ok")).alias("illegal_steps"),
        F.min(bad_step)["t"].alias("first_illegal"))
