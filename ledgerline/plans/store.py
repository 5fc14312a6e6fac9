"""The stored state of imports: commits, snapshots, zone map, compaction.

Layout under a root folder::

    transactions/attempt=<a>/import_id=<i>/*.parquet   data, written first
    errors/attempt=<a>/import_id=<i>/*.parquet
    ledger/<n>/events/*.parquet                        a commit: ledger events and
    ledger/<n>/files/*.parquet                         the zone map of the data they name
    ledger_folded/<n>/...                              commits up to <n>, folded

A commit is one folder, renamed into place, so its events and its files are
seen together or not at all; data that no commit names does not exist for a
reader. Names of commits rise, one writer owns a ledger. A :class:`Snapshot`
fixes the set of commits once, so whatever is read through it - status, pages,
analytics, also of an import that is still running - belongs together.

The zone map has a row per data file: its import, row count and first and last
source row. A page opens the files its rows lie in and lists no folder.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import contract as C
from ledgerline.operators.ledger import BATCH, IO_FAULT, PURGED, after_purge, current_jobs, is_terminal
from ledgerline.operators.pages import ImportNotFound, check_page_args, keyset_page, trimmed
from ledgerline.operators.sink import ID_SHIFT, exists, table_path

TX_READ_SCHEMA = T.StructType([f for f in C.TRANSACTION_SCHEMA.fields if f.name != "import_id"]
                              + [T.StructField("attempt", T.StringType()), T.StructField("import_id", T.StringType())])
ERR_READ_SCHEMA = T.StructType([f for f in C.ERROR_SCHEMA.fields if f.name != "import_id"]
                               + [T.StructField("attempt", T.StringType()), T.StructField("import_id", T.StringType())])
READ_SCHEMAS = {"transactions": TX_READ_SCHEMA, "errors": ERR_READ_SCHEMA}
FILES_SCHEMA = T.StructType([
    T.StructField("import_id", T.StringType()), T.StructField("attempt", T.StringType()),
    T.StructField("table", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("first_row", T.LongType()),
    T.StructField("last_row", T.LongType()), T.StructField("import_no", T.LongType()),
    T.StructField("seq", T.LongType())])
#: Commits that a reader folds itself; beyond them the writer compacts.
COMPACT_AFTER = 24
#: A single import with more data files than this is read by folder.
MAX_PATHS = 5_000


# --------------------------------------------------------------------------- folders
def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; those in the making (``_``) left out."""
    if not exists(spark, path):
        return []
    fs, p = _fs(spark, path)
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n[0] not in "._")


def _publish(spark: SparkSession, making: str, final: str) -> None:
    fs, p = _fs(spark, making)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(final)):
        raise OSError(f"cannot publish {final}")


# --------------------------------------------------------------------------- commits
def commit(spark: SparkSession, root: str, events: DataFrame, files: DataFrame | None = None) -> str:
    """Append a commit; returns its name. The rename is the commit point."""
    ledger = table_path(root, "ledger")
    last = children(spark, ledger)
    name = f"{max(time.time_ns() // 1000, int(last[-1].split('-')[0]) + 1 if last else 0):020d}-{uuid.uuid4().hex[:8]}"
    making = os.path.join(ledger, "_" + name)
    events.select(*[F.col(f.name).cast(f.dataType) for f in C.LEDGER_SCHEMA.fields]).write.parquet(making + "/events")
    if files is not None:
        files.select(*FILES_SCHEMA.fieldNames()).write.parquet(making + "/files")
    _publish(spark, making, os.path.join(ledger, name))
    return name


def event_columns(**given) -> list:
    """The ledger's columns, null or zero but for the given ones."""
    zero = {"accepted_rows": F.lit(0), "rejected_rows": F.lit(0)}
    return [given.get(f.name, zero.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in C.LEDGER_SCHEMA.fields]


def zone_map(spark: SparkSession, root: str, attempt: str, seq: int) -> DataFrame:
    """The data files of an attempt, read back: counters (K3) and key ranges
    are those of the rows that were written."""
    out = None
    for name, schema in READ_SCHEMAS.items():
        base = table_path(root, name)
        folder = os.path.join(base, f"attempt={attempt}")
        if not exists(spark, folder):
            continue
        rows = spark.read.schema(schema).option("basePath", base).parquet(folder)
        number = F.max(F.shiftright("id", 40)) if name == "transactions" else F.lit(None).cast("long")
        part = rows.groupBy("import_id", F.col("_metadata.file_path").alias("_uri")).agg(
            F.count("*").alias("rows"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"),
            number.alias("import_no"))
        part = part.select("import_id", F.lit(attempt).alias("attempt"), F.lit(name).alias("table"),
                           F.concat(F.lit(f"attempt={attempt}/import_id="), "import_id", F.lit("/"),
                                    F.element_at(F.split("_uri", "/"), -1)).alias("file"),
                           "rows", "first_row", "last_row", "import_no", F.lit(seq).cast("long").alias("seq"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FILES_SCHEMA) if out is None else out


# --------------------------------------------------------------------------- folding
def fold_events(events: DataFrame) -> DataFrame:
    """Events that stand for ``events`` of live imports: any later events added,
    :func:`current_jobs` gives the same. One event per import and status, one
    with all counters; I/O faults and purges stay as they are."""
    live = after_purge(events)
    kept = live.filter(F.col("status").isin(IO_FAULT, PURGED))
    gone = events.filter(F.col("status") == PURGED)
    plain = live.filter(~F.col("status").isin(IO_FAULT, PURGED))
    first = is_terminal(F.col("status"))  # of the terminal events the first counts, of others the last
    at = F.when(first, -F.col("seq")).otherwise(F.col("seq"))
    statuses = plain.filter(F.col("status") != BATCH).groupBy("import_id", "status").agg(
        F.max_by("seq", at).alias("seq"), F.max_by(F.struct("failure_reason"), at).alias("_r"),
        F.max("original_filename").alias("original_filename"), F.max("path").alias("path"),
        F.max("import_no").alias("import_no"), F.min("event_at").alias("event_at"))
    statuses = statuses.select(*event_columns(**{c: F.col(c) for c in (
        "import_id", "status", "seq", "original_filename", "path", "import_no", "event_at")},
        failure_reason=F.col("_r.failure_reason")))
    batch = F.col("status") == BATCH
    sums = live.groupBy("import_id").agg(
        F.max("seq").alias("seq"), F.sum("accepted_rows").alias("accepted_rows"), F.sum("rejected_rows").alias("rejected_rows"),
        F.min(F.when(batch, F.col("first_batch"))).alias("first_batch"),
        F.max(F.when(batch, F.col("last_batch"))).alias("last_batch"), F.max("event_at").alias("event_at"),
        F.max("original_filename").alias("original_filename"), F.max("path").alias("path"), F.max("import_no").alias("import_no"),
        F.bool_or(~F.col("status").isin(IO_FAULT, PURGED)).alias("_any")).filter("_any")
    sums = sums.select(*event_columns(status=F.lit(BATCH), **{c: F.col(c) for c in (
        "import_id", "seq", "accepted_rows", "rejected_rows", "first_batch", "last_batch", "event_at",
        "original_filename", "path", "import_no")}))
    names = C.LEDGER_SCHEMA.fieldNames()
    return statuses.unionByName(sums).unionByName(kept.select(*names)).unionByName(gone.select(*names)).distinct()


def compact(spark: SparkSession, root: str) -> str | None:
    """Fold all commits so far; readers then open the folded state and the
    commits after it. The commits stay, as the history of the ledger."""
    snap = Snapshot(spark, root)
    if not snap.tail:
        return None
    folded = table_path(root, "ledger_folded")
    making = os.path.join(folded, "_" + snap.version)
    fold_events(snap.history_since_fold()).write.mode("overwrite").parquet(making + "/events")
    snap.files().write.mode("overwrite").parquet(making + "/files")
    _publish(spark, making, os.path.join(folded, snap.version))
    return snap.version


class Snapshot:
    """The commits at one moment (or up to ``version``)."""

    def __init__(self, spark: SparkSession, root: str, version: str | None = None):
        self.spark, self.root = spark, root
        upto = lambda names: [n for n in names if version is None or n <= version]
        commits = upto(children(spark, table_path(root, "ledger")))
        folds = upto(children(spark, table_path(root, "ledger_folded")))
        self.version = commits[-1] if commits else ""
        self.folded = folds[-1] if folds else None
        self.commits = commits
        self.tail = [n for n in commits if self.folded is None or n > self.folded]

    def _parts(self, kind: str, commits: list[str], folded: bool) -> list[str]:
        out = [os.path.join(table_path(self.root, "ledger"), n, kind) for n in commits]
        if folded and self.folded:
            out.append(os.path.join(table_path(self.root, "ledger_folded"), self.folded, kind))
        return out

    def _read(self, schema: T.StructType, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*parts)

    def history(self) -> DataFrame:
        """Every event ever appended, purged imports included."""
        return self._read(C.LEDGER_SCHEMA, self._parts("events", self.commits, False))

    def history_since_fold(self) -> DataFrame:
        return self._read(C.LEDGER_SCHEMA, self._parts("events", self.tail, True))

    def events(self) -> DataFrame:
        """Events that give the state of every live import."""
        return after_purge(self.history_since_fold())

    def jobs(self) -> DataFrame:
        return current_jobs(self.events())

    def files(self) -> DataFrame:
        """The zone map: data files of live imports."""
        # commits without data have no files folder: events tell nothing about it, the listing does
        parts = [p for p in self._parts("files", self.tail, True) if exists(self.spark, p)]
        found = self._read(FILES_SCHEMA, parts)
        gone = self.history_since_fold().filter(F.col("status") == PURGED).groupBy(F.col("import_id").alias("_i")).agg(
            F.max("seq").alias("_gone"))
        return found.join(gone, F.col("import_id") == F.col("_i"), "left").filter(
            F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))).select(*FILES_SCHEMA.fieldNames())

    def _of_import(self, name: str, import_id: str) -> list:
        return self.files().filter((F.col("import_id") == import_id) & (F.col("table") == name)).collect()

    def _open(self, name: str, import_id: str, found: list) -> DataFrame:
        base = table_path(self.root, name)
        if not found:
            return self.spark.createDataFrame([], READ_SCHEMAS[name]).drop("attempt")
        paths = [r["file"] for r in found]
        if len(paths) > MAX_PATHS:
            paths = sorted({p.rsplit("/", 1)[0] for p in paths})
        df = self.spark.read.schema(READ_SCHEMAS[name]).option("basePath", base).parquet(
            *[os.path.join(base, p) for p in paths])
        return df.filter(F.col("import_id") == import_id).drop("attempt")

    def rows(self, name: str, import_id: str | None = None) -> DataFrame:
        """Committed rows of ``name``, of all imports or of one."""
        if import_id is not None:
            return self._open(name, import_id, self._of_import(name, import_id))
        base = table_path(self.root, name)
        if not exists(self.spark, base):
            return self.spark.createDataFrame([], READ_SCHEMAS[name]).drop("attempt")
        live = self.files().filter(F.col("table") == name).select("import_id", "attempt").distinct()
        df = self.spark.read.schema(READ_SCHEMAS[name]).option("basePath", base).parquet(base)
        return df.join(live, ["import_id", "attempt"], "left_semi").drop("attempt")

    def page(self, name: str, import_id: str, key: str, limit: int | None = None, after: int | None = None) -> DataFrame:
        """A page of one import, from the files that hold it."""
        n, cursor = check_page_args(limit, after)
        found = self._of_import(name, import_id)
        if not found and self.events().filter(F.col("import_id") == import_id).isEmpty():
            raise ImportNotFound(f"import {import_id} does not exist")
        return trimmed(keyset_page(self._open(name, import_id, page_files(found, key, n, cursor)), import_id, key, n, cursor))


def page_files(found: list, key: str, limit: int, after: int) -> list:
    """The files that can hold the first ``limit`` + 1 keys after the cursor.
    Files may overlap. Keys are distinct integers, so of a file's rows at most
    those between its first key and the cursor lie before it; the others are
    counted at its last key until there are enough, and no file that begins
    later is needed."""
    shift = (lambda r: r["import_no"] * ID_SHIFT) if key == "id" else (lambda r: 0)
    found = [r for r in found if r["last_row"] + shift(r) > after]
    held, last = 0, None
    for r in sorted(found, key=lambda r: r["last_row"]):
        held += max(0, r["rows"] - max(0, after - shift(r) - r["first_row"] + 1))
        if held > limit:
            last = r["last_row"]
            break
    return [r for r in found if last is None or r["first_row"] <= last]


# --------------------------------------------------------------------------- numbering
def numbered(df: DataFrame, order: str, name: str, path: str) -> DataFrame:
    """``df`` with 0-based positions in ``order`` as ``name``: sorted ranges are
    stored with their ordinals, and the counts of earlier ranges are summed, so
    no task sees more than its range."""
    ordinal = F.monotonically_increasing_id()
    (df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_o", ordinal).write.parquet(path))
    stored = df.sparkSession.read.parquet(path).withColumn("_p", F.shiftright("_o", 33))
    before = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = stored.groupBy(F.col("_p").alias("_q")).agg(F.count("*").alias("_n")).select(
        "_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_o") - F.shiftleft("_p", 33)
    return stored.join(counts, F.col("_p") == F.col("_q")).withColumn(name, at).drop("_o", "_p", "_q", "_before")
