"""Views derived from the driver tables (TPC-H-like parquet), so every
registered query reads real tables and its work grows with them.

Roles: ``orders`` are import facts (import = order status, category = order
priority); ``lineitem`` are signed facts (refunds negative) and a batch with
real key conflicts; ``customer`` is an import ledger; ``events`` are
latency samples; ``orders`` + ``lineitem`` also drive a job ledger.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import contract as C
from ledgerline.operators.ledger import BATCH
from ledgerline.plans.store import delete, make_folder
from ledgerline.session import scratch_dir
from ledgerline.sources import csvscan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ts(c: str) -> Column:
    """Driver parquet timestamps are timestamp_ntz; the session is UTC."""
    return F.col(c).cast("timestamp")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderstatus").alias("import_id"),
        (F.col("o_orderkey") + 1).alias("id"),
        (F.col("o_orderkey") + 2).alias("source_row"),
        F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string")).alias("transaction_id"),
        ts("o_orderdate").alias("occurred_at"),
        F.col("o_totalprice").cast("decimal(19,2)").alias("amount"),
        F.col("o_orderpriority").alias("category"))


def refund_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed facts: returned line items (flag R) are negative amounts."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(19,2)")
    return li.select(
        F.col("l_linestatus").alias("import_id"),
        F.col("l_returnflag").alias("category"),
        ts("l_shipdate").alias("occurred_at"),
        F.when(F.col("l_returnflag") == "R", -price).otherwise(price).alias("amount"))


# fixed values: the corruption chosen for each order key (key % 17), one per
# error code plus accepted edge forms. Used by both the Spark side and SQL.
CORRUPTION_MOD = 17


def order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four raw text fields of a CSV record per order (with one
    deliberate corruption per key class), plus the record text."""
    return with_fields(table(spark, sf_dir, "orders"))


def with_fields(o: DataFrame, *keep: str) -> DataFrame:
    """``order_fields`` of the given orders, with their columns ``keep``."""
    k = F.pmod(F.col("o_orderkey"), F.lit(CORRUPTION_MOD))
    tid = F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string"))
    when_ = F.date_format(ts("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss")
    amount = F.col("o_totalprice").cast("decimal(19,2)").cast("string")
    cents = (F.col("o_totalprice").cast("decimal(19,2)") * 100).cast("decimal(19,0)").cast("string")
    cat = F.col("o_orderpriority")
    f_tid = (F.when(k == 2, F.lit("   ")).when(k == 3, F.concat(tid, F.lit("-"), F.repeat(F.lit("x"), 64)))
             .otherwise(tid))
    f_ts = (F.when(k == 4, F.concat(F.date_format(ts("o_orderdate"), "yyyy-MM-dd HH:mm:ss"), F.lit("Z")))
            .when(k == 5, F.concat(when_, F.lit("+03:00")))
            .when(k == 12, F.concat(when_, F.lit(".5z")))
            .otherwise(F.concat(when_, F.lit("Z"))))
    f_amt = (F.when(k == 6, F.lit("n/a")).when(k == 7, F.concat(amount, F.lit("0")))
             .when(k == 8, F.lit("123456789012345678.90")).when(k == 9, F.lit("0.00"))
             .when(k == 13, F.concat(cents, F.lit("E-2")))
             .otherwise(amount))
    f_cat = (F.when(k == 10, F.lit("")).when(k == 11, F.rpad(cat, 101, "*"))
             .when(k == 14, F.concat(cat, F.lit(", especial")))
             .when(k == 15, F.concat(cat, F.lit("\nsecond line")))
             .otherwise(cat))
    quoted_cat = F.when(k.isin(14, 15), F.concat(F.lit('"'), f_cat, F.lit('"'))).otherwise(f_cat)
    record = (F.when(k == 0, F.lit(""))
              .when(k == 1, F.concat_ws(",", f_tid, f_ts, f_amt))
              .otherwise(F.concat_ws(",", f_tid, f_ts, f_amt, quoted_cat)))
    return o.select(F.col("o_orderstatus").alias("import_id"), F.col("o_orderkey"),
                    (F.col("o_orderkey") + 2).alias("source_row"), k.alias("k"),
                    f_tid.alias("f_tid"), f_ts.alias("f_ts"), f_amt.alias("f_amt"), f_cat.alias("f_cat"),
                    record.alias("record"), *keep)


def write_order_csv_files(spark: SparkSession, sf_dir: str, eol: str = "\n") -> str:
    """Write one CSV file per order status (header + records by order key)
    into a fresh folder under the shared root; returns the folder. ``eol`` ends
    the lines, those inside quotes as well."""
    o = table(spark, sf_dir, "orders").withColumn("header", F.lit(False))
    header = (o.select("o_orderstatus").distinct()
              .select("o_orderstatus", F.lit(-1).cast("long").alias("o_orderkey"), F.lit(True).alias("header")))
    # the orders are ordered, their records are made where they are written
    ranges = (o.unionByName(header, allowMissingColumns=True).repartitionByRange("o_orderstatus", "o_orderkey")
              .sortWithinPartitions("o_orderstatus", "o_orderkey"))
    record = F.when(F.col("header"), F.lit(",".join(C.EXPECTED_HEADER))).otherwise(F.col("record"))
    lines = with_fields(ranges, "header").select("import_id", F.replace(record, F.lit("\n"), F.lit(eol)).alias("value"))
    return write_csv_files(spark, lines, "import_id", scratch_dir(spark, "orders-csv"), eol)


def write_csv_files(spark: SparkSession, lines: DataFrame, folder: str, out: str, eol: str = "\n") -> str:
    """One CSV file per value of the column ``folder``, of lines (``value``) whose
    partitions are consecutive ranges in file order; returns ``out``.

    Every task writes its range of a file with the text writer (raw lines, blank
    lines kept), so no task sorts or holds a whole file; the ranges' bytes are
    then put behind one another."""
    parts = f"{out}-parts"
    lines.write.partitionBy(folder).option("lineSep", eol).text(parts)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(parts)
              .select("path", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("folder")))
    in_order = F.array_sort(F.collect_list(F.struct(F.length("path").alias("n"), "path")))
    files = listed.groupBy("folder").agg(F.transform(in_order, lambda x: x["path"]).alias("parts")).select(
        F.concat(F.lit(f"{out}/"), F.col("folder")).alias("to"), "parts")
    make_folder(spark, out)
    csvscan.join_files(files.repartition(spark.sparkContext.defaultParallelism, "to"))
    delete(spark, parts)
    return out


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job-event history: each order is an import. Orders with status O
    are queued only, P are processing, F finished; each line item is one
    committed batch row (R = rejected).

    Each table is read once: an order's line items are gathered (a handful an
    order), and an order's events are one array, exploded."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("line"), ts("l_shipdate").alias("shipped"),
                                (F.col("l_returnflag") != "R").cast("long").alias("acc"))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    status, at = F.col("o_orderstatus"), ts("o_orderdate")
    hours = lambda n: at + F.make_dt_interval(hours=F.lit(n))
    lines = F.coalesce("lines", F.array().cast("array<struct<line:bigint,shipped:timestamp,acc:bigint>>"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    def event(seq, st, when, acc=zero, rej=zero, batch=none):
        return F.struct(F.lit(seq).cast("long").alias("seq") if isinstance(seq, int) else seq.alias("seq"), st.alias("status"),
                        when.alias("event_at"), acc.alias("accepted_rows"), rej.alias("rejected_rows"), batch.alias("batch"))

    batches = F.transform(lines, lambda x: event(x["line"] + 10, F.lit(BATCH), F.greatest(x["shipped"], hours(2)),
                                                 x["acc"], 1 - x["acc"], x["line"]))
    rejected = F.exists(lines, lambda x: x["acc"] == 0)
    end = event(1000, F.when(rejected, F.lit(C.COMPLETED_WITH_ERRORS)).otherwise(F.lit(C.COMPLETED)),
                F.greatest(F.array_max(F.transform(lines, lambda x: x["shipped"])), hours(2)))
    events = F.concat(
        F.array(event(1, F.lit(C.RECEIVED), at), event(2, F.lit(C.QUEUED), hours(1))),
        F.filter(F.concat(F.array(event(3, F.lit(C.PROCESSING), hours(2))), batches), lambda x: status != "O"),
        F.filter(F.array(end), lambda x: (status == "F") & (F.size(lines) > 0)))
    e = o.select(F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("import_id"), "o_orderkey",
                 F.concat(F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]", "")), F.lit(".csv")).alias("name"),
                 F.inline(events))
    plain = F.col("status") != BATCH
    return e.select("import_id", "seq", F.lit(None).cast("string").alias("attempt"),
                    F.when(plain, F.col("name")).alias("original_filename"), F.lit(None).cast("string").alias("path"),
                    F.when(plain, F.col("o_orderkey")).cast("long").alias("import_no"), "status", "accepted_rows",
                    "rejected_rows", F.col("batch").alias("first_batch"), F.col("batch").alias("last_batch"),
                    F.lit(None).cast("string").alias("failure_reason"), "event_at")
