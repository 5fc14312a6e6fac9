"""The order files: written as ranges by many tasks, byte for byte the ordered records."""

import glob

from pyspark.sql import functions as F

from ledgerline.plans import derived as D
from ledgerline.plans import files as FI


def _orders(spark, tmp, n=3000, splits=7):
    i = F.col("id")
    status = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit(None).cast("string"), F.lit("a b/c")), (i % 4 + 1).cast("int"))
    prio = F.element_at(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM")), (i % 3 + 1).cast("int"))
    (spark.range(n, numPartitions=splits).select(
        i.alias("o_orderkey"), (i % 50).alias("o_custkey"), status.alias("o_orderstatus"),
        (i.cast("double") + 0.25).alias("o_totalprice"),
        F.timestamp_seconds(i * 3600 + 800000000).cast("timestamp_ntz").alias("o_orderdate"), prio.alias("o_orderpriority"))
     .repartition(splits, F.xxhash64("o_orderkey")).write.parquet(f"{tmp}/orders.parquet"))
    return tmp


def _with_narrow_ranges(spark, build):
    """The build with every range a task of its own."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = build()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    return out


def test_order_files_are_ranges_of_many_tasks(spark, tmp, monkeypatch):
    sf = _orders(spark, tmp)
    seen = []
    join = D.csvscan.join_files
    monkeypatch.setattr(D.csvscan, "join_files", lambda f: (seen.extend(len(r["parts"]) for r in f.collect()), join(f)))
    for eol in ("\n", "\r\n"):
        out = _with_narrow_ranges(spark, lambda: D.write_order_csv_files(spark, sf, eol=eol))
        want = {}
        for r in D.order_fields(spark, sf).orderBy("o_orderkey").collect():
            folder = {"a b/c": "a b%2Fc", None: "__HIVE_DEFAULT_PARTITION__"}.get(r["import_id"], r["import_id"])
            want.setdefault(folder, ["transaction_id,occurred_at,amount,category"]).append(r["record"])
        got = {p.split("import_id=")[1].split("/")[0]: open(p, newline="").read() for p in glob.glob(f"{out}/*/*.csv")}
        assert got == {k: eol.join(x.replace("\n", eol) for x in v) + eol for k, v in want.items()}
    assert max(seen) > 1  # before, one task sorted and wrote a whole file
    assert not glob.glob(f"{out}-parts")


def test_fault_files_keep_key_order(spark, tmp):
    sf = _orders(spark, tmp)
    out = _with_narrow_ranges(spark, lambda: FI.write_fault_files(spark, sf))
    for p in glob.glob(f"{out}/*/*.csv"):
        keys = [int(x.split(",")[0].split("-")[1]) for x in open(p) if x.startswith("ord-")]
        assert keys and keys == sorted(keys)
