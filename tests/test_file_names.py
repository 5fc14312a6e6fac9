"""File identity, long quoted fields, digits of other scripts, gates, percentiles."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.csvfields import split_fields
from ledgerline.functions.decimals import ascii_digits
from ledgerline.operators import metrics, pages
from ledgerline.operators.analytics import import_analytics
from ledgerline.plans.ingest import ingest
from tests.conftest import write

HEAD = "transaction_id,occurred_at,amount,category\n"


def test_names_and_long_quoted_fields(spark, tmp):
    names = ["my file.csv", "a%20b.csv", "data[1].csv", "c#d.csv", "e{f}.csv", "ü.csv", "UP.CSV"]
    for k, n in enumerate(names):
        write(f"{tmp}/in/{n}", HEAD + f't{k},2025-01-01T00:00:00Z,1.00,"{"x" * 3000}""y"\n' + f"u{k},2025-01-01T00:00:00Z,1.00,c\n")
    write(f"{tmp}/in/empty one.csv", "")
    report = ingest(spark, f"{tmp}/in", f"{tmp}/store")
    assert len(report["imports"]) == len(names)
    assert all((i["accepted"], i["rejected"]) == (1, 1) for i in report["imports"]), report["imports"]
    assert [r["reason"] for r in report["refused"]] == ["REFUSED_EMPTY"]


def test_unquote_any_length(spark):
    big = "x" * 900_000
    df = spark.createDataFrame([(f'"{big}""z"  ,b,"",""""',)], "r string").select(split_fields(F.col("r")).alias("f"))
    assert df.first().f == [big + '"z', "b", "", '"']


def test_digits_of_other_scripts(spark):
    df = spark.createDataFrame([("١٢.٠٠",), ("１２.３４",), ("12.34",), ("é",)], "a string").select(ascii_digits(F.col("a")).alias("a"))
    assert [r.a for r in df.collect()] == ["12.00", "12.34", "12.34", "é"]


def test_gate(spark):
    jobs = spark.createDataFrame([("a",), ("b",)], "import_id string")
    rows = spark.createDataFrame([("a", 2, " t ", " c ")], "import_id string, source_row long, transaction_id string, category string")
    assert [(r.transaction_id, r.category) for r in pages.import_page(jobs, rows, "a", "source_row").collect()] == [("t", "c")]
    assert pages.import_page(jobs, rows, "b", "source_row").count() == 0
    with pytest.raises(pages.ImportNotFound):
        pages.import_page(jobs, rows, "z", "source_row")
    with pytest.raises(pages.InvalidPagination):  # arguments come first
        pages.import_page(jobs, rows, "z", "source_row", limit=0)


def test_percentiles_are_exact_without_a_buffer(spark):
    df = spark.range(50_001).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    out = metrics.percentile_disc(df, ["g"], "v", 0.9, "p")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile_disc" not in plan and "percentile(" not in plan
    want = {r.g: r.p for r in df.groupBy("g").agg(F.expr("percentile_disc(0.9) within group (order by v)").alias("p")).collect()}
    assert {r.g: r.p for r in out.collect()} == want


def test_analytics_scans_the_facts_once(spark, tmp):
    f = spark.createDataFrame([("a", "c", "2025-01-01", "1.00")], "import_id string, category string, d string, a string").select(
        "import_id", "category", F.col("d").cast("timestamp").alias("occurred_at"), F.col("a").cast("decimal(19,2)").alias("amount"))
    f.write.parquet(f"{tmp}/facts")
    facts = spark.read.parquet(f"{tmp}/facts")
    imports = spark.createDataFrame([("a",), ("none",)], "import_id string")
    out = import_analytics(facts, imports)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") + \
        out._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    assert out.filter("aggregation_type = 'TOTAL'").count() == 2
