"""Analytics of very many imports: what a task groups and reads is bounded."""

from pyspark.sql import functions as F


def test_tasks_read_bounded_parts_of_a_shuffle(spark):
    from ledgerline.session import apply_conf
    apply_conf(spark)
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    assert size <= 16 << 20


def test_imports_without_rows_are_one_total_each(spark):
    """Only totals of the known imports are grouped: their empty categories and
    months tripled the groups that a task holds."""
    from ledgerline.operators.analytics import import_analytics
    facts = spark.createDataFrame([("a", None, None, 1), ("a", "x", "2024-02-03", 2), (None, "x", None, 4), ("z", "y", None, 8)],
                                  "import_id string, category string, at string, amount int").select(
        "import_id", "category", F.to_timestamp("at").alias("occurred_at"), F.col("amount").cast("decimal(19,2)").alias("amount"))
    known = spark.createDataFrame([("a",), ("a",), ("empty",), (None,)], "import_id string")
    out = import_analytics(facts, known)
    got = sorted((str(r[0]), r[1], str(r[2]), str(r[3]), r[4], int(r[5])) for r in out.collect())
    assert got == sorted([
        ("a", "TOTAL", "None", "None", 2, 3), ("a", "CATEGORY", "None", "None", 1, 1), ("a", "CATEGORY", "x", "None", 1, 2),
        ("a", "MONTH", "None", "None", 1, 1), ("a", "MONTH", "None", "2024-02", 1, 2), ("empty", "TOTAL", "None", "None", 0, 0),
        ("None", "TOTAL", "None", "None", 1, 4), ("None", "CATEGORY", "x", "None", 1, 4), ("None", "MONTH", "None", "None", 1, 4),
        ("z", "CATEGORY", "y", "None", 1, 8), ("z", "MONTH", "None", "None", 1, 8)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    union = plan[plan.index("Union"):]
    assert union.count("Generate") + union.count("Expand") == 1  # the facts' side only
    assert union[union.rindex("Project"):].count("TOTAL") == 1
