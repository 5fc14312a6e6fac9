"""Import analytics (A1–A5), share windows (W1, W2), month label (P5) and
canonical order (L5).

Plan: aggregate once by (import_id, category, month) — a partial aggregate
that shrinks the fact table to one row per group before any shuffle — then
count each group of that small result in its three levels. The TOTAL row comes from the
import list (ledger), not from the facts, so an import with no rows still
gets ``TOTAL, 0, 0.00`` (Spark's GROUPING SETS returns nothing on empty
input).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import java_trim

TOTAL, CATEGORY, MONTH = "TOTAL", "CATEGORY", "MONTH"
AMOUNT_T = "decimal(38,2)"


def month_start(ts):
    """UTC month of an instant (session time zone is UTC)."""
    return F.trunc(F.to_date(ts), "MM")


def month_label(d):
    """P5: YYYY-MM."""
    return F.date_format(d, "yyyy-MM")


def _pre_aggregate(facts: DataFrame) -> DataFrame:
    return (facts.select("import_id", "category", month_start(F.col("occurred_at")).alias("month_start"), "amount")
            .groupBy("import_id", "category", "month_start")
            .agg(F.count("*").alias("n"), F.sum("amount").alias("s")))


def import_analytics(facts: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """A1–A4: one snapshot per import — TOTAL, per CATEGORY, per MONTH.

    ``imports`` (one row per known import) makes empty imports appear with
    a zero TOTAL; without it the imports are those present in the facts."""
    pre = _pre_aggregate(facts)
    # each group of the small pre-aggregate counts in three levels: the facts are
    # read once whether or not the runtime reuses an exchange
    none_c, none_m = F.lit(None).cast("string"), F.lit(None).cast("date")
    levels = F.array(*[F.struct(F.lit(kind).alias("aggregation_type"), c.alias("level_category"), m.alias("level_month"))
                       for kind, c, m in ((TOTAL, none_c, none_m), (CATEGORY, F.col("category"), none_m),
                                          (MONTH, none_c, F.col("month_start")))])
    rows = pre.select("import_id", "n", F.col("s").cast(AMOUNT_T).alias("s"),
                      F.lit(0 if imports is not None else 1).alias("listed"), F.inline(levels))
    if imports is not None:
        # a known import is a total of nothing, so one pass over the facts is enough;
        # it has no category or month, and named twice it is still one
        rows = rows.unionByName(imports.select(
            "import_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast(AMOUNT_T).alias("s"), F.lit(1).alias("listed"),
            F.lit(TOTAL).alias("aggregation_type"), none_c.alias("level_category"), none_m.alias("level_month")))
    g = rows.groupBy(
        "import_id", "aggregation_type", F.col("level_category").alias("category"),
        F.col("level_month").alias("month_start")).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("listed").alias("listed"))
    g = g.filter(F.when(F.col("aggregation_type") == TOTAL, F.col("listed") == 1).otherwise(F.col("n") > 0))
    return g.select(
        # The label is trimmed after grouping (" a" and "a" stay two groups)
        "import_id", "aggregation_type", java_trim(F.col("category")).alias("category"),
        month_label(F.col("month_start")).alias("month"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("transaction_count"),
        F.coalesce(F.col("s"), F.lit(0)).cast(AMOUNT_T).alias("total_amount"))


def import_analytics_sql(facts: DataFrame, imports: DataFrame) -> DataFrame:
    """The same result with Spark SQL GROUPING SETS over the pre-aggregate,
    plus the ledger-driven TOTAL (kept as the documented SQL form)."""
    spark = facts.sparkSession
    _pre_aggregate(facts).createOrReplaceTempView("_ll_pre")
    imports.select("import_id").distinct().createOrReplaceTempView("_ll_imports")
    return spark.sql(f"""
        WITH g AS (
          SELECT import_id,
                 CASE WHEN grouping(category) = 0 THEN '{CATEGORY}' ELSE '{MONTH}' END AS aggregation_type,
                 category, date_format(month_start, 'yyyy-MM') AS month,
                 CAST(sum(n) AS BIGINT) AS transaction_count,
                 CAST(sum(s) AS {AMOUNT_T}) AS total_amount
          FROM _ll_pre
          GROUP BY GROUPING SETS ((import_id, category), (import_id, month_start)))
        SELECT i.import_id, '{TOTAL}' AS aggregation_type, CAST(NULL AS STRING) AS category,
               CAST(NULL AS STRING) AS month,
               CAST(coalesce(sum(p.n), 0) AS BIGINT) AS transaction_count,
               CAST(coalesce(sum(p.s), 0) AS {AMOUNT_T}) AS total_amount
        FROM _ll_imports i LEFT JOIN _ll_pre p ON p.import_id = i.import_id
        GROUP BY i.import_id
        UNION ALL SELECT * FROM g""")


def rollup_check(analytics: DataFrame) -> DataFrame:
    """A5: Σ category = Σ month = total (count and amount), every group >= 1."""
    a = analytics
    agg = a.groupBy("import_id").agg(
        F.sum(F.when(F.col("aggregation_type") == TOTAL, F.col("transaction_count"))).alias("total_count"),
        F.sum(F.when(F.col("aggregation_type") == TOTAL, F.col("total_amount"))).alias("total_amount"),
        F.coalesce(F.sum(F.when(F.col("aggregation_type") == CATEGORY, F.col("transaction_count"))), F.lit(0)).alias("category_count"),
        F.coalesce(F.sum(F.when(F.col("aggregation_type") == CATEGORY, F.col("total_amount"))), F.lit(0)).alias("category_amount"),
        F.coalesce(F.sum(F.when(F.col("aggregation_type") == MONTH, F.col("transaction_count"))), F.lit(0)).alias("month_count"),
        F.coalesce(F.sum(F.when(F.col("aggregation_type") == MONTH, F.col("total_amount"))), F.lit(0)).alias("month_amount"),
        F.count_if((F.col("aggregation_type") != TOTAL) & (F.col("transaction_count") < 1)).alias("empty_groups"),
        F.count_if(F.col("aggregation_type") == TOTAL).alias("total_rows"))
    ok = ((F.col("total_rows") == 1) & (F.col("category_count") == F.col("total_count"))
          & (F.col("month_count") == F.col("total_count"))
          & (F.col("category_amount") == F.col("total_amount"))
          & (F.col("month_amount") == F.col("total_amount")) & (F.col("empty_groups") == 0))
    return agg.select("import_id", F.col("total_count").cast("long").alias("total_count"),
                      F.col("total_amount").cast(AMOUNT_T).alias("total_amount"),
                      F.col("category_count").cast("long").alias("category_count"),
                      F.col("category_amount").cast(AMOUNT_T).alias("category_amount"),
                      F.col("month_count").cast("long").alias("month_count"),
                      F.col("month_amount").cast(AMOUNT_T).alias("month_amount"),
                      ok.alias("consistent"))


def category_share(analytics: DataFrame) -> DataFrame:
    """Count / max(count) * 100 within the import (0 when max is 0)."""
    c = analytics.filter(F.col("aggregation_type") == CATEGORY)
    w = Window.partitionBy("import_id")
    mx = F.max("transaction_count").over(w)
    return c.select("import_id", "category", "transaction_count",
                    F.when(mx == 0, F.lit(0.0)).otherwise(
                        F.col("transaction_count").cast("double") * 100.0 / mx.cast("double")).alias("share_of_max"))


def month_magnitude_share(analytics: DataFrame) -> DataFrame:
    """|sum| / max(|sum|) * 100 within the import, with a sign flag."""
    m = analytics.filter(F.col("aggregation_type") == MONTH)
    w = Window.partitionBy("import_id")
    mag = F.abs(F.col("total_amount").cast("double"))
    mx = F.max(mag).over(w)
    return m.select("import_id", "month", "total_amount",
                    F.when(mx == 0, F.lit(0.0)).otherwise(mag * 100.0 / mx).alias("magnitude_share"),
                    (F.col("total_amount") < 0).alias("negative"))


def canonical_order(analytics: DataFrame) -> DataFrame:
    """TOTAL first, then categories by string, then months ascending, each
    row with its ``position`` in its import."""
    t = F.when(F.col("aggregation_type") == TOTAL, 0).when(F.col("aggregation_type") == CATEGORY, 1).otherwise(2)
    w = Window.partitionBy("import_id").orderBy(t, "category", "month")
    return analytics.withColumn("position", F.row_number().over(w)).orderBy("import_id", "position")
