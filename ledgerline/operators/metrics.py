"""Run metrics: discrete percentile (A10), latency summary (A11), peak per
group (A12).

Percentiles are exact, and no task holds a group. One pass sketches all groups
and all wanted ranks (`percentile_approx`); a second one counts the values below
each rank's bracket and the distinct values inside it (about ``4 / SKETCH`` of a
group). While a bracket still has more than ``FINAL_VALUES`` of them, histograms
of the stored counts narrow it to the bucket that holds the rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import scratch_dir

#: Accuracy of the bracket: ranks are off by at most 1 / SKETCH of a group.
SKETCH = 10_000
#: Values of one bracket that are put in order in one task.
FINAL_VALUES = 100_000
BUCKETS = 4096


def _same(keys: list[str], others: list[str]):
    same = F.lit(True)
    for k, x in zip(keys, others):
        same = same & F.col(k).eqNullSafe(F.col(x))
    return same


def _stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = scratch_dir(spark, "ranks")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _narrow(counted: DataFrame, keys: list[str], rank) -> DataFrame:
    """Of every bracket the bucket with the wanted ranks, and as one row
    without a value the number of values below it."""
    inside = counted.filter("_x is not null")
    edges = inside.groupBy(*keys, "_k").agg(F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    names = [f"_e{i}" for i in range(len(keys) + 1)]
    edges = edges.select(*[F.col(k).alias(n) for k, n in zip([*keys, "_k"], names)], "_min", "_max")
    d = lambda c: F.unix_micros(c) if dict(counted.dtypes)["_x"].startswith("timestamp") else F.col(c)
    at = (d("_x").cast("double") - d("_min").cast("double")) / (d("_max").cast("double") - d("_min").cast("double"))
    bucket = F.when(F.col("_x").isNull(), -1).when(F.col("_min") == F.col("_max"), 0).otherwise(
        F.least(F.floor(at * BUCKETS), F.lit(BUCKETS - 1)))
    placed = counted.join(edges, _same([*keys, "_k"], names), "left").withColumn("_b", bucket).drop("_min", "_max", *names)
    per = placed.groupBy(*keys, "_k", "_n", "_b").agg(F.sum("_c").alias("_c"))
    upto = Window.partitionBy(*keys, "_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # at most BUCKETS + 1 rows
    first, last = rank
    per = per.withColumn("_to", F.sum("_c").over(upto))
    keep = (F.col("_to") >= first) & (F.col("_to") - F.col("_c") < last) & (F.col("_b") >= 0)
    bound = per.groupBy(*keys, "_k").agg(F.min(F.when(keep, F.col("_b"))).alias("_lo"), F.max(F.when(keep, F.col("_b"))).alias("_hi"))
    bound = bound.select(*[F.col(k).alias(n) for k, n in zip([*keys, "_k"], names)], "_lo", "_hi")
    # a rank that the row of lower values holds keeps that row alone
    near = placed.join(bound, _same([*keys, "_k"], names)).filter(F.coalesce(F.col("_b") <= F.col("_hi"), F.col("_b") < 0))
    low = F.col("_b") < F.coalesce("_lo", F.lit(0))
    return near.groupBy(*keys, "_k", "_n", F.when(~low, F.col("_x")).alias("_x")).agg(F.sum("_c").alias("_c"))


def _values_at(df: DataFrame, group: list[str], value: str, wants: list[tuple[str, float, bool]]) -> DataFrame:
    """One row per group: its size ``_n``, ``_least`` and ``_most`` value and,
    for every (name, q, interpolated), the value at nearest rank q or the linear
    interpolation at (n - 1) q. Null values are left out."""
    keys = [f"_g{i}" for i in range(len(group))]
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(value).alias("_v"))
    e = 2.0 / SKETCH
    marks = [x for _, q, _ in wants for x in (max(0.0, q - e), min(1.0, q + e))]
    bracket = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(*map(F.lit, marks)), F.lit(SKETCH)).alias("_m"), F.count("_v").alias("_n"),
        F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    bracket = _stored(bracket)
    bkeys = [f"_b{i}" for i in range(len(keys))]
    b = bracket.select(*[F.col(k).alias(x) for k, x in zip(keys, bkeys)], "_m", "_n")
    rows = rows.filter("_v is not null")
    joined = rows.join(b, _same(keys, bkeys)) if keys else rows.crossJoin(F.broadcast(b))  # without keys: one row
    # for each rank a value counts as itself inside the bracket, as null below it, not at all above
    per = F.array(*[F.when(F.col("_v") <= F.col("_m")[2 * k + 1], F.struct(
        F.lit(k).alias("_k"), F.when(F.col("_v") >= F.col("_m")[2 * k], F.col("_v")).alias("_x"))) for k in range(len(wants))])
    counted = _stored(joined.select(*keys, "_n", F.inline(F.array_compact(per))).groupBy(*keys, "_k", "_n", "_x").agg(
        F.count("*").alias("_c")))
    qs = F.array(*[F.lit(float(q)) for _, q, _ in wants])[F.col("_k")]
    line = F.array(*[F.lit(i) for _, _, i in wants])[F.col("_k")]
    at = (F.col("_n") - 1) * qs
    nearest = F.greatest(F.ceil(F.col("_n") * qs), F.lit(1))
    rank = (F.when(line, F.floor(at) + 1).otherwise(nearest), F.when(line, F.ceil(at) + 1).otherwise(nearest))
    size = None
    while True:
        most = counted.filter("_x is not null").groupBy(*keys, "_k").count().agg(F.max("count")).first()[0] or 0
        if most <= FINAL_VALUES or most == size:
            break
        size, counted = most, _stored(_narrow(counted, keys, rank))
    # rows below the bracket are one row whose value is null: first in order
    upto = Window.partitionBy(*keys, "_k").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_to", F.sum("_c").over(upto))
    got = ranked.groupBy(*keys, "_k").agg(
        F.min(F.when(F.col("_to") >= rank[0], F.col("_x"))).alias("_a"),
        F.min(F.when(F.col("_to") >= rank[1], F.col("_x"))).alias("_z"), F.first(at - F.floor(at)).alias("_p"))
    pick = lambda k, name, i: F.max(F.when(F.col("_k") == k, (
        F.when(F.col("_z").isNull() | (F.col("_p") == 0), F.col("_a")).otherwise(
            F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_p")) if i else F.col("_a")))).alias(name)
    wide = got.groupBy(*keys).agg(*[pick(k, name, i) for k, (name, _, i) in enumerate(wants)])
    b = bracket.select(*[F.col(k).alias(x) for k, x in zip(keys, bkeys)], "_n", "_least", "_most")
    out = b.join(wide, _same(keys, bkeys), "left") if keys else b.crossJoin(F.broadcast(wide))
    return out.select(*[F.col(k).alias(g) for k, g in zip(bkeys, group)], "_n", "_least", "_most", *[w[0] for w in wants])


def percentile_disc(df: DataFrame, group: list[str], value: str, q: float, name: str) -> DataFrame:
    """A10: nearest-rank percentile (smallest x with cume_dist >= q)."""
    return _values_at(df, group, value, [(name, q, False)]).select(*group, name)


def latency_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """N, min, median (interpolated), p95 (nearest rank), max; rounded 3."""
    rounded = lambda c, n: F.round(F.col(c).cast("double"), 3).alias(n)
    found = _values_at(df, group, value, [("p50_ms", 0.5, True), ("p95_ms", 0.95, False)])
    return found.select(*group, F.col("_n").alias("samples"), rounded("_least", "min_ms"), rounded("p50_ms", "p50_ms"),
                        rounded("p95_ms", "p95_ms"), rounded("_most", "max_ms"))


def peak_by_group(df: DataFrame, group: list[str], value: str, name: str = "peak") -> DataFrame:
    """Maximum sampled value per group."""
    return df.groupBy(*group).agg(F.max(value).alias(name))
