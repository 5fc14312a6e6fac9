"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]: weights at
evenly spaced knots, linear in between. Its integral, scaled to the source's
target, is the source's cumulative token demand D(t). A document that covers
the tokens [c, c + n) of its source's stream is trained at the t where
D(t) = c + n / 2: the schedule is inverted in closed form on the segment that
holds c. Documents are range-sorted by position.

Targets: sources by code point, null last, take ``weights`` in turn and share
``share`` times all sizes; a target stops at ``max_epochs`` times its source's
size and the excess is shared again by weight until none is above.

A source's stream repeats its documents in the order of a hash of id and text.
Running totals are built in two levels (hash bucket, then inside a bucket), so
that a source with a third of all rows is spread over ``buckets`` groups. A pass
takes a whole document if the document's middle lies before the end of the
stream, else nothing of it, so each source's words are within half a document
of its target.

DataFrame functions only: no Python code runs on rows.

Defined results: null and empty texts have size 0, take nothing and have no
position; null sources are one source, last; ties in the hash go by id, then
row; repeated rows are documents of their own; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD_RE, cut, fresh, keep_one, sized, staged, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
#: Weight schedules, taken in turn like the weights: early, even, late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Rows that a group of the running totals holds on average.
BUCKET_ROWS = 4096


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources``: source, source_size. Adds nr (from 0), target. A fill level
    x solves sum(min(cap, weight * x)) = wanted: caps in order of cap / weight,
    running sums, and the first source that is not full. One row a source; the
    windows without keys see that table only."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nr") % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    s = sources.withColumn("nr", F.row_number().over(order) - 1).withColumn("w", w)
    every = Window.partitionBy()
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("wanted", F.least(F.sum("source_size").over(every) * F.lit(float(share)), F.sum("cap").over(every)))
    up = Window.orderBy(F.col("cap") / F.col("w"), "nr")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # if this and all later sources stay below their caps, the level is this
    s = s.withColumn("level", (F.col("wanted") - F.col("cap_before")) / F.col("w_left"))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    s = s.withColumn("x", F.min(F.when(fits, F.struct("cap_before", "nr", "level"))).over(every)["level"])
    full = F.col("x").isNull()
    return s.withColumn("target", F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("x") * F.col("w")))).select(
        "source", "source_size", "nr", "w", "target")


def invert_schedule(fraction: Column, knots: Column) -> Column:
    """t in [0, 1] at which the integral of the piecewise linear weights
    ``knots`` (array, evenly spaced in time) reaches ``fraction`` of its
    total. On a segment of width h from a to b the demand is
    a*u + (b - a)/(2h) * u*u, whose root is taken in the stable form."""
    n = F.size(knots) - 1
    h = F.lit(1.0) / n
    areas = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (knots[i] + knots[i + 1]) * h / 2)
    total = F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)
    want = F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * total
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("t"))

    def step(acc, area):
        i, left = acc["i"], want - acc["done"]
        a, b = knots[i], knots[i + 1]
        disc = F.greatest(a * a + 2 * (b - a) / h * left, F.lit(0.0))
        u = F.when(left <= 0, F.lit(0.0)).otherwise(2 * left / (a + F.sqrt(disc)))
        here = acc["t"].isNull() & ((left <= area) | (i == n - 1))
        return F.struct((i + 1).alias("i"), (acc["done"] + area).alias("done"),
                        F.when(here, i * h + F.least(u, h)).otherwise(acc["t"]).alias("t"))

    return F.aggregate(areas, zero, step)["t"]


def order_key(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> Column:
    """60 bits of an MD5 over id, source and text: the order within a source."""
    parts = [F.coalesce(docs[c].cast("string"), F.lit("")) for c in (id_col, source_col, text_col)]
    return F.conv(F.substring(F.md5(F.concat_ws("\n", *parts)), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
        schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """One row per row of ``docs``: id, key (order in the source), size,
    source, source_size, target, taken, takes (words taken by each pass over
    the source) and positions (training time of each pass), both arrays."""
    t = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"),
                       F.regexp_count(t, F.lit(WORD_RE)).cast("long").alias("size"),
                       order_key(docs, id_col, text_col, source_col).alias("key"))
    rows = staged(rows, "mix-rows")
    by_source = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    goal = cut(targets(by_source.select("source", "source_size"), weights, share, max_epochs))
    # two-level running totals: a source of n rows has n / BUCKET_ROWS buckets of its hash range
    parts = by_source.select(F.col("source").alias("p_source"),
                             F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("long").alias("parts"))
    keyed = rows.join(sized(cut(parts)), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    # bucket b holds the keys of one part of the hash range, in hash order
    unit = F.shiftright("key", 29).cast("double") / F.lit(float(1 << 31))
    keyed = keyed.withColumn("bucket", F.floor(unit * F.col("parts")))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(sums.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).select(
        F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "base"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sized(base), placed["source"].eqNullSafe(F.col("b_source")) & (placed["bucket"] == F.col("b_bucket")))
    placed = placed.withColumn("start", F.col("base") + F.col("local"))
    g = sized(goal).select(F.col("source").alias("g_source"), "source_size", "nr", "target")
    placed = placed.join(g, placed["source"].eqNullSafe(F.col("g_source")))
    wanted = F.round("target").cast("long")
    passes = F.sequence(F.lit(0), F.lit(int(-(-max_epochs // 1)) - 1))
    # pass k covers stream tokens [k * source_size + start, ... + size); the stream ends at the target
    left = lambda k: wanted - k.cast("long") * F.col("source_size") - F.col("start")
    takes = F.transform(passes, lambda k: F.when(F.col("size") < 2 * left(k), F.col("size")).otherwise(F.lit(0)))
    placed = placed.withColumn("takes", F.filter(takes, lambda x: x > 0))
    curve = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in schedules]),
                         (F.col("nr") % len(schedules) + 1).cast("int"))
    placed = placed.withColumn("curve", curve)
    middle = F.transform(F.col("takes"), lambda x, k: (
        k.cast("double") * F.col("source_size") + F.col("start") + x / 2) / F.greatest(wanted, F.lit(1)))
    placed = placed.withColumn("middle", middle)
    placed = placed.withColumn("positions", F.transform("middle", lambda m: invert_schedule(m, F.col("curve"))))
    return placed.select("id", "key", "size", "source", "source_size", "target",
                         F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"),
                         "takes", "positions")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """The training order: a row of ``docs``, with its whole text, for every
    time it is taken, range-sorted by position."""
    row, take, pos = fresh(docs, "row_key"), fresh(docs, "take"), fresh(docs, "position")
    plan = mix(docs, id_col, text_col, source_col).filter("taken > 0")
    # repeated rows are one document that is taken as often as all of them
    plan = staged(plan.groupBy(F.col("id").alias("m_id"), F.col("key").alias("m_key")).agg(
        F.flatten(F.collect_list(F.arrays_zip("takes", "positions"))).alias("m_takes"),
        F.count("*").alias("m_rows")), "mix-plan")
    keyed = docs.withColumn(row, order_key(docs, id_col, text_col, source_col))
    twice = cut(plan.filter("m_rows > 1").select(F.col("m_id").alias("t_id"), F.col("m_key").alias("t_key")))
    keyed = keep_one(keyed, twice, {id_col: "t_id", row: "t_key"})
    met = keyed[id_col].eqNullSafe(F.col("m_id")) & (keyed[row] == F.col("m_key"))
    each = keyed.join(plan, met).withColumn(take, F.explode("m_takes"))
    each = each.withColumn(pos, F.col(take)["positions"])
    return each.select(*docs.columns, pos).orderBy(pos, id_col).select(*docs.columns)


def op6_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken",
                        F.round(F.get("positions", F.lit(0)), 9).alias("first_position")).orderBy(
        F.col("first_position").asc_nulls_last(), "doc_id")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(source, '') || chr(10)
                             || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS nr
  FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][nr % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
c AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS wanted,
         coalesce(sum(cap) OVER before, 0.0::DOUBLE) AS cap_before,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0.0::DOUBLE) AS w_left
  FROM w WINDOW before AS (ORDER BY cap / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (wanted - cap_before) / w_left AS level FROM c),
x AS (SELECT arg_min(level, cap_before) AS x FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, nr, CASE WHEN x IS NULL THEN cap ELSE least(cap, x * w) END AS target FROM l, x),
p AS (
  SELECT d.*, t.source_size, t.nr, t.target, round(t.target)::BIGINT AS wanted,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, CASE WHEN size < 2 * (wanted - start) THEN size ELSE 0 END AS t0,
         CASE WHEN size < 2 * (wanted - source_size - start) THEN size ELSE 0 END AS t1
  FROM p),
f AS (
  SELECT *, [[1.5, 1.0, 0.5], [1.0, 1.0, 1.0], [0.5, 1.0, 1.5]][nr % 3 + 1]::DOUBLE[] AS q,
         (start + t0 / 2.0::DOUBLE) / greatest(wanted, 1) AS middle
  FROM k),
a AS (SELECT *, (q[1] + q[2]) / 4 AS a0, (q[2] + q[3]) / 4 AS a1 FROM f),
b AS (
  SELECT *, middle * (a0 + a1) AS want, CASE WHEN middle * (a0 + a1) <= a0 THEN 0 ELSE 1 END AS seg FROM a),
u AS (
  SELECT *, want - CASE WHEN seg = 0 THEN 0 ELSE a0 END AS rest, q[seg + 1] AS qa, q[seg + 2] AS qb FROM b)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (t0 + t1)::BIGINT AS taken,
       CASE WHEN t0 > 0 THEN
         round(seg * 0.5::DOUBLE + least(0.5, 2 * rest / (qa + sqrt(greatest(qa * qa + 4 * (qb - qa) * rest, 0)))), 9)
       END AS first_position
FROM u
"""
