"""Row validation ladder (V1–V11), accept/reject split (P1) and typed
projection (P2).

The ladder is one CASE WHEN chain — ordered, first failing rule wins — so it
runs inside whole-stage codegen with no Python on the row path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import contract as C
from ledgerline.functions.csvfields import unquote
from ledgerline.functions.decimals import bigdecimal_stages
from ledgerline.functions.text import is_blank, utf16_longer_than
from ledgerline.functions.timestamps import datetime_stages


def _field(fields: Column, i: int) -> Column:
    return F.get(fields, i)  # null when out of bounds (ANSI-safe)


def reason_for(code: Column) -> Column:
    """Fixed reason text per code (a literal map lookup, JVM-side)."""
    pairs = []
    for k, v in C.ERROR_REASONS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), code)


def classify(df: DataFrame, fields_col: str = "fields", quoted: bool = False) -> DataFrame:
    """Add ``error_code`` and ``reason`` (null when accepted) and the typed
    columns. One pass; callers split with :func:`accepted` / :func:`rejected`.

    Parsed parts are materialised in stacked projections (regex results are
    not cheap, so Catalyst keeps each computed once per row instead of
    inlining them into every CASE branch)."""
    f = F.col(fields_col)
    dec = unquote if quoted else (lambda x: x)  # raw fields: decode only the four that are read
    base = df.select("*", F.size(f).alias("_nf"), *[dec(F.get(f, i)).alias(n) for i, n in
                                                      enumerate(("_tid", "_occ", "_amt", "_cat"))])
    parsed = base
    ts_st, dc_st = datetime_stages("_occ", "_ts_"), bigdecimal_stages("_amt", "_dc_")
    for i in range(max(len(ts_st), len(dc_st))):
        level = {**(ts_st[i] if i < len(ts_st) else {}), **(dc_st[i] if i < len(dc_st) else {})}
        parsed = parsed.select("*", *[v.alias(k) for k, v in level.items()])
    code = (F.when(F.col("_nf") != 4, F.lit(C.COLUMN_COUNT))
            .when(is_blank(F.col("_tid")), F.lit(C.TRANSACTION_ID_REQUIRED))
            .when(utf16_longer_than(F.col("_tid"), C.TRANSACTION_ID_MAX), F.lit(C.TRANSACTION_ID_TOO_LONG))
            .when(~F.col("_ts_valid"), F.lit(C.OCCURRED_AT_INVALID))
            .when(~F.col("_ts_utc"), F.lit(C.OCCURRED_AT_NOT_UTC))
            .when(~F.col("_dc_valid"), F.lit(C.AMOUNT_INVALID))
            .when(F.col("_dc_scale") != C.AMOUNT_SCALE, F.lit(C.AMOUNT_SCALE_INVALID))
            .when(F.col("_dc_precision") > C.AMOUNT_PRECISION, F.lit(C.AMOUNT_PRECISION_INVALID))
            .when(F.col("_dc_zero"), F.lit(C.AMOUNT_ZERO))
            .when(is_blank(F.col("_cat")), F.lit(C.CATEGORY_REQUIRED))
            .when(utf16_longer_than(F.col("_cat"), C.CATEGORY_MAX), F.lit(C.CATEGORY_TOO_LONG)))
    # the partition id is never negative; naming it keeps filters on the result
    # above this projection (pushed through the stack, each alias would be
    # substituted and the condition grow exponentially)
    coded = parsed.withColumn("error_code", F.when(F.spark_partition_id() >= 0, code))
    ok = F.col("error_code").isNull()
    out = coded.select(
        *[c for c in df.columns if c not in ("error_code", "reason", "transaction_id", "occurred_at",
                                             "amount", "category")],
        "error_code", reason_for(F.col("error_code")).alias("reason"),
        F.when(ok, F.col("_tid")).alias("transaction_id"),
        F.when(ok, F.col("_ts_ts")).alias("occurred_at"),
        F.when(ok, F.col("_dc_value")).alias("amount"),
        F.when(ok, F.col("_cat")).alias("category"))
    return out


def accepted(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted side, typed projection."""
    return (classified.filter(F.col("error_code").isNull())
            .select(*keys, "transaction_id", "occurred_at", "amount", "category"))


def rejected(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Rejected side with code and reason (reason derived from the code
    when the input does not carry it)."""
    reason = F.col("reason") if "reason" in classified.columns else reason_for(F.col("error_code"))
    return (classified.filter(F.col("error_code").isNotNull())
            .select(*keys, "error_code", reason.alias("reason")))
