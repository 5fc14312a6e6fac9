"""`OffsetDateTime.parse` (ISO_OFFSET_DATE_TIME) as Spark expressions.

Spark's casts are both too lax (space separator, missing offset) and too
strict (no `HH:mm` form, no nanoseconds), so the grammar is checked with one
regex, calendar validity with `try_to_timestamp`, and the fraction is added
as microseconds rounded half-up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the accepted lexical grammar.
DATETIME_RE = (r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(?::\d{2}(?:[.]\d{0,9})?)?"
               r"(?:Z|z|[+-]\d{2}(?::\d{2}(?::\d{2})?)?)\z")
OFFSET_VALID_RE = (r"^(?:[Zz]|[+-](?:(?:0\d|1[0-7])(?::[0-5]\d(?::[0-5]\d)?)?"
                   r"|18(?::00(?::00)?)?))\z")
OFFSET_EXTRACT_RE = r"([Zz]|[+-][0-9:]+)\z"
# Every spelling of a zero offset the grammar admits.
UTC_OFFSETS = ["Z", "z", "+00", "-00", "+00:00", "-00:00", "+00:00:00", "-00:00:00"]


CANONICAL_MASK = "0000-00-00T00:00:00Z"
LAST_MICROS = 253402300799999999  # 9999-12-31T23:59:59.999999Z


def datetime_stages(src: str, p: str) -> list[dict[str, Column]]:
    """``valid`` (parses), ``utc`` (offset is zero) and ``ts`` (the instant, only
    meaningful when valid and utc) as stacked projections (prefix ``p``).

    Fast path for the canonical ``yyyy-MM-ddTHH:mm:ssZ`` (checked with a
    digit mask, no regex): a plain cast parses it (and rejects impossible
    dates and times). Every other spelling takes the grammar regex,
    ``try_to_timestamp`` and the fraction/offset handling."""
    c = F.col(src)
    col = lambda n: F.col(p + n)
    canon = F.coalesce(F.translate(c, "123456789", "000000000") == F.lit(CANONICAL_MASK), F.lit(False))
    s0 = {p + "canon": canon}
    fast_ts = F.concat(F.substring(c, 1, 10), F.lit(" "), F.substring(c, 12, 8)).try_cast("timestamp")
    s1 = {p + "shape": F.when(col("canon"), F.lit(True)).otherwise(F.coalesce(c.rlike(DATETIME_RE), F.lit(False))),
          p + "off": F.when(col("canon"), F.lit("Z")).otherwise(F.regexp_extract(c, OFFSET_EXTRACT_RE, 1)),
          p + "rest": F.substring(c, F.lit(17), F.length(c)),
          p + "fast": F.when(col("canon"), fast_ts)}
    sec = F.when(F.startswith(col("rest"), F.lit(":")), F.substring(col("rest"), 2, 2)).otherwise(F.lit("00"))
    local = F.concat(F.substring(c, 1, 10), F.lit(" "), F.substring(c, 12, 5), F.lit(":"), sec)
    s2 = {p + "base": F.when(col("canon"), col("fast")).when(
              col("shape"), F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm:ss"))),
          p + "utc": col("off").isin(*UTC_OFFSETS),
          p + "frac": F.when(F.substring(col("rest"), 4, 1) == F.lit("."),
                             F.substring(col("rest"), F.lit(5), F.length(col("rest")) - F.length(col("off")) - 4))
          .otherwise(F.lit(""))}
    nanos = F.when(F.length(col("frac")) > 0, F.rpad(col("frac"), 9, "0").cast("long")).otherwise(F.lit(0))
    micros = F.floor((nanos + F.lit(500)) / F.lit(1000))
    s3 = {p + "valid": (col("shape") & (F.substring(c, 1, 4) != F.lit("0000")) & col("base").isNotNull()
                        & (F.unix_micros(col("base")) + micros <= F.lit(LAST_MICROS))  # also after rounding
                        & (col("utc") | col("off").rlike(OFFSET_VALID_RE))),
          p + "ts": F.timestamp_micros(F.unix_micros(col("base")) + micros)}
    return [s0, s1, s2, s3]
