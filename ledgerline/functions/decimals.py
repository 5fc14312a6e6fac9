"""`new BigDecimal(String)` plus `scale()`, `precision()` and zero test.

Decided lexically: a cast to decimal(19,2) silently rescales `5.` or `1E2`
and trims blanks, which the contract rejects.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: `BigDecimal(String)` grammar (optional sign, digits with an
# optional point, optional exponent; no blanks, no grouping, no suffix).
AMOUNT_RE = r"^[+-]?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?\z"
INT_MAX = 2147483647
# Decimal digits of other scripts (general category Nd, basic plane) and the
# ASCII digits they stand for, from the Unicode database.
_OTHER_DIGITS = [ch for ch in map(chr, range(0x80, 0x10000)) if unicodedata.category(ch) == "Nd"]
_THEIR_VALUES = "".join(str(unicodedata.decimal(ch)) for ch in _OTHER_DIGITS)


def ascii_digits(c: Column) -> Column:
    """Decimal digits of any script as ASCII digits; other text unchanged."""
    return F.when(c.rlike(r"\p{Nd}") & c.rlike(r"[^\x00-\x7F]"),
                  F.translate(c, "".join(_OTHER_DIGITS), _THEIR_VALUES)).otherwise(c)


def bigdecimal_stages(src: str, p: str) -> list[dict[str, Column]]:
    """``valid``, ``scale``, ``precision``, ``zero`` and ``value`` (decimal(19,2);
    only meaningful when the row passes every check) as stacked projections of
    named columns (prefix ``p``), so that every part is computed once per row. One regex (the lexical check); the rest are plain string ops."""
    col = lambda n: F.col(p + n)
    s0 = {p + "txt": ascii_digits(F.col(src))}
    c = col("txt")
    s1 = {p + "lex": F.coalesce(c.rlike(AMOUNT_RE), F.lit(False)), p + "low": F.lower(c)}
    s2 = {p + "has_e": F.instr(col("low"), "e") > 0}
    s3 = {p + "mant": F.when(col("has_e"), F.substring_index(col("low"), "e", 1)).otherwise(col("low")),
          p + "exp_text": F.when(col("has_e"), F.substring_index(col("low"), "e", -1)).otherwise(F.lit(""))}
    s4 = {p + "sign": F.when(F.substring(col("mant"), 1, 1).isin("+", "-"), F.substring(col("mant"), 1, 1))
          .otherwise(F.lit("")),
          p + "exp_neg": F.startswith(col("exp_text"), F.lit("-")),
          p + "exp_digits": F.ltrim(F.regexp_replace(col("exp_text"), r"^[+-]", ""), F.lit("0"))}
    s5 = {p + "body": F.when(col("sign") != "", F.substring(col("mant"), F.lit(2), F.length(col("mant")))).otherwise(col("mant")),
          p + "exp_abs": F.when(F.length(col("exp_digits")) == 0, F.lit(0).cast("decimal(38,0)")).otherwise(
              F.when(F.length(col("exp_digits")) <= 30, col("exp_digits").try_cast("decimal(38,0)")))}
    s6 = {p + "int": F.substring_index(col("body"), ".", 1),
          p + "frac": F.when(F.instr(col("body"), ".") > 0, F.substring_index(col("body"), ".", -1))
          .otherwise(F.lit("")),
          p + "exponent": F.when(col("exp_neg"), -col("exp_abs")).otherwise(col("exp_abs"))}
    s7 = {p + "unscaled": F.ltrim(F.concat(col("int"), col("frac")), F.lit("0")),
          p + "scale_d": F.length(col("frac")).cast("decimal(38,0)") - col("exponent")}
    valid = (col("lex") & col("exp_abs").isNotNull() & (F.abs(col("exponent")) <= INT_MAX)
             & (F.abs(col("scale_d")) <= INT_MAX))
    padded = F.when(F.length(col("unscaled")) < 3, F.lpad(col("unscaled"), 3, "0")).otherwise(col("unscaled"))
    s8 = {p + "valid": valid, p + "padded": padded,
          p + "precision": F.greatest(F.length(col("unscaled")), F.lit(1)),
          p + "zero": F.length(col("unscaled")) == 0}
    n = F.length(col("padded"))
    text = F.concat(col("sign"), F.substring(col("padded"), F.lit(1), n - 2), F.lit("."),
                    F.substring(col("padded"), n - 1, F.lit(2)))
    s9 = {p + "scale": F.when(col("valid"), col("scale_d").cast("long")), p + "value": text.try_cast("decimal(19,2)")}
    return [s0, s1, s2, s3, s4, s5, s6, s7, s8, s9]
