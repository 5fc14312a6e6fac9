"""CSV record grammar (RFC-4180 style with `"` quote and `""` escape) as
Spark regex expressions.

A quote opens a quoted field only at field start; after the closing quote
only whitespace may follow before the separator. Possessive quantifiers keep
the regexes linear (no backtracking) on long records.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the field grammar.
_WS = r"\p{javaWhitespace}"
# the text of a quoted field: one turn of the loop per escaped quote
_BODY = r'[^"]*+(?:""[^"]*+)*+'
QUOTED = '"' + _BODY + '"' + _WS + "*+"
UNQUOTED = r'[^",][^,]*+'
# An empty field exists only before a separator or at the end of the line
# (a field that starts with a quote is a quoted field); stating it keeps the
# possessive loops from taking a separator that precedes an open quote.
FIELD = "(?:" + QUOTED + "|" + UNQUOTED + "|(?=,|\\z))"
# A complete record starting outside quotes.
RECORD_RE = "^" + FIELD + "(?:," + FIELD + ")*+\\z"
# Starting outside quotes, the line ends inside an open quoted field.
OPEN_TAIL_RE = "^(?:" + FIELD + ",)*+" + '"' + _BODY + r"\z"
# Starting inside a quoted field: still inside at the end of the line.
INSIDE_ALL_RE = "^" + _BODY + r"\z"
# Starting inside: closes the field, then the rest is a complete record tail.
INSIDE_CLOSE_RE = "^" + _BODY + '"' + _WS + "*+(?:," + FIELD + ")*+\\z"
# Starting inside: closes, then later opens another field left open.
INSIDE_REOPEN_RE = ("^" + _BODY + '"' + _WS + "*+(?:," + FIELD + ")*+,"
                    + '"' + _BODY + r"\z")
SPLIT_RE = ",(" + QUOTED + "|" + UNQUOTED + "|)"

# Line transfer codes: state after the line, given the state before it.
OUT, IN, ERR = 0, 1, 2


def is_complete_record(line: Column) -> Column:
    return line.rlike(RECORD_RE)


def end_state_from_outside(line: Column) -> Column:
    return (F.when(line.rlike(RECORD_RE), F.lit(OUT))
            .when(line.rlike(OPEN_TAIL_RE), F.lit(IN))
            .otherwise(F.lit(ERR)))


def end_state_from_inside(line: Column) -> Column:
    return (F.when(line.rlike(INSIDE_ALL_RE), F.lit(IN))
            .when(line.rlike(INSIDE_CLOSE_RE), F.lit(OUT))
            .when(line.rlike(INSIDE_REOPEN_RE), F.lit(IN))
            .otherwise(F.lit(ERR)))


def raw_fields(record: Column) -> Column:
    """Raw (still quoted) fields of a syntactically valid record. A blank
    record has one empty field. Scalar and codegen-friendly."""
    return F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(SPLIT_RE), 1)


def unquote(x: Column) -> Column:
    """Decode one raw field: strip the enclosing quotes (and blanks after
    the closing quote) and turn `""` into `"`.

    The field is valid, so its last quote is the closing one: positions are
    enough, whatever its length (a regex would recurse per character). Without
    blanks after it the quotes are the first and the last byte, and no
    character is counted."""
    quote = F.lit('"')
    bare = F.substring(x.cast("binary"), F.lit(2), F.octet_length(x) - 2).cast("string")
    inner = F.when(F.endswith(x, quote), bare).otherwise(
        F.substring(x, F.lit(2), F.length(x) - F.instr(F.reverse(x), '"') - 1))
    return F.when(F.startswith(x, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(x)


def split_fields(record: Column) -> Column:
    """Decoded field values of a syntactically valid record (array<string>)."""
    return F.transform(raw_fields(record), unquote)
