"""Query text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The longest query kept, in code points, and the Unicode White_Space characters.
MAX_QUERY_LEN = 256
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_ASCII_SPACE = r"[ \t\n\r\x0B\f]"
# Whatever a collapse would change: a run of white space, or a single one that is no plain blank.
_UNEVEN_SPACE = r"\p{IsWhite_Space}{2,}+|[\p{IsWhite_Space}&&[^ ]]"


def trim_white_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def lower_per_code_point(text: Column) -> Column:
    """Lowercase each code point alone: no final-sigma rule, dotted capital I becomes a plain i."""
    plain = F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3"))
    return F.lower(plain)


def collapse_white_space(text: Column) -> Column:
    """Turn each white space run into one blank, but only in texts that hold an ASCII white space."""
    uneven = text.rlike(_UNEVEN_SPACE) & text.rlike(_ASCII_SPACE)
    return F.when(uneven, F.regexp_replace(text, _UNEVEN_SPACE, " ")).otherwise(text)


def normalize_query(raw: Column) -> Column:
    """Normalised query, or NULL where the text is blank or longer than the limit."""
    return _within_limit(collapse_white_space(lower_per_code_point(trim_white_space(raw))))


def with_normalized(rows: DataFrame, raw: Column, name: str) -> DataFrame:
    """Add the normalised query as a column. Each step is a projection, so none is worked out twice."""
    return (
        rows.withColumn("_lowered", lower_per_code_point(trim_white_space(raw)))
        .withColumn("_collapsed", collapse_white_space(F.col("_lowered")))
        .withColumn(name, _within_limit(F.col("_collapsed")))
        .drop("_lowered", "_collapsed")
    )


def _within_limit(text: Column) -> Column:
    return F.when((text != "") & (F.char_length(text) <= MAX_QUERY_LEN), text)
