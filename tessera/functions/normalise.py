"""Cell normalisation for result comparison (``grd_normalise_value``).

Rules, by the column's Spark type:
  NULL        stays NULL (null-safe: it is *not* equal to the text 'None');
  boolean     'True' / 'False' (so it is not equal to the integer 1);
  number      rounded to 6 places; an integral value prints as an integer,
              otherwise trailing zeros are dropped. Below 1e15 doubles go
              through DECIMAL(38,6) text, which Spark and DuckDB print the
              same way; from 1e15 (where a double has at most 3 fractional
              bits) to the BIGINT limit the rounded integer is printed; beyond
              that the double's own text is used (engine-specific: Spark
              prints ``1.0E20``);
  other       text with surrounding whitespace removed (all ASCII whitespace,
              not only spaces).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}|{WS}$", "")


def _decimal_text(c: Column) -> Column:
    """A decimal as a decimal: rounded to 6 places, trailing zeros dropped."""
    text = F.round(c, 6).cast("string")
    plain = F.when(text.contains("E"), F.round(c, 6).cast("decimal(38,6)").cast("string")).otherwise(text)
    return F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")).otherwise(plain)


def _number_text(c: Column) -> Column:
    x = c.cast("double")
    dec = F.when(F.abs(x) < F.lit(1e15), F.round(x, 6)).cast("decimal(38,6)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(dec, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return (F.when(x.isNull(), F.lit(None))
            .when(F.abs(x) < F.lit(1e15), trimmed)
            .when(F.abs(x) < F.lit(9.2e18), F.round(x).cast("long").cast("string"))
            .otherwise(x.cast("string")))


def normalise(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("string")
    if isinstance(dtype, T.DecimalType):
        return _decimal_text(c)
    if isinstance(dtype, _NUMERIC):
        return _number_text(c)
    return strip_ws(c.cast("string"))


def normalise_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """One ``array<string>`` per row, cells normalised, in *column position* order
    (names are ignored; NULL cells stay NULL inside the array)."""
    cells = [normalise(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.select(F.array(*cells).alias(name))


def row_key(row: Column) -> Column:
    """An injective text of a row: every cell carries its length, NULL its own mark."""
    return F.array_join(F.transform(row, lambda x: F.when(x.isNull(), F.lit("-")).otherwise(
        F.concat(F.length(x).cast("string"), F.lit(":"), x))), "")


def row_text(row: Column) -> Column:
    """A printable, null-safe text of a normalised row."""
    return F.array_join(F.transform(row, lambda x: F.coalesce(x, F.lit("<NULL>"))), " | ")
