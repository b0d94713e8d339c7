"""Document keys, page numbers and numbers that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doc_number(c: Column) -> Column:
    """Leading digits of the base name, without leading zeros; null where there are none."""
    base = F.substring_index(F.substring_index(c, "/", -1), "\\", -1)
    return F.regexp_extract(base, r"^\s*0*([0-9]+)", 1).try_cast("bigint")


def number(c: Column) -> Column:
    """A finite number from text with blanks, exponents or a decimal comma; else null."""
    n = F.translate(F.trim(c.cast("string")), ",", ".").try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)  # NaN is above every number


def whole_number(c: Column) -> Column:
    """A whole number from text such as ' 2' or '2.0'; null for anything else."""
    return F.regexp_extract(c.cast("string"), r"^\s*(-?[0-9]+)(?:[.,]0*)?\s*$", 1).try_cast("int")


def tag(c: Column) -> Column:
    """Trimmed lower case; null for null and blank."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def upper_tag(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def positive_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x, y, w, h) with positive sizes: a negative size lies on the other side of x or y."""
    return F.struct(
        F.round(F.when(w < 0, x + w).otherwise(x), 4).alias("x"),
        F.round(F.when(h < 0, y + h).otherwise(y), 4).alias("y"),
        F.round(F.abs(w), 4).alias("w"),
        F.round(F.abs(h), 4).alias("h"),
    )
