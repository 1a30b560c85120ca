"""Message parsing and number formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_parenthesis(message: Column) -> Column:
    return F.instr(message, "(") > 0


def inside_parentheses(message: Column) -> Column:
    return F.regexp_extract(message, r"\(([^)]*)\)", 1)


def before_parenthesis(message: Column) -> Column:
    return F.substring_index(message, "(", 1)


def before_space(message: Column) -> Column:
    """Text before the first blank; empty where there is none."""
    return F.when(F.instr(message, " ") == 0, F.lit("")).otherwise(F.substring_index(message, " ", 1))


def to_count(text: Column) -> Column:
    return text.try_cast("int")


def number_text(value: Column) -> Column:
    """Up to six significant digits, without trailing zeros; exponents have three digits."""
    # a plain number whose own text has at most six digits is that text; formatting costs far more
    own, size = value.cast("string"), F.abs(value)
    short = (size >= 0.001) & (size < 1e6) & (F.length(own) <= 7)
    shown = F.format_string("%.6g", value)
    trimmed = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    padded = F.regexp_replace(trimmed, r"e([+-])(\d\d)$", "e$10$2")
    return F.when(short, F.when(own.endswith(".0"), F.substring_index(own, ".", 1)).otherwise(own)).when(value.isNotNull(), padded)


def rounded(value: Column, precision: int, scale: int) -> Column:
    """Round half away from zero to a fixed scale."""
    return value.cast(f"decimal({precision},{scale})")


def rounded_double(value: Column, precision: int, scale: int) -> Column:
    return rounded(value, precision, scale).cast("double")


def ratio_pct(part: Column, whole: Column) -> Column:
    """Percentage, 0 where there is no base."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double") * 100.0)


def same_text(left: Column, right: Column | str) -> Column:
    """Case-insensitive equality, as country names are entered by hand."""
    other = F.lit(right.strip()) if isinstance(right, str) else right
    return F.lower(left) == F.lower(other)
