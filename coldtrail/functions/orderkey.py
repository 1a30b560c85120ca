"""A number, a time and a small number in one decimal that orders like the three, so that extremes are hash-aggregated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DETAILS = 4  # details are numbered 0 to 3
TIME_SPAN = 1 << 53  # microseconds since 1970, up to the year 2255
UNIT = TIME_SPAN * DETAILS
_SIGN_OFF = (1 << 63) - 1


def _exact(number: int) -> Column:
    return F.expr(f"{number}BD")


def bits_of(value: Column) -> Column:
    """The bits of a double as a long, null for null. The call is costly: give it a column of its own where it is used twice."""
    some = value + F.lit(0.0)  # adding zero turns -0 into 0
    return F.when(value.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), some).cast("bigint"))


def rank_of(bits: Column) -> Column:
    """A long that orders like the double of these bits."""
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_SIGN_OFF))).otherwise(bits)


def turned_rank(rank: Column, value: Column) -> Column:
    """The rank of the negative of the value."""
    return F.when((value == 0) | F.isnan(value), rank).otherwise(F.bitwise_not(rank))


def packed_rank(rank: Column, at: Column, detail: Column | int = 0) -> Column:
    rest = F.unix_micros(at) * DETAILS + (F.lit(detail) if isinstance(detail, int) else detail).cast("bigint")
    return F.when(rank.isNotNull(), (rank.cast("decimal(19,0)") * _exact(UNIT) + rest.cast("decimal(17,0)")).cast("decimal(38,0)"))


def packed(value: Column, at: Column, detail: Column | int = 0) -> Column:
    """Decimal of 38 digits; smaller for the smaller value, then the earlier time, then the smaller detail. Null for a null value."""
    return packed_rank(rank_of(bits_of(value)), at, detail)


def _rest(key: Column) -> Column:
    return F.pmod(key, _exact(UNIT).cast("decimal(38,0)")).cast("bigint")


def value_of(key: Column) -> Column:
    """The very double that was packed."""
    ordered = F.call_function("div", key - _rest(key).cast("decimal(38,0)"), _exact(UNIT))
    bits = F.when(ordered < 0, ordered.bitwiseXOR(F.lit(_SIGN_OFF))).otherwise(ordered)
    return F.when(key.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double"))


def time_of(key: Column) -> Column:
    return F.timestamp_micros(F.shiftright(_rest(key), DETAILS.bit_length() - 1))


def detail_of(key: Column) -> Column:
    return (_rest(key) % DETAILS).cast("int")
