"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip_blanks(text: Column) -> Column:
    """Strip leading and trailing blanks of any kind, not only spaces.

    A text between two visible ASCII characters, nearly every line, is passed through: the pattern
    would be tried at each of its characters. Bytes are looked at, as characters would be counted.
    """
    octets = text.cast("binary")
    bare = [F.substring(octets, at, 1).between(F.lit(b"!"), F.lit(b"~")) for at in (1, -1)]
    return F.when(bare[0] & bare[1], text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""))


def drop_undecodable(text: Column) -> Column:
    """Remove bytes that are not UTF-8. Valid text, nearly all of it, is passed through."""
    repaired = F.translate(F.make_valid_utf8(text), "�", "")
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def fixed_decimals(value: Column, digits: int) -> Column:
    """``value`` with ``digits`` decimals, rounded on its exact binary value, ties to even.

    Java's own formatter rounds the shortest decimal form half up, which differs from C
    and Python in the last digit. Here the remainder of ``|value| * 10**digits`` is
    computed without rounding error, by splitting the double into two 26-bit halves
    whose products with a small power of ten are exact.
    """
    scale = float(10 ** digits)
    size = F.abs(value.cast("double"))
    split = size * F.lit(134217729.0)
    high = split - (split - size)
    low = size - high
    whole = F.floor(size * scale).cast("double")
    rest = (high * scale - whole) + low * scale
    # floor() saw a rounded product, so it can be one too high.
    whole = F.when(rest < 0, whole - 1).otherwise(whole)
    over_half = (high * scale - whole - F.lit(0.5)) + low * scale
    up = (over_half > 0) | ((over_half == 0) & (whole % 2 == 1))
    rounded = F.when(up, whole + 1).otherwise(whole) / scale
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, F.format_string(f"%.{digits}f", rounded))
