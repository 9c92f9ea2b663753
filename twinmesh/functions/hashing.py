"""Hash words, bit distance and the integer-exact similarity score."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def word(hash_: Column | str, i: int) -> Column:
    """The i-th 64-bit word of a hexadecimal hash; the last may be shorter."""
    return F.conv(F.substring(hash_, 1 + 16 * i, 16), 16, -10).cast("bigint")


def words(hash_: Column | str, bits: int) -> list[Column]:
    """Columns w0, w1, ... of a hash of the given length."""
    return [word(hash_, i).alias(f"w{i}") for i in range(-(-bits // 64))]


def distance(left: list[Column], right: list[Column]) -> Column:
    """Differing bits of two lists of words: fixed columns stay inside code generation."""
    total = F.lit(0)
    for a, b in zip(left, right, strict=True):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


def similarity(distance_: Column, bits: Column | int) -> Column:
    """100 * (bits - distance) / bits rounded half up to one decimal, in integers until the last step."""
    n = bits if isinstance(bits, Column) else F.lit(bits)
    n, d = n.cast("bigint"), distance_.cast("bigint")
    a, b = F.lit(2000) * (n - d) + n, F.lit(2) * n
    # a - pmod(a, b) is a multiple of b, so the quotient is exact as a double, too
    return ((a - F.pmod(a, b)) / b) / F.lit(10.0)


def similarity_of(distance_: int, bits: int) -> float:
    return (2000 * (bits - distance_) + bits) // (2 * bits) / 10


def max_distance(bits: int, threshold: float) -> int:
    """The greatest distance whose rounded similarity reaches the threshold; -1 if none does."""
    lowest = math.ceil(round(threshold * 10, 6))
    out = -1
    for d in range(bits + 1):
        if (2000 * (bits - d) + bits) // (2 * bits) < lowest:
            break
        out = d
    return out


def round_threshold(value: float) -> float:
    """Thresholds of cluster reads have one decimal, rounded half up."""
    return math.floor(value * 10 + 0.5) / 10


def half_up(col: Column, digits: int = 1) -> Column:
    """Rounds a double half up, as floor(x * 10^digits + 0.5) / 10^digits."""
    scale = 10.0**digits
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
