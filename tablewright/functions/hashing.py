"""A uniform number per row that depends on nothing but the row's key and a seed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_text

#: 15 hexadecimal digits of the digest: the largest whole number of digits in a long.
HASH_BITS = 60
HASH_RANGE = 1 << HASH_BITS


def key_digits(df: DataFrame, key: Sequence[str], seed: int) -> Column:
    """First 15 hexadecimal digits of the MD5 of ``key1|key2|...:seed``; equal in any engine."""
    parts = [F.coalesce(as_text(df, name), F.lit("\\N")) for name in key]
    return F.substring(F.md5(F.concat(F.concat_ws("|", *parts), F.lit(f":{seed}"))), 1, 15)


def key_hash(df: DataFrame, key: Sequence[str], seed: int) -> Column:
    """The same digits as a 60-bit integer."""
    return F.conv(key_digits(df, key, seed), 16, 10).cast("long")


def digits_below(share: float) -> str:
    """Digits that a given share of all keys sorts before; fixed width, so text order is number order."""
    return format(math.ceil(share * HASH_RANGE), "015x")
