"""Order-independent hashing of book levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookstrata.functions.exact import _col

TWO_64 = 1 << 64

# The two multipliers and three shifts of the splitmix64 finalizer.
MIX_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MIX_SHIFTS = (30, 27, 31)
# Bits a level packs into, from the top: side 1, price 19, count 44.
PRICE_BITS = 19
COUNT_BITS = 44


@F.pandas_udf(T.LongType())
def _mix64(packed: pd.Series) -> pd.Series:
    """splitmix64 over whole Arrow batches; uint64 arithmetic wraps, BIGINT under ANSI would not."""
    first, second = (np.uint64(m) for m in MIX_MULTIPLIERS)
    a, b, c = (np.uint64(s) for s in MIX_SHIFTS)
    z = packed.to_numpy(dtype=np.int64).view(np.uint64).copy()
    z = (z ^ (z >> a)) * first
    z = (z ^ (z >> b)) * second
    return pd.Series((z ^ (z >> c)).view(np.int64))


def level_key(side: Column | str, price: Column | str, count: Column | str) -> Column:
    """A level packed into one 64-bit integer (the sign bit is the side)."""
    low_price = _col(price).cast("bigint").bitwiseAND(F.lit((1 << PRICE_BITS) - 1))
    low_count = _col(count).cast("bigint").bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    packed = F.shiftleft(low_price, COUNT_BITS).bitwiseOR(low_count)
    return packed.bitwiseOR(F.shiftleft(_col(side).cast("bigint"), 63))


def level_mix64(side: Column | str, price: Column | str, count: Column | str) -> Column:
    """64-bit hash of one level, as a signed BIGINT."""
    return _mix64(level_key(side, price, count))


def unsigned(value: Column | str) -> Column:
    """A signed 64-bit pattern read as an unsigned number."""
    number = _col(value).cast("decimal(20,0)")
    return F.when(number < 0, number + F.lit(str(TWO_64)).cast("decimal(20,0)")).otherwise(number)


def checksum_of(hashes: Column | str) -> Column:
    """Aggregate: the sum of level hashes modulo 2^64, whatever order they come in."""
    return (F.sum(unsigned(hashes)) % F.lit(str(TWO_64)).cast("decimal(20,0)")).cast("decimal(20,0)")
