"""Counter-based randomness: a draw depends on its key alone, never on partitioning or order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(seed: int, stream: int, *keys: Column) -> Column:
    """Uniform in (0, 1), from 52 bits of a hash of the seed, the stream and the keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *keys), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def hash_normal(seed: int, stream: int, *keys: Column) -> Column:
    """Standard normal, by Box and Muller."""
    u, v = hash_uniform(seed, 2 * stream, *keys), hash_uniform(seed, 2 * stream + 1, *keys)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def mixed_uniform(key: Column) -> Column:
    """Uniform in [0, 1) by multiply, shift and xor below 2^53, which other SQL engines evaluate to the same value."""
    a = F.pmod(key * 1103515245 + 12345, F.lit(2147483648))
    b = a.bitwiseXOR(F.shiftright(a, 15))
    c = F.pmod(b * 22695477 + 1, F.lit(2147483648))
    d = c.bitwiseXOR(F.shiftright(c, 13))
    return d.cast("double") / 2147483648.0
