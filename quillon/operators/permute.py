"""Random samples without replacement by a keyed permutation of positions: a sample's members are computed, and nothing is sorted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of swap or not. A position has been left alone by all of them with probability 2^-20.
ROUNDS = 20
#: The modulus and multipliers of the mixing function; products stay within 64 bits for up to 2^31 positions.
MODULUS, BY_ROUND, BY_VALUE = 2147483647, 40503, 2654435


def key_of(*parts: Column) -> Column:
    """A key below 2^28 from what names a sample, the same on any cluster."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("long")


def _mixed(key: Column, step: Column, value: Column) -> Column:
    """A number below MODULUS: two squarings modulo a prime."""
    a = (key + step * BY_ROUND + value * BY_VALUE) % MODULUS
    return F.transform(F.array((a * a + key) % MODULUS), lambda b: (b * b + value) % MODULUS)[0]


def permuted(at: Column, n: Column, key: Column) -> Column:
    """Where the key's permutation of [0, n) takes a position.

    Each round pairs x with (k - x) mod n, for a k of its own, and swaps the two or not by a bit that depends on the pair: a permutation
    for every n, without a detour through a larger range. Different positions never meet.
    """
    n, key = n.cast("long"), key.cast("long")

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(_mixed(key, r, n) % n - x, n)
        top = F.greatest(x, other)
        return F.when((_mixed(key, r, top) / 4096).cast("long") % 2 == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), at.cast("long"), step)
