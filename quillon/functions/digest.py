"""Digests of rows that don't depend on their order: the sums of the rows' own digests, which are added up before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A row's SHA-256 is cut into so many numbers of 32 bits, and each is summed modulo 2^32.
LANES = 8


def row_digest(*values: Column) -> Column:
    """SHA-256 of a row's values, with their lengths, so that no two rows have one text; a null is told apart from an empty value."""
    parts = [
        F.coalesce(F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
        for v in values
    ]
    return F.sha2(F.concat_ws(",", *parts), 256)


def multiset_digest(digest: Column) -> Column:
    """An aggregate: one digest of all rows' digests. Rows that occur twice count twice. What a task sends is eight sums and a count, however many rows it has."""
    lanes = [
        (F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")) % (1 << 32)).cast("string")
        for i in range(LANES)
    ]
    return F.sha2(F.concat_ws("|", F.count(digest).cast("string"), *lanes), 256)
