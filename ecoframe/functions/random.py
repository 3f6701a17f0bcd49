"""Counter-based random numbers: every draw is a hash of its coordinates.

A draw depends only on the seed and the values that name it (problem, replicate, group …), so it is the
same whatever the partitioning, and a task that is run again after an executor loss repeats it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *coordinates: Column, portable: bool = False) -> Column:
    """Uniform in [0, 1).

    The default mixes with xxhash64 (53 bits, stays in generated code). ``portable`` uses the first 32 bits
    of an MD5 text digest instead, which other engines can reproduce.
    """
    if portable:
        text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in coordinates])
        head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
        return head / F.lit(4294967296.0)
    mixed = F.xxhash64(F.lit(str(seed)), *coordinates)
    return F.shiftrightunsigned(mixed, 11).cast("double") * F.lit(2.0 ** -53)
