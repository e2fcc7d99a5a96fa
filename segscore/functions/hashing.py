"""Keyed draws: random numbers that are a pure function of (seed, stream, key), equal in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def draw(stream: str, *keys: Column | str, seed: int = SEED) -> Column:
    """A 60-bit number. Keys are cast to string, so pass integers or strings, never doubles."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    told = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *(c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")
