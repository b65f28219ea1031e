"""Keyed draws: whole numbers that depend on their key alone, not on partitions or a generator's state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed(seed: int, *key: str | Column) -> Column:
    """60 bits of the MD5 of seed and key, as a number of zero or more; null parts of a key are passed over."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
