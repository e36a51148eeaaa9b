"""Row hashes that depend on the row key alone.

A sample, split or fold drawn from them is the same whatever the partitioning,
the number of executors or the number of times a lost partition is recomputed,
and needs neither a sort nor a shuffle. A null key has no hash: it fails the job, because
the row would else be in no part, no sample and no fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATIFY = "strat:"
SPLIT = "split:"
SAMPLE = "samp:"
FOLD = "fold:"

_RANGE = float(2**32)


def row_hash(key: str, salt: str) -> Column:
    """First 32 bits of md5(salt || key) as a bigint."""
    refused = F.raise_error(F.lit(f"null in the row key {key}")).cast("string")
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), refused)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def row_uniform(key: str, salt: str) -> Column:
    """The row hash scaled to [0, 1)."""
    return row_hash(key, salt) / F.lit(_RANGE)
