"""Joins of a very large table with one that has a few rows per theme or type.

Such a small side is computed, so neither the optimizer's estimate nor adaptive execution can save the large side
from a shuffle: by the time the true size is known, the large side has been written out. The bound is therefore
checked beforehand, on the table that limits it. Where it is absent or too large, the join stays an ordinary
one, which is right at any size.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SMALL_ROWS = 100_000


def is_small(groups: DataFrame | bool | None, rows_per_group: int = 1) -> bool:
    """Whether that many rows for each of the groups stay within the limit; counts no further than that.

    A finding can be passed on in place of the groups.
    """
    if groups is None or isinstance(groups, bool):
        return bool(groups)
    allowed = MAX_SMALL_ROWS // rows_per_group
    return groups.limit(allowed + 1).count() <= allowed


def hinted(small: DataFrame, groups: DataFrame | bool | None, rows_per_group: int = 1) -> DataFrame:
    """``small``, to be broadcast if its bound was checked."""
    return F.broadcast(small) if is_small(groups, rows_per_group) else small
