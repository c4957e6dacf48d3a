"""Join helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys meet; the key columns of ``left`` are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def split_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """LEFT JOIN as the matched rows plus the left rows without a match.

    For a right side on which a key may repeat without bound: AQE can divide a
    hot key on either side of the inner join and on the left of the anti join,
    but never on the right of a left join. The inner join is null-safe against
    non-NULL keys, so no "is not NULL" is pushed into one of the two uses of
    ``left`` and the shuffle below them is shared.
    """
    keyed = right.dropna(subset=list(keys))
    matched = null_safe_join(left, keyed, keys)
    unmatched = left.join(keyed.select(*keys).distinct(), list(keys), "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)
