"""Keep rows whose key occurs in a key table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key list this short becomes a literal IN predicate, which also prunes
# partitions when the key is a partition column.
MAX_LITERAL_KEYS = 1_000


def keep_members(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` occurs in the one-column frame ``keys``, of any size.

    The key plan runs once, inside the query; adaptive execution broadcasts its
    result if it turns out small, and splits a hot key otherwise.
    """
    wanted = keys.select(F.col(keys.columns[0]).alias(column)).where(F.col(column).isNotNull())
    return rows.join(wanted, column, "left_semi")


def keep_listed(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The same for a short key table that is cheap to read, such as a session's streams.

    At most 1,001 keys are read beforehand; a longer table is joined.
    """
    few = keys.select(F.col(keys.columns[0]).alias(column)).where(F.col(column).isNotNull())
    listed = few.distinct().limit(MAX_LITERAL_KEYS + 1).collect()
    if len(listed) > MAX_LITERAL_KEYS:
        return keep_members(rows, keys, column)
    return rows.where(F.col(column).isin([row[0] for row in listed]))
