"""Latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Row with the greatest ``order`` values per key.

    An aggregate rather than a window: every task first reduces its own rows to
    one per key, so a key with very many rows never meets in one place. The last
    order column should be unique within the key.
    """
    others = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
        .select(key, "_row.*")
        .select(*rows.columns)
    )
