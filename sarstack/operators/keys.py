"""What tells one raster of a batch from another, beside its date or pair."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Columns that, where a table has them, belong to every key.
BATCH = ("burst", "pol")


def batch(*tables: DataFrame) -> list[str]:
    """The batch columns that all of ``tables`` have."""
    return [c for c in BATCH if all(c in t.columns for t in tables)]


def pixel(*tables: DataFrame) -> list[str]:
    """Key of a pixel: its batch columns, yi and xi."""
    return [*batch(*tables), "yi", "xi"]
