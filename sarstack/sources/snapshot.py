"""Snapshots: products saved as Parquet with their kind, and opened again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

KINDS = ("real", "wrap", "unit", "complex")


def save(df: DataFrame, path: str, kind: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` (overwriting) and return it as read back: a cut of the lineage.

    The kind is kept in the metadata of every column.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    marked = df.select(*(df[c].alias(c, metadata={"kind": kind}) for c in df.columns))
    w = marked.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return open_snapshot(df.sparkSession, path)[0]


def open_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A saved product and its kind."""
    df = spark.read.parquet(path)
    kinds = {f.metadata["kind"] for f in StructType([StructField.fromJson(f.jsonValue()) for f in df.schema.fields]) if "kind" in f.metadata}
    return df, (kinds.pop() if len(kinds) == 1 else "real")
