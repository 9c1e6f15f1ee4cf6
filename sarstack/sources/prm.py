"""Parameter tables: ``name = value`` text as a map, with updates and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, params (map) of every parameter file under ``path``."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    kv = lines.select("file", F.split("value", r"\s*=\s*", 2).alias("p")).where(F.size("p") == 2)
    return kv.groupBy("file").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.trim(F.col("p")[0]), F.trim(F.col("p")[1]))))).alias("params"))


def update(a: Column, b: Column) -> Column:
    """Parameters of both, b's where both have one."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def difference(a: Column, b: Column) -> Column:
    """Parameters of a that b lacks or has with another value."""
    return F.map_filter(a, lambda k, v: ~F.coalesce(F.try_element_at(b, k) == v, F.lit(False)))


def text(params: Column) -> Column:
    """``name = value`` lines in order of names."""
    pairs = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), "\n")
