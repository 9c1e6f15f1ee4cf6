"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ready


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``, or the folder set by
    ``setCheckpointDir``. Only where both are unset and the session runs on
    this machine alone (tests) a temporary folder is made and set; a cluster
    without one is an error, since its executors share no temporary folder.
    """
    ready(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sarstack-")
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else "file://" + base


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read of the files, never
    the work behind them.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whichever file system holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables of one job, each deleted as soon as nothing to come reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_dir(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Delete every table but these."""
        held = {id(t) for t in tables}
        self.drop(*[t for _, t in self.paths.values() if id(t) not in held])

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and id(t) in self.paths:
                remove(self.spark, self.paths.pop(id(t))[0])


def columns(df: DataFrame) -> list:
    """All columns of ``df``, whatever characters their names have."""
    return [col(c) for c in df.columns]


def col(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


#: A key with 1 / HOT of all rows or more is hot: there are at most HOT of them.
HOT = 1_000


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one row a key and in ``weight`` how many of ``rows`` have it.

    Rows of hot keys stay where they are: the at most HOT rows of ``side`` that
    they need are broadcast. All others are shuffled, none of them in bulk.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    hot = (F.col(weight) * HOT >= total) & (F.col(weight) > 1)
    few = side.where(hot).drop(weight)
    stay = rows.join(F.broadcast(few), keys)  # HOT rows at most
    move = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(side.where(~hot).drop(weight), keys)
    return stay.unionByName(move)
