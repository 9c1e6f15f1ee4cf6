"""Radar-like relations derived from the test tables, as DataFrames and as SQL.

Dates come from ``events``: one acquisition a day, one pixel a user on a
lattice five columns wide, phase with a known velocity a pixel.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.phase import power, times_conj
from ..workers import ready

EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_c(f: Callable[[float], float]) -> Callable[[Column], Column]:
    """A function of the C library, bit by bit as the SQL engine has it: amplitudes with few decimals give ties of rounding and of bin edges, which the last bit decides."""

    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in v.to_pylist()], pa.float64())

    return F.arrow_udf(run, DoubleType())


c_sin, c_cos = _by_c(math.sin), _by_c(math.cos)


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, bpr."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("ts").cast("date").alias("d")).agg(F.round(100 * (F.avg("value") - 50), 1).alias("bpr"))


def slc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """yi, xi, d, re, im: one complex value a pixel and date, with gaps."""
    ready(spark)
    ev = table(spark, sf_dir, "events")
    cell = ev.groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.avg("value").alias("amp"), F.min("event_id").alias("e"))
    # hundredths first, as the SQL's decimals do: the product is exact
    phi = 2 * (F.col("user_id") % 7 - 3) * F.datediff("d", F.lit(EPOCH).cast("date")) / 100.0 + 0.3 * c_sin(F.col("e").cast("double"))
    yi = F.floor(F.col("user_id") / 5.0)
    return cell.select(yi.cast("int").alias("yi"), (F.col("user_id") - 5 * yi).cast("int").alias("xi"), "d", (F.col("amp") * c_cos(phi)).alias("re"), (F.col("amp") * c_sin(phi)).alias("im"))


def with_bursts(grid: DataFrame) -> DataFrame:
    """Row bands of two with one shared row: burst k holds rows 2k to 2k+2; as in the SQL, halves of negative rows go towards zero."""
    k = F.expr("yi div 2")
    both = F.when((F.col("yi") % 2 == 0) & (F.col("yi") > 0), F.array(k, k - 1)).otherwise(F.array(k))
    return grid.withColumn("burst", F.explode(both)).withColumn("burst", F.col("burst").cast("int"))


def geometry(grid: DataFrame) -> DataFrame:
    """azi, rng, ele of every pixel of a grid."""
    return grid.select("yi", "xi").distinct().select("yi", "xi", (F.col("yi") * 10.0).alias("azi"), (F.col("xi") * 20.0).alias("rng"), ((F.col("yi") * 7 + F.col("xi") * 13) % 50).cast("double").alias("ele"))


def stack(spark: SparkSession, sf_dir: str, days: int = 3) -> DataFrame:
    """Interferograms: pair_id, ref, rep, dt, bpr, yi, xi, re, im, corr."""
    from ..operators.network import baseline

    return interferograms(slc(spark, sf_dir), baseline(acquisitions(spark, sf_dir), days=days, cleanup=False))


def interferograms(scenes: DataFrame, pairs: DataFrame) -> DataFrame:
    """z = ref * conj(rep) of each pair and pixel that both dates have.

    ``corr`` is the smaller amplitude over the larger.
    """
    s = lambda p: scenes.select("yi", "xi", F.col("d").alias(f"{p}_d"), F.col("re").alias(f"{p}_re"), F.col("im").alias(f"{p}_im"))
    p = pairs.select("pair_id", "ref", "rep", "duration", "baseline")
    j = s("a").join(p, F.col("a_d") == F.col("ref")).join(s("b").withColumnRenamed("yi", "y2").withColumnRenamed("xi", "x2"), (F.col("b_d") == F.col("rep")) & (F.col("yi") == F.col("y2")) & (F.col("xi") == F.col("x2")))
    re, im = times_conj(F.col("a_re"), F.col("a_im"), F.col("b_re"), F.col("b_im"))
    pa, pb = F.sqrt(power(F.col("a_re"), F.col("a_im"))), F.sqrt(power(F.col("b_re"), F.col("b_im")))
    return j.select("pair_id", "ref", "rep", F.col("duration").alias("days"), (F.col("duration") / 365.25).alias("dt"), F.col("baseline").alias("bpr"), "yi", "xi", re.alias("re"), im.alias("im"), (F.least(pa, pb) / F.nullif(F.greatest(pa, pb), F.lit(0.0))).alias("corr"))


#: The same relations for DuckDB, to be followed by further CTEs or a SELECT.
SQL = """
WITH acq AS (SELECT cast(ts AS DATE) AS d, round(100 * (avg(value) - 50), 1) AS bpr FROM events GROUP BY 1),
cell AS (SELECT user_id, cast(ts AS DATE) AS d, avg(value) AS amp, min(event_id) AS e FROM events GROUP BY 1, 2),
ph AS (SELECT *, cast(floor(user_id / 5.0) AS INT) AS yi, cast(user_id - 5 * floor(user_id / 5.0) AS INT) AS xi,
  0.02 * (user_id % 7 - 3) * date_diff('day', DATE '2024-01-01', d) + 0.3 * sin(e) AS phi FROM cell),
slc AS (SELECT yi, xi, d, amp * cos(phi) AS re, amp * sin(phi) AS im FROM ph),
pairs AS (SELECT cast(row_number() OVER (ORDER BY a.d, b.d) AS INT) AS pair_id, a.d AS ref, b.d AS rep, round(a.bpr, 2) AS ref_baseline, round(b.bpr, 2) AS rep_baseline,
  round(b.bpr, 2) - round(a.bpr, 2) AS baseline, cast(date_diff('day', a.d, b.d) AS INT) AS duration FROM acq a JOIN acq b ON a.d < b.d AND date_diff('day', a.d, b.d) <= 3),
stack AS (SELECT pair_id, ref, rep, duration AS days, duration / 365.25 AS dt, baseline AS bpr, a.yi, a.xi, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im,
  least(sqrt(a.re * a.re + a.im * a.im), sqrt(b.re * b.re + b.im * b.im)) / nullif(greatest(sqrt(a.re * a.re + a.im * a.im), sqrt(b.re * b.re + b.im * b.im)), 0) AS corr
  FROM pairs p JOIN slc a ON a.d = p.ref JOIN slc b ON b.d = p.rep AND a.yi = b.yi AND a.xi = b.xi),
geom AS (SELECT DISTINCT yi, xi, yi * 10.0::DOUBLE AS azi, xi * 20.0::DOUBLE AS rng, ((yi * 7 + xi * 13) % 50)::DOUBLE AS ele FROM slc)
"""
