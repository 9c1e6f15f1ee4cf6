"""Kind-aware aggregates, errors, histograms, correlation, point selection."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phase import circular_mean, circular_std, circular_var, power, resultant, wrap
from .keys import batch, pixel


def reduce_real(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """mean, sum, min, max, median, std and var (population) of each group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var"), F.count(v).alias("n"))


def reduce_wrapped(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Circular mean, std and var of each group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(circular_mean(v).alias("mean"), circular_std(v).alias("std"), circular_var(v).alias("var"), resultant(v).alias("r"), F.count(v).alias("n"))


def coarsen_start(factor: int, origin: int = 0) -> int:
    """Rows to skip so that blocks begin on multiples of ``factor``."""
    return -origin % factor


def coarsen(df: DataFrame, fy: int, fx: int, keys: list[str], value: str = "value", kind: str = "real", lattice: DataFrame | None = None) -> DataFrame:
    """Means of fy x fx blocks that lie wholly inside the lattice.

    ``n`` counts a block's values, ``pixels`` its rows with or without one.
    Blocks begin on multiples of the factors. The last complete block comes
    from the lattice's extent (of ``lattice``, else of ``df``).
    """
    ext = (lattice or df).agg(F.max("yi").alias("__my"), F.max("xi").alias("__mx"))
    by, bx = F.floor(F.col("yi") / fy), F.floor(F.col("xi") / fx)
    d = df.join(F.broadcast(ext)).where(((by + 1) * fy - 1 <= F.col("__my")) & ((bx + 1) * fx - 1 <= F.col("__mx")))  # ext is one row
    v = F.col(value)
    agg = F.avg(v) if kind == "real" else circular_mean(v)
    return d.groupBy(*keys, by.cast("int").alias("yi"), bx.cast("int").alias("xi")).agg(agg.alias(value), F.count(v).alias("n"), F.count("*").alias("pixels"))


def rmse_pairs(obs: DataFrame, fit: DataFrame, keys: list[str] = ["pair_id", "yi", "xi"], weighted: bool = False, wrapped: bool = False) -> DataFrame:  # noqa: B006
    """Root mean square of obs - fit by pixel; ``corr`` of obs weighs it if asked."""
    r = F.col("value") - F.col("fit")
    return _rms(obs.join(fit.withColumnRenamed("value", "fit"), keys), wrap(r) if wrapped else r, weighted)


def rmse_dates(obs: DataFrame, series: DataFrame, weighted: bool = False) -> DataFrame:
    """Against a time series: a pair's fit is value(rep) - value(ref)."""
    at = pixel(obs, series)
    s = lambda p, k: series.select(F.col("d").alias(k), *at, F.col("value").alias(p))
    j = obs.join(s("v1", "ref"), ["ref", *at]).join(s("v2", "rep"), ["rep", *at])
    return _rms(j, F.col("value") - (F.col("v2") - F.col("v1")), weighted)


def rmse_velocity(obs: DataFrame, velocity: DataFrame, weighted: bool = False, wrapped: bool = False) -> DataFrame:
    """Against a yearly rate: a pair's fit is velocity * dt."""
    at = pixel(obs, velocity)
    j = obs.join(velocity.select(*at, "velocity"), at)
    r = F.col("value") - F.col("velocity") * F.col("dt")
    return _rms(j, wrap(r) if wrapped else r, weighted)


def _rms(j: DataFrame, r: Column, weighted: bool) -> DataFrame:
    j = j.withColumn("__r", r).where("__r is not null")
    w = F.col("corr") if weighted else F.lit(1.0)
    return j.groupBy("yi", "xi").agg(F.sqrt(F.sum(w * F.col("__r") * F.col("__r")) / F.nullif(F.sum(w), F.lit(0.0))).alias("rmse"), F.count("__r").alias("n"))


def histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts of ``bins`` equal bins over [lo, hi]; the last is closed, empty ones are given too."""
    v = F.col(value)
    b = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    got = df.where(v.between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def corrcoef(df: DataFrame, key: str, channel: str, value: str, channels: int, mask_diagonal: bool = False) -> DataFrame:
    """Pearson matrix of ``channels`` channels over the keys that have them all, rounded to 2.

    One pass: a key's values become an array, and each key adds to every pair
    of channels (channels are few).
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(channel, value))).alias("v")).where(F.size("v") == channels)
    one = rows.select(F.transform("v", lambda x: x[value]).alias("v"))
    ij = one.select("v", F.posexplode("v").alias("i", "a")).select("i", "a", F.posexplode("v").alias("j", "b"))
    r = F.round(F.corr("a", "b"), 2) + 0.0
    return ij.groupBy("i", "j").agg((F.when(F.col("i") == F.col("j"), F.lit(None if mask_diagonal else 1.0)).otherwise(r)).alias("r"))


def psfunction(scenes: DataFrame) -> DataFrame:
    """Mean over twice the deviation of the intensity, each date scaled to the mean of the dates' means."""
    p = scenes.select(*pixel(scenes), "d", power(F.col("re"), F.col("im")).alias("p"))
    by = batch(scenes)
    date = p.groupBy(*by, "d").agg(F.avg("p").alias("m"))
    total = date.groupBy(*by).agg(F.avg("m").alias("g"))  # one row a raster
    scale = (date.join(total, by) if by else date.join(F.broadcast(total))).select(*by, "d", (F.col("g") / F.nullif(F.col("m"), F.lit(0.0))).alias("k"))
    x = p.join(scale, [*by, "d"]).withColumn("q", F.col("p") * F.col("k"))
    return x.groupBy(*pixel(scenes)).agg((F.avg("q") / F.nullif(2 * F.stddev_samp("q"), F.lit(0.0))).alias("psf"), F.count("q").alias("n"))


def adi(scenes: DataFrame) -> DataFrame:
    """Amplitude dispersion: deviation over mean."""
    a = F.sqrt(power(F.col("re"), F.col("im")))
    return scenes.groupBy(*pixel(scenes)).agg((F.stddev_pop(a) / F.nullif(F.avg(a), F.lit(0.0))).alias("adi"))


def coherent(stack: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pixels whose mean correlation over the pairs reaches the threshold, with all their rows."""
    w = Window.partitionBy(*pixel(stack))
    return stack.withColumn("mean_corr", F.avg("corr").over(w)).where(F.col("mean_corr") >= threshold)


def threshold(stack: DataFrame, limit: float = pi / 2) -> DataFrame:
    """re, im become NULL at pixels whose weighted circular deviation is not below ``limit``."""
    w = Window.partitionBy(*pixel(stack))
    use = ((F.col("re") != 0) | (F.col("im") != 0)) & (F.col("corr") > 0)
    a = F.sqrt(power(F.col("re"), F.col("im")))
    sw = F.sum(F.when(use, F.col("corr"))).over(w)
    c = F.sum(F.when(use, F.col("corr") * F.col("re") / a)).over(w) / F.nullif(sw, F.lit(0.0))
    s = F.sum(F.when(use, F.col("corr") * F.col("im") / a)).over(w) / F.nullif(sw, F.lit(0.0))
    r = F.sqrt(c * c + s * s)
    std = F.when((sw >= 1e-10) & (r >= 1e-10), F.sqrt(-2 * F.ln(F.least(r, F.lit(1 - 1e-10)))))
    d = stack.withColumn("cstd", std)
    keep = F.coalesce(F.col("cstd") < limit, F.lit(False))
    return d.withColumn("re", F.when(keep, F.col("re"))).withColumn("im", F.when(keep, F.col("im")))
