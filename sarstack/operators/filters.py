"""Spatial filters as separable joins with small kernels."""

from __future__ import annotations

from math import ceil, exp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Offsets and normalised Gaussian weights."""
    h = ceil(sigma * truncate)
    w = [exp(-0.5 * (i / sigma) ** 2) for i in range(-h, h + 1)]
    return [(i, x / sum(w)) for i, x in zip(range(-h, h + 1), w, strict=True)]


def sigma_of(wavelength: float, spacing: float) -> float:
    """Pixels of standard deviation for a cut-off wavelength in metres."""
    return wavelength / (5.3 * abs(spacing))


def gaussian(df: DataFrame, values: list[str], lattice: DataFrame, sigma: tuple[float, float], keys: list[str], weight: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Masked Gaussian means over a complete rectangle with replicated edges.

    sum(k w v) / sum(k w) for each value; without a weight, a pixel whose
    valid share is not above ``threshold`` becomes NULL; with one, where the
    weight's sum is below 1e-10.

    A pass spreads each row to the taps that it feeds (an edge row feeds the
    taps that replicate it) and sums by target: one shuffle a pass, partial
    sums before it, no window over a whole column.
    """
    ext = lattice.agg(F.min("yi").alias("y0"), F.max("yi").alias("y1"), F.min("xi").alias("x0"), F.max("xi").alias("x1"))
    w = F.col(weight) if weight else F.lit(1.0)
    d = df.select(*keys, "yi", "xi", *(F.when(F.col(v).isNotNull(), w).alias(f"d_{v}") for v in values), *((w * F.col(v)).alias(f"n_{v}") for v in values))
    d = d.join(F.broadcast(ext))  # ext is one row
    sums = [f"{p}_{v}" for v in values for p in ("n", "d")]
    for axis, s in (("yi", sigma[0]), ("xi", sigma[1])):
        lo, hi = ("y0", "y1") if axis == "yi" else ("x0", "x1")
        taps = kernel(s)
        h = taps[-1][0]
        weights = F.array(*(F.lit(x) for _, x in taps))
        # row r feeds target t with the taps whose clamped position is r
        first, last = F.greatest(F.col(lo), F.col(axis) - h), F.least(F.col(hi), F.col(axis) + h)
        first = F.when(F.col(axis) == F.col(hi), F.greatest(F.col(lo), F.col(axis) - h)).otherwise(first)
        t = d.withColumn("t", F.explode(F.sequence(first, last)))
        at = F.col(axis) - F.col("t") + h  # index of the tap that reaches the row itself
        own = F.element_at(weights, at + 1)
        below = F.when(F.col(axis) == F.col(lo), F.aggregate(F.slice(weights, F.lit(1), F.greatest(at, F.lit(0))), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
        above = F.when(F.col(axis) == F.col(hi), F.aggregate(F.slice(weights, at + 2, F.greatest(F.lit(2 * h) - at, F.lit(0))), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
        t = t.withColumn("k", own + below + above)
        other = "xi" if axis == "yi" else "yi"
        d = t.groupBy(*keys, F.col("t").alias(axis), other, "y0", "y1", "x0", "x1").agg(*(F.sum(F.col("k") * F.col(c)).alias(c) for c in sums))
    low = (lambda v: F.col(f"d_{v}") < 1e-10) if weight else (lambda v: F.col(f"d_{v}") <= threshold)
    return d.select(*keys, "yi", "xi", *(F.when(~low(v), F.col(f"n_{v}") / F.nullif(F.col(f"d_{v}"), F.lit(0.0))).alias(v) for v in values))


def interferogram(scenes: DataFrame, pairs: DataFrame, sigma: tuple[float, float]) -> DataFrame:
    """Multilooked phase and correlation of each pair: gamma = |G z| / sqrt(G |ref|^2 G |rep|^2)."""
    s = lambda p: scenes.select("yi", "xi", F.col("d").alias(f"{p}_d"), F.col("re").alias(f"{p}re"), F.col("im").alias(f"{p}im"))
    j = s("a").join(pairs.select("pair_id", F.col("ref").alias("a_d"), F.col("rep").alias("b_d")), "a_d").join(s("b"), ["b_d", "yi", "xi"])
    z = j.select("pair_id", "yi", "xi", (F.col("are") * F.col("bre") + F.col("aim") * F.col("bim")).alias("re"), (F.col("aim") * F.col("bre") - F.col("are") * F.col("bim")).alias("im"), (F.col("are") ** 2 + F.col("aim") ** 2).alias("pa"), (F.col("bre") ** 2 + F.col("bim") ** 2).alias("pb"))
    g = gaussian(z, ["re", "im", "pa", "pb"], scenes, sigma, ["pair_id"])
    gamma = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.nullif(F.sqrt(F.col("pa") * F.col("pb")), F.lit(0.0))
    return g.select("pair_id", "yi", "xi", "re", "im", F.when(gamma.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), gamma))).alias("corr"))
