"""Fluent wrappers: a stack of scenes, and the pairs made from it.

Thin by design: each method is one function of ``sarstack.operators`` over the
wrapped DataFrame (``.df``), so chains are plans until something is read.

    stack = Stack(scenes, acquisitions, wavelength=0.0555)
    pairs = stack.pairs(stack.baseline(days=24)).filter(days=12).coherent(0.5)
    series = pairs.angle().unwrap1d().lstsq()
    speed = series.velocity()
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import geometry, phase
from .operators import aggregate, bursts, filters, grid, kernels, network, trend
from .plans.fixtures import interferograms
from .sources import snapshot


@dataclass(frozen=True)
class Frame:
    """A DataFrame with its kind and the scalars of its radar."""

    df: DataFrame
    kind: str = "real"
    wavelength: float = 0.0555

    def _with(self, df: DataFrame, kind: str | None = None):
        return replace(self, df=df, kind=kind or self.kind)

    def sel(self, y=None, x=None, **keys):
        return self._with(grid.sel(self.df, y, x, keys))

    def crop(self, y0: int, y1: int, x0: int, x1: int):
        return self._with(grid.crop(self.df, y0, y1, x0, x1))

    def isel(self, dim: str, positions: list[int]):
        return self._with(grid.isel(self.df, dim, positions))

    def where(self, mask: DataFrame):
        return self._with(grid.where(self.df, mask))

    def mask(self, ring: list[tuple[float, float]]):
        return self._with(grid.polygon_mask(self.df, ring))

    def pipe(self, fn, *args, **kw):
        return self._with(self.df.transform(fn, *args, **kw))

    def snapshot(self, path: str, **kw):
        return self._with(snapshot.save(self.df, path, self.kind, **kw))

    def mean(self, *keys: str) -> DataFrame:
        return (aggregate.reduce_wrapped if self.kind == "wrap" else aggregate.reduce_real)(self.df, list(keys))

    def coarsen(self, fy: int, fx: int, *keys: str):
        return self._with(aggregate.coarsen(self.df, fy, fx, list(keys), kind=self.kind if self.kind == "wrap" else "real"))


@dataclass(frozen=True)
class Series(Frame):
    """Values by date: yi, xi, d, value."""

    def velocity(self, epoch: str = "2000-01-01", min_valid: int = 5) -> DataFrame:
        t = F.datediff("d", F.lit(epoch).cast("date")) / 365.25
        first = self.df.groupBy("yi", "xi").agg(F.min("d").alias("__d"))
        return trend.velocity_series(self.df.join(first, ["yi", "xi"]).withColumn("t", t - F.datediff("__d", F.lit(epoch).cast("date")) / 365.25), min_valid)

    def displacement_los(self):
        return self._with(self.df.withColumn("value", geometry.los(F.col("value"), F.lit(self.wavelength))))

    def stl(self, **kw) -> DataFrame:
        return kernels.stl_decompose(self.df, **kw)


@dataclass(frozen=True)
class Pairs(Frame):
    """Rows a pair and pixel: pair_id, ref, rep, days, dt, bpr, yi, xi, and re, im, corr or value, corr."""

    network: DataFrame | None = None

    def _real(self, name: str) -> None:
        if self.kind == "wrap":
            raise TypeError(f"{name} needs real or complex values, not wrapped phase")

    def filter(self, **limits):
        kept = network.filter_pairs(self.network, **limits)
        return replace(self, df=self.df.join(kept.select("pair_id"), "pair_id", "left_semi"), network=kept)

    def coherent(self, threshold: float = 0.5):
        return self._with(aggregate.coherent(self.df, threshold).drop("mean_corr"))

    def threshold(self, limit: float = phase.pi / 2):
        return self._with(aggregate.threshold(self.df, limit).drop("cstd"))

    def angle(self):
        return self._with(self.df.withColumn("value", phase.angle(F.col("re"), F.col("im"))).drop("re", "im"), "wrap")

    def gaussian(self, sigma: tuple[float, float], lattice: DataFrame):
        g = filters.gaussian(self.df, ["re", "im"], lattice, sigma, ["pair_id"], weight="corr")
        return self._with(self.df.drop("re", "im").join(g, ["pair_id", "yi", "xi"]))

    def goldstein(self, **kw):
        return self._with(self.df.drop("re", "im").join(kernels.goldstein(self.df, **kw), ["pair_id", "yi", "xi"]))

    def unwrap1d(self):
        return self._with(self.df.drop("value").join(kernels.unwrap1d(self.df), ["pair_id", "yi", "xi"]), "real")

    def unwrap2d(self, **kw):
        return self._with(self.df.drop("value").join(kernels.unwrap2d(self.df, **kw), ["pair_id", "yi", "xi"]), "real")

    def trend2d(self, regressors: list[str], weight: str | None = "corr") -> DataFrame:
        self._real("trend2d")
        return trend.trend2d(self.df, regressors, ["pair_id"], weight=weight)

    def detrend2d(self, regressors: list[str], weight: str | None = "corr"):
        t = self.trend2d(regressors, weight)
        return self._with(t.withColumn("value", F.col("value") - F.col("trend")).drop("trend"))

    def detrend1d_baseline(self, **kw):
        """The complex pairs turned back by their robust line over the baseline."""
        self._real("detrend1d_baseline")
        t = kernels.trend1d_baseline(self.df, **kw).select("pair_id", "yi", "xi", F.col("value").alias("__t"))
        re, im = phase.times_conj(F.col("re"), F.col("im"), F.cos("__t"), F.sin("__t"))
        return self._with(self.df.join(t, ["pair_id", "yi", "xi"]).withColumns({"re": re, "im": im}).drop("__t"))

    def lstsq(self, **kw) -> Series:
        self._real("lstsq")
        return Series(kernels.lstsq(self.df, **kw), "real", self.wavelength)

    def velocity(self, seasonal: bool = False, max_refine: int = 3) -> DataFrame:
        return (kernels.velocity_seasonal if seasonal else trend.velocity_pairs)(self.df, max_refine)

    def rmse(self, velocity: DataFrame, weighted: bool = True) -> DataFrame:
        return aggregate.rmse_velocity(self.df, velocity, weighted, self.kind == "wrap")

    def residuals(self) -> DataFrame:
        return bursts.residuals(self.df, wrapped=self.kind == "wrap")

    def align(self, **kw):
        return self._with(bursts.align(self.df, wrapped=self.kind == "wrap", **kw))

    def dissolve(self, **kw):
        return self._with(bursts.dissolve(self.df, wrapped=self.kind == "wrap", **kw))

    def mosaic(self):
        return self._with(bursts.mosaic(self.df))


@dataclass(frozen=True)
class Stack(Frame):
    """Scenes (yi, xi, d, re, im) and their acquisitions (d, bpr)."""

    acquisitions: DataFrame | None = None

    def baseline(self, days: int, **kw) -> DataFrame:
        return network.baseline(self.acquisitions, days, **kw)

    def pairs(self, network_: DataFrame) -> Pairs:
        return Pairs(interferograms(self.df, network_), "complex", self.wavelength, network_)

    def interferogram(self, network_: DataFrame, sigma: tuple[float, float]) -> Pairs:
        z = filters.interferogram(self.df, network_, sigma)
        about = network_.select("pair_id", "ref", "rep", F.col("duration").alias("days"), (F.col("duration") / 365.25).alias("dt"), F.col("baseline").alias("bpr"))
        return Pairs(z.join(about, "pair_id"), "complex", self.wavelength, network_)

    def psfunction(self) -> DataFrame:
        return aggregate.psfunction(self.df)

    def adi(self) -> DataFrame:
        return aggregate.adi(self.df)
