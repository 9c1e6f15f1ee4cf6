"""Numpy kernels over tiles of pixels and over whole rasters, through grouped Arrow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import pixels, raster, stl
from ..workers import ready
from .keys import batch

TILE = 16


class Tile:
    """A tile's rows as dense (pixels, samples) arrays."""

    def __init__(self, table: pa.Table, sample: str):
        self.y, self.x = (table.column(c).to_numpy().astype(np.int64) for c in ("yi", "xi"))
        key = (self.y - self.y.min()) * (self.x.max() - self.x.min() + 1) + self.x - self.x.min()
        self.pix, first, self.row = np.unique(key, return_index=True, return_inverse=True)
        self.py, self.px = self.y[first], self.x[first]
        self.samples, self.first, self.col = np.unique(table.column(sample).to_numpy(), return_index=True, return_inverse=True)
        self.table = table

    def dense(self, name: str) -> np.ndarray:
        out = np.full((len(self.pix), len(self.samples)), np.nan)
        v = self.table.column(name).to_numpy(zero_copy_only=False).astype(float)
        out[self.row, self.col] = v
        return out

    def of_sample(self, name: str) -> np.ndarray:
        """A value that depends on the sample alone."""
        return self.table.column(name).to_numpy(zero_copy_only=False)[self.first]

    def dates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted dates, and each pair's two as indices."""
        ref, rep = (self.of_sample(c).astype("datetime64[D]") for c in ("ref", "rep"))
        days = np.unique(np.concatenate([ref, rep]))
        return days, np.searchsorted(days, ref), np.searchsorted(days, rep)


def keyed(df: DataFrame, by: list[str], fn: Callable[[pa.Table, dict], pa.Table], schema: str) -> DataFrame:
    """``fn`` over groups of the batch columns and ``by``; the batch columns come back with every row.

    ``fn`` takes a group's rows and its key by name.
    """
    ready(df.sparkSession)
    own, kinds = batch(df), dict(df.dtypes)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = dict(zip([*own, *by], (k.as_py() for k in key), strict=True))
        out = fn(table, at)
        for c in own:
            out = out.append_column(c, pa.array([at[c]] * out.num_rows, table.schema.field(c).type))
        return out

    return df.groupBy(*own, *by).applyInArrow(run, ", ".join([schema, *(f"{c} {kinds[c]}" for c in own)]))


def per_tile(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str, tile: int = TILE) -> DataFrame:
    """``fn`` over square tiles of pixels of each raster: bounded groups of tile * tile pixels and their samples."""
    d = df.withColumn("ty", F.floor(F.col("yi") / tile)).withColumn("tx", F.floor(F.col("xi") / tile))
    return keyed(d, ["ty", "tx"], lambda table, _: fn(table), schema)


def _long(t: Tile, out: np.ndarray, samples: np.ndarray, sample: str, value: str) -> pa.Table:
    n = out.shape[1]
    v = out.ravel()
    ok = np.isfinite(v)
    cols = {"yi": np.repeat(t.py, n), "xi": np.repeat(t.px, n), sample: np.tile(samples, len(t.py)), value: v}
    return pa.table({k: pa.array(c[ok].astype(np.int32) if k in ("yi", "xi") else c[ok]) for k, c in cols.items()})


def lstsq(unwrapped: DataFrame, cumulative: bool = True, iterations: int = 5, eps: float = 0.1, tol: float = 1e-3, tile: int = TILE) -> DataFrame:
    """Pair phases (value, corr) to a series by date: yi, xi, d, value."""

    def run(table: pa.Table) -> pa.Table:
        t = Tile(table, "pair_id")
        days, ref, rep = t.dates()
        out = pixels.invert(t.dense("value"), t.dense("corr"), pixels.incidence(ref, rep, len(days)), iterations, eps, tol, cumulative)
        return _long(t, out, days, "d", "value")

    return per_tile(unwrapped, run, "yi int, xi int, d date, value double", tile)


def unwrap1d(wrapped: DataFrame, tile: int = TILE) -> DataFrame:
    """Temporal unwrapping of pair phases (value, corr): yi, xi, pair_id, value."""

    def run(table: pa.Table) -> pa.Table:
        t = Tile(table, "pair_id")
        days, ref, rep = t.dates()
        out = pixels.unwrap(t.dense("value"), t.dense("corr"), pixels.incidence(ref, rep, len(days)))
        return _long(t, out, t.samples, "pair_id", "value")

    return per_tile(wrapped, run, "yi int, xi int, pair_id int, value double", tile)


def trend1d_baseline(stack: DataFrame, by: str = "bpr", intercept: bool = False, slope: bool = True, tile: int = TILE) -> DataFrame:
    """Robust line of the phase over the baseline by pixel: yi, xi, pair_id, value (fitted phase), slope."""
    ready(stack.sparkSession)
    most = F.broadcast(stack.agg(F.max(F.abs(by)).alias("__most")))  # one row

    def run(table: pa.Table) -> pa.Table:
        t = Tile(table, "pair_id")
        scale = max(float(table.column("__most")[0].as_py() or 0), 1e-12)
        x = t.of_sample(by).astype(float) / scale
        z = t.dense("re") + 1j * t.dense("im")
        c0, c1 = pixels.trend_baseline(z, t.dense("corr"), x)
        fit = (c0[:, None] if intercept else 0) + (c1[:, None] * x if slope else 0) + np.zeros_like(z.real)
        fit[~np.isfinite(z)] = np.nan
        out = _long(t, fit, t.samples, "pair_id", "value")
        ok = np.isfinite(fit).ravel()
        return out.append_column("slope", pa.array(np.repeat(c1 / scale, len(x))[ok]))

    return per_tile(stack.join(most), run, "yi int, xi int, pair_id int, value double, slope double", tile)


def trend1d_pairs(stack: DataFrame, max_refine: int = 9, tile: int = TILE) -> DataFrame:
    """Atmospheric screens by date of each pixel: yi, xi, d, value."""

    def run(table: pa.Table) -> pa.Table:
        t = Tile(table, "pair_id")
        days, ref, rep = t.dates()
        s = pixels.trend_pairs(t.dense("re") + 1j * t.dense("im"), t.dense("corr"), (t.of_sample("days")).astype(float), ref, rep, len(days), max_refine)
        return _long(t, s, days, "d", "value")

    return per_tile(stack, run, "yi int, xi int, d date, value double", tile)


def lstsq_baseline(stack: DataFrame, with_bpr: bool = True, tile: int = TILE) -> DataFrame:
    """Per-date phases of a per-pair trend, less its part along the baseline: yi, xi, d, value."""

    def run(table: pa.Table) -> pa.Table:
        t = Tile(table, "pair_id")
        days, ref, rep = t.dates()
        b = t.of_sample("bpr").astype(float) if with_bpr else None
        s = pixels.screens_of(t.dense("re") + 1j * t.dense("im"), t.dense("corr"), ref, rep, len(days), None if b is None else b / max(np.abs(b).max(), 1e-12))
        return _long(t, s, days, "d", "value")

    return per_tile(stack, run, "yi int, xi int, d date, value double", tile)


def velocity_seasonal(stack: DataFrame, max_refine: int = 3, tile: int = TILE) -> DataFrame:
    """Pair velocity with an annual part taken out: yi, xi, velocity, rmse."""
    ready(stack.sparkSession)
    least = F.broadcast(stack.where("dt <> 0").agg(F.min(F.abs("dt")).alias("__min")))  # one row

    def run(table: pa.Table) -> pa.Table:
        t = Tile(table, "pair_id")
        ref, rep = ((t.of_sample(c).astype("datetime64[D]").astype(float)) / 365.25 for c in ("ref", "rep"))
        s, c = np.sin(2 * np.pi * ref) - np.sin(2 * np.pi * rep), np.cos(2 * np.pi * ref) - np.cos(2 * np.pi * rep)
        v, r = pixels.velocity_seasonal(t.dense("re") + 1j * t.dense("im"), t.dense("corr"), t.of_sample("dt").astype(float), s, c, float(table.column("__min")[0].as_py()), max_refine)
        ok = np.isfinite(v)
        return pa.table({"yi": pa.array(t.py[ok].astype(np.int32)), "xi": pa.array(t.px[ok].astype(np.int32)), "velocity": v[ok], "rmse": r[ok]})

    return per_tile(stack.join(least), run, "yi int, xi int, velocity double, rmse double", tile)


def stl_decompose(series: DataFrame, step_days: int = 7, period: int = 52, robust: bool = False, tile: int = TILE) -> DataFrame:
    """Nearest resampling of each pixel's series to a regular step, then STL: yi, xi, d, trend, seasonal, resid."""

    def run(table: pa.Table) -> pa.Table:
        t = Tile(table, "d")
        days = t.samples.astype("datetime64[D]")
        grid = np.arange(days[0], days[-1] + np.timedelta64(1, "D"), np.timedelta64(step_days, "D"))
        near = np.abs((days[None, :] - grid[:, None]).astype(float)).argmin(1)
        parts = stl.decompose(t.dense("value")[:, near], period, robust=robust)
        base = _long(t, parts[0], grid, "d", "trend")
        ok = np.isfinite(parts[0]).ravel()
        return base.append_column("seasonal", pa.array(parts[1].ravel()[ok])).append_column("resid", pa.array(parts[2].ravel()[ok]))

    return per_tile(series, run, "yi int, xi int, d date, trend double, seasonal double, resid double", tile)


class Raster:
    """One group's rows as a rectangle."""

    def __init__(self, table: pa.Table):
        self.y, self.x = (table.column(c).to_numpy().astype(np.int64) for c in ("yi", "xi"))
        self.y0, self.x0 = self.y.min(), self.x.min()
        self.shape = (int(self.y.max() - self.y0) + 1, int(self.x.max() - self.x0) + 1)
        self.table = table

    def grid(self, name: str) -> np.ndarray:
        out = np.full(self.shape, np.nan)
        out[self.y - self.y0, self.x - self.x0] = self.table.column(name).to_numpy(zero_copy_only=False).astype(float)
        return out

    def rows(self, **grids: np.ndarray) -> dict[str, np.ndarray]:
        ok = np.isfinite(next(iter(grids.values())))
        y, x = np.nonzero(ok)
        return {"yi": (y + self.y0).astype(np.int32), "xi": (x + self.x0).astype(np.int32)} | {k: g[ok] for k, g in grids.items()}


def per_raster(df: DataFrame, fn: Callable[[Raster], dict[str, np.ndarray]], columns: str, key: str = "pair_id") -> DataFrame:
    """``fn`` over whole rasters, one a group: a solver that needs the whole plane needs it in one task."""
    kind = dict(df.dtypes)[key]

    def run(table: pa.Table, _: dict) -> pa.Table:
        cols = fn(Raster(table))
        n = len(next(iter(cols.values())))
        return pa.table({key: table.column(key).combine_chunks().take(pa.array(np.zeros(n, np.int64)))} | {k: pa.array(v) for k, v in cols.items()})

    return keyed(df, [key], run, f"{key} {kind}, {columns}")


def with_halo(df: DataFrame, tile: int, halo: int) -> DataFrame:
    """Every row once for each tile whose margin of ``halo`` pixels holds it (at most 4 for halo <= tile / 2)."""
    near = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + o) / tile) for o in (-halo, 0, halo))))
    return df.withColumn("ty", F.explode(near("yi"))).withColumn("tx", F.explode(near("xi")))


def goldstein(df: DataFrame, size: int = 32, threshold: float = 0.5, tile: int = 128) -> DataFrame:
    """Adaptive filter of (re, im, corr) by pair on tiles with a margin: pair_id, yi, xi, re, im."""
    ready(df.sparkSession)
    halo = size + 2

    def run(table: pa.Table, key: dict) -> pa.Table:
        pair, ty, tx = (key[k] for k in ("pair_id", "ty", "tx"))
        r = Raster(table)
        # patches lie on one lattice for all tiles: pad to a multiple of half a patch
        half = size // 2
        py, px = int(r.y0 % half), int(r.x0 % half)
        z = np.pad(r.grid("re") + 1j * r.grid("im"), ((py, 0), (px, 0)), constant_values=np.nan)
        c = np.pad(r.grid("corr"), ((py, 0), (px, 0)), constant_values=np.nan)
        out = raster.goldstein(z, c, size, threshold)[py:, px:]
        y, x = np.nonzero(np.isfinite(out))
        own = ((y + r.y0) // tile == ty) & ((x + r.x0) // tile == tx)
        y, x = y[own], x[own]
        return pa.table({"pair_id": pa.array(np.full(len(y), pair, np.int32)), "yi": pa.array((y + r.y0).astype(np.int32)), "xi": pa.array((x + r.x0).astype(np.int32)), "re": out[y, x].real, "im": out[y, x].imag})

    return keyed(with_halo(df, tile, halo), ["pair_id", "ty", "tx"], run, "pair_id int, yi int, xi int, re double, im double")


def unwrap2d(df: DataFrame, weighted: bool = True, link: bool = False, min_size: int = 4) -> DataFrame:
    """Spatial unwrapping of (value, corr) by pair: pair_id, yi, xi, value, component."""

    def run(r: Raster) -> dict[str, np.ndarray]:
        u = raster.unwrap(r.grid("value"), r.grid("corr") if weighted else None)
        lab = raster.components(np.isfinite(u))
        if link:
            u = raster.link(u, min_size)
        return r.rows(value=u, component=lab.astype(np.int32))

    return per_raster(df, run, "yi int, xi int, value double, component int")


def unwrap2d_chunk(df: DataFrame, tile: int = 512, overlap: int = 16) -> DataFrame:
    """The same by tiles with a margin that is cut off; tiles are not reconciled."""
    ready(df.sparkSession)

    def run(table: pa.Table, key: dict) -> pa.Table:
        pair, ty, tx = (key[k] for k in ("pair_id", "ty", "tx"))
        r = Raster(table)
        rows = r.rows(value=raster.unwrap(r.grid("value"), r.grid("corr")))
        own = (rows["yi"] // tile == ty) & (rows["xi"] // tile == tx)
        return pa.table({"pair_id": pa.array(np.full(int(own.sum()), pair, np.int32))} | {k: pa.array(v[own]) for k, v in rows.items()})

    return keyed(with_halo(df, tile, overlap), ["pair_id", "ty", "tx"], run, "pair_id int, yi int, xi int, value double")


def conncomp(df: DataFrame, key: str = "pair_id") -> DataFrame:
    """4-connected components of the valid pixels of each raster, the largest 1."""
    return per_raster(df, lambda r: r.rows(value=np.where(np.isfinite(g := r.grid("value")), raster.components(np.isfinite(g)), np.nan)), "yi int, xi int, value double", key).withColumnRenamed("value", "component").withColumn("component", F.col("component").cast("int"))


def discontinuity(df: DataFrame, limit: float = 2.0, width: int = 3, votes: int = 50) -> DataFrame:
    """Valid pixels of each raster outside a band around the strongest line of large gradients."""

    def run(r: Raster) -> dict[str, np.ndarray]:
        g = r.grid("value")
        return r.rows(value=np.where(raster.discontinuity(g, limit, width, votes), g, np.nan))

    return per_raster(df, run, "yi int, xi int, value double")
