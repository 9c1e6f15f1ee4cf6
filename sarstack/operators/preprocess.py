"""Geometry of scene preparation: orbits, baselines, phase ramps, resampling, tides, offset fits."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import ready


def orbit_at(times: DataFrame, states: DataFrame) -> DataFrame:
    """Positions at times by cubic Hermite interpolation between the two states around.

    ``times``: id, orbit, t (seconds). ``states``: orbit, t, px..pz, vx..vz.
    Intervals are cut to buckets of 10 s, so the range join is an equi-join.
    """
    w = Window.partitionBy("orbit").orderBy("t")
    axes = "xyz"
    nxt = {f"t1": F.lead("t").over(w)} | {f"{k}{a}1": F.lead(f"{k}{a}").over(w) for k in "pv" for a in axes}
    s = states.withColumns(nxt).where("t1 is not null").withColumnRenamed("t", "t0")
    s = s.withColumn("k", F.explode(F.sequence(F.floor(F.col("t0") / 10), F.floor(F.col("t1") / 10))))
    j = times.withColumn("k", F.floor(F.col("t") / 10)).join(s, ["orbit", "k"]).where((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")))
    h = F.col("t1") - F.col("t0")
    u = (F.col("t") - F.col("t0")) / h
    h00, h10, h01, h11 = (1 + 2 * u) * (1 - u) * (1 - u), u * (1 - u) * (1 - u), u * u * (3 - 2 * u), u * u * (u - 1)
    return j.select("id", "t", *((h00 * F.col(f"p{a}") + h10 * h * F.col(f"v{a}") + h01 * F.col(f"p{a}1") + h11 * h * F.col(f"v{a}1")).alias(a) for a in axes))


def baselines(pairs: DataFrame) -> DataFrame:
    """Parallel and perpendicular baseline of satellites (x1..z1, x2..z2) seen from a ground point (gx, gy, gz).

    The perpendicular part is signed by the side on which the second satellite
    lies from the line of sight, in the plane of sight and nadir.
    """
    v = lambda n: [F.col(f"{a}{n}") for a in "xyz"]
    one, two, g = v(1), v(2), [F.col(c) for c in ("gx", "gy", "gz")]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    sight = [p - q for p, q in zip(g, one, strict=True)]
    r = F.sqrt(dot(sight, sight))
    los = [p / r for p in sight]
    b = [p - q for p, q in zip(two, one, strict=True)]
    par = dot(b, los)
    up = [p / F.sqrt(dot(one, one)) for p in one]
    side = dot([p - dot(up, los) * q for p, q in zip(up, los, strict=True)], b)
    perp = F.sqrt(F.greatest(dot(b, b) - par * par, F.lit(0.0)))
    return pairs.withColumn("b_par", par).withColumn("b_perp", F.when(side < 0, -perp).otherwise(perp))


def reramp_phase(eta: Column, slant: Column, steer: Column, velocity: Column, wavelength: Column, ka: Column, centre: Column) -> Column:
    """Quadratic azimuth phase of a burst: -pi kt (eta - eta0)^2 - 2 pi f (eta - eta0).

    kt = ks ka / (ka - ks) with the steering rate ks = 2 v steer / wavelength;
    ``centre`` is the Doppler centroid f, eta0 = -f / ka, ``slant`` the change of
    ka with range as a factor.
    """
    ks = 2 * velocity * steer / wavelength
    k = ka * slant
    kt = ks * k / (k - ks)
    d = eta + centre / k
    return -pi * kt * d * d - 2 * pi * centre * d


TAPS = {
    "nearest": (0, 1), "linear": (0, 2), "cubic": (-1, 4), "lanczos": (-3, 8),
}


def tap_weight(method: str, x: Column) -> Column:
    """Weight of a tap at distance x."""
    a = F.abs(x)
    if method == "nearest":
        return F.lit(1.0)
    if method == "linear":
        return F.greatest(1 - a, F.lit(0.0))
    if method == "cubic":  # Keys, a = -0.75
        c = -0.75
        near, far = ((c + 2) * a - (c + 3)) * a * a + 1, ((c * a - 5 * c) * a + 8 * c) * a - 4 * c
        return F.when(a <= 1, near).when(a < 2, far).otherwise(0.0)
    s = F.when(a < 1e-9, F.lit(1.0)).otherwise(4 * F.sin(pi * a) * F.sin(pi * a / 4) / (pi * pi * a * a))
    return F.when(a < 4, s).otherwise(0.0)


def resample(df: DataFrame, target: DataFrame, method: str = "linear", value: str = "value") -> DataFrame:
    """``value`` of a grid at real positions: target has yi, xi, py, px.

    Each target row asks for its taps by an equi-join. A target is NULL where
    any tap with weight is missing.
    """
    first, n = TAPS[method]
    base = (lambda p: F.floor(p + 0.5)) if method == "nearest" else F.floor
    t = target.select("yi", "xi", "py", "px", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("a"))
    t = t.select("yi", "xi", "py", "px", "a", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("b"))
    ty, tx = (base(F.col("py")) + F.col("a")).cast("int"), (base(F.col("px")) + F.col("b")).cast("int")
    t = t.select("yi", "xi", ty.alias("ty"), tx.alias("tx"), (tap_weight(method, F.col("py") - ty) * tap_weight(method, F.col("px") - tx)).alias("w")).where(F.abs("w") > 1e-12)
    s = df.select(F.col("yi").alias("ty"), F.col("xi").alias("tx"), F.col(value).alias("v"))
    g = t.join(s, ["ty", "tx"], "left").groupBy("yi", "xi").agg(F.count("v").alias("have"), F.count("*").alias("want"), F.sum(F.col("w") * F.col("v")).alias("sum"), F.sum("w").alias("tot"))
    return g.select("yi", "xi", F.when(F.col("have") == F.col("want"), F.col("sum") / F.nullif(F.col("tot"), F.lit(0.0))).alias(value))


def pack_scaled(v: Column, scale: float, kind: str = "int", missing: int | None = None) -> Column:
    """Scaled integers for storage; missing values become the fill."""
    return F.coalesce(F.rint(v * scale), F.lit(missing)).cast(kind)


def unpack_scaled(v: Column, scale: float, missing: int | None = None) -> Column:
    return F.when(v != missing, v / scale) if missing is not None else v / scale


# --- solid Earth tide ---------------------------------------------------------

#: Degree-2 Love and Shida numbers, GM ratios to the Earth, mean radius.
H2, L2 = 0.6078, 0.0847
RATIO_SUN, RATIO_MOON, RADIUS = 332946.0, 0.01230002, 6378136.6


def _sun_moon(mjd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of Sun and Moon in the Earth-fixed frame, in metres, by low-precision series."""
    t = (mjd - 51544.5) / 36525
    rad = np.radians
    eps = rad(23.43929111)
    m = rad(357.5256 + 35999.049 * t)
    lon = rad(282.94) + m + rad(6892 / 3600) * np.sin(m) + rad(72 / 3600) * np.sin(2 * m)
    r = (149.619 - 2.499 * np.cos(m) - 0.021 * np.cos(2 * m)) * 1e9
    sun = np.stack([r * np.cos(lon), r * np.sin(lon) * np.cos(eps), r * np.sin(lon) * np.sin(eps)], -1)
    l0, l, lp, f, d = (rad(a + b * t) for a, b in ((218.31617, 481267.88088), (134.96292, 477198.86753), (357.52543, 35999.04944), (93.27283, 483202.01873), (297.85027, 445267.11135)))
    s = lambda k: rad(k / 3600)
    lon = l0 + s(22640) * np.sin(l) + s(769) * np.sin(2 * l) - s(4586) * np.sin(l - 2 * d) + s(2370) * np.sin(2 * d) - s(668) * np.sin(lp) - s(412) * np.sin(2 * f) - s(212) * np.sin(2 * l - 2 * d) - s(206) * np.sin(l + lp - 2 * d) + s(192) * np.sin(l + 2 * d)
    lat = s(18520) * np.sin(f + lon - l0 + s(412) * np.sin(2 * f) + s(541) * np.sin(lp)) - s(526) * np.sin(f - 2 * d)
    r = (385000 - 20905 * np.cos(l) - 3699 * np.cos(2 * d - l) - 2956 * np.cos(2 * d) - 570 * np.cos(2 * l)) * 1e3
    x, y, z = r * np.cos(lon) * np.cos(lat), r * np.sin(lon) * np.cos(lat), r * np.sin(lat)
    moon = np.stack([x, y * np.cos(eps) - z * np.sin(eps), y * np.sin(eps) + z * np.cos(eps)], -1)
    gst = rad((280.46061837 + 360.98564736629 * (mjd - 51544.5)) % 360)
    c, sn = np.cos(gst), np.sin(gst)
    turn = lambda p: np.stack([c * p[..., 0] + sn * p[..., 1], -sn * p[..., 0] + c * p[..., 1], p[..., 2]], -1)
    return turn(sun), turn(moon)


def tide(lat: np.ndarray, lon: np.ndarray, mjd: np.ndarray) -> np.ndarray:
    """East, north, up displacement in metres: degree-2 in-phase response to Sun and Moon."""
    la, lo = np.radians(lat), np.radians(lon)
    up = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], -1)
    east = np.stack([-np.sin(lo), np.cos(lo), np.zeros_like(lo)], -1)
    north = np.stack([-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la)], -1)
    out = np.zeros(up.shape)
    for body, ratio in zip(_sun_moon(mjd), (RATIO_SUN, RATIO_MOON), strict=True):
        dist = np.linalg.norm(body, axis=-1)
        unit = body / dist[..., None]
        c = (unit * up).sum(-1)
        k = ratio * RADIUS**4 / dist**3
        d = (k * H2 * (1.5 * c * c - 0.5))[..., None] * up + (3 * k * L2 * c)[..., None] * (unit - c[..., None] * up)
        out += np.stack([(d * a).sum(-1) for a in (east, north, up)], -1)
    return out


def solid_tide(points: DataFrame) -> DataFrame:
    """points (id, lat, lon, mjd) with east, north, up of the solid Earth tide."""
    ready(points.sparkSession)
    src = points.select("id", F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("mjd").cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = tide(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon", "mjd")))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(d[:, i]) for i in range(3))], names=["id", "east", "north", "up"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, east double, north double, up double")


def robust_plane(x: np.ndarray, y: np.ndarray, v: np.ndarray, rank: int = 3, tune: float = 1.5, rounds: int = 50) -> np.ndarray:
    """Coefficients of 1, x, y, x y (the first ``rank`` + ...) by Huber-weighted least squares.

    The scale is 1.4826 times the median absolute residual. For a table of
    patch offsets: a few thousand rows on the driver. NaN below 8 points.
    """
    ok = np.isfinite(v)
    if ok.sum() < 8:
        return np.full(rank, np.nan)
    a = np.stack([np.ones_like(x), x, y, x * y], 1)[ok][:, :rank]
    b, w = v[ok], np.ones(int(ok.sum()))
    c = np.zeros(rank)
    for _ in range(rounds):
        s = np.sqrt(w)[:, None]
        new = np.linalg.lstsq(a * s, b * s[:, 0], rcond=None)[0]
        r = np.abs(b - a @ new)
        scale = 1.4826 * np.median(r) * tune
        w = np.where(r <= scale, 1.0, scale / np.maximum(r, 1e-300)) if scale > 0 else w
        if np.abs(new - c).max() < 1e-10:
            break
        c = new
    return new


#: States of one pass; more are an error, never cut off.
MAX_STATES = 100_000


def to_radar(points: DataFrame, states: DataFrame, start: float, prf: float, near_range: float, rng_samp_rate: float) -> DataFrame:
    """points (id, x, y, z in metres, Earth-fixed) with the line ``azi`` and sample ``rng`` at which an orbit sees them.

    ``states``: t, px..pz, vx..vz of one pass, a few hundred rows at most; they go out with the code.
    """
    from ..kernels import orbit

    ready(points.sparkSession)
    rows = np.array([tuple(r) for r in states.select("t", "px", "py", "pz", "vx", "vy", "vz").orderBy("t").limit(MAX_STATES + 1).collect()], float)
    if len(rows) > MAX_STATES:
        raise ValueError(f"an orbit of more than {MAX_STATES} states: give those of one pass")
    half = 299792458.0 / 2 / rng_samp_rate
    src = points.select("id", *(F.col(c).cast("double") for c in "xyz"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
            t, r = orbit.see(rows[:, 0], rows[:, 1:4], rows[:, 4:7], g)
            ok = np.isfinite(t)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array((t - start) * prf, mask=~ok), pa.array((r - near_range) / half, mask=~ok)], names=["id", "azi", "rng"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, azi double, rng double")
