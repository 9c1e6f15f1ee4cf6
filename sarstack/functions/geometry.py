"""Column expressions of radar and Earth geometry."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speed of light, WGS84 axes.
LIGHT = 299792458.0
WGS84_A, WGS84_B = 6378137.0, 6356752.31424518


def _clamp(v: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))


def incidence(azi: Column, rng: Column, ele: Column, near_range: Column, height_start: Column, height_end: Column, earth_radius: Column, rng_samp_rate: Column, num_lines: Column) -> Column:
    """Incidence angle on a sphere: the Earth angle by the law of cosines, then the law of sines."""
    slant = near_range + rng * (LIGHT / 2) / rng_samp_rate
    height = height_start + (height_end - height_start) * azi / (num_lines - 1)
    ground, sat = earth_radius + ele, earth_radius + height
    earth = F.acos(_clamp((ground * ground + sat * sat - slant * slant) / (2 * ground * sat)))
    return F.asin(_clamp(sat * F.sin(earth) / slant))


def los(phase: Column, wavelength: Column) -> Column:
    """Line-of-sight displacement of an unwrapped phase."""
    return -wavelength / (4 * pi) * phase


def elevation(phase: Column, inc: Column, slant: Column, wavelength: Column, baseline: Column, ref_height: Column) -> Column:
    """Height of an unwrapped phase for a perpendicular baseline."""
    return ref_height - wavelength * phase * slant * F.cos(inc) / F.nullif(4 * pi * baseline, F.lit(0.0))


def spread(start: Column, end: Column, i: Column, n: Column) -> Column:
    """Value i of n evenly spaced ones from start to end."""
    return start + (end - start) * i / F.nullif(n - 1, F.lit(0))


def utm_epsg(lat: Column, lon: Column) -> Column:
    """EPSG code of the UTM zone, north or south."""
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def geodetic_to_ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    """X, Y, Z in metres from degrees and height on WGS84."""
    e2 = 1 - (WGS84_B / WGS84_A) ** 2
    la, lo = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1 - e2) + h) * F.sin(la)


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude, height by the closed form with one parametric step."""
    e2 = 1 - (WGS84_B / WGS84_A) ** 2
    ep2 = (WGS84_A / WGS84_B) ** 2 - 1
    p = F.sqrt(x * x + y * y)
    beta = F.atan2(z * WGS84_A, p * WGS84_B)
    lat = F.atan2(z + ep2 * WGS84_B * F.pow(F.sin(beta), 3), p - e2 * WGS84_A * F.pow(F.cos(beta), 3))
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - n


def geocentric_radius(lat: Column) -> Column:
    """Distance of the ellipsoid's surface from the Earth's centre."""
    la = F.radians(lat)
    a, b = WGS84_A * F.cos(la), WGS84_B * F.sin(la)
    return F.sqrt((F.pow(WGS84_A * a, 2) + F.pow(WGS84_B * b, 2)) / (a * a + b * b))


def azimuth_radius(lat: Column, heading: Column) -> Column:
    """Radius of curvature of the ellipsoid along a heading in degrees."""
    e2 = 1 - (WGS84_B / WGS84_A) ** 2
    la, az = F.radians(lat), F.radians(heading)
    w2 = 1 - e2 * F.sin(la) * F.sin(la)
    n, m = WGS84_A / F.sqrt(w2), WGS84_A * (1 - e2) / F.pow(w2, 1.5)
    return 1 / (F.cos(az) * F.cos(az) / m + F.sin(az) * F.sin(az) / n)


def clock_to_timestamp(clock: Column) -> Column:
    """Timestamp of year * 1000 + day of year (from 0) + day's fraction."""
    year, day = F.floor(clock / 1000), F.pmod(clock, F.lit(1000.0))
    whole = F.floor(day)
    base = F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), whole.cast("int"))
    return F.timestamp_micros((F.unix_date(base).cast("bigint") * F.lit(86_400_000_000) + F.round((day - whole) * 86_400_000_000)).cast("bigint"))


def mjd(day: Column) -> Column:
    """Modified Julian day of a date."""
    return F.unix_date(day) + 40587


def path_number(orbit: Column) -> Column:
    """Relative orbit of an absolute one."""
    return (F.pmod(orbit - 73, F.lit(175)) + 1).cast("int")


def topo_phase(slant: Column, height: Column, baseline: Column, alpha: Column, sat_height: Column, earth_radius: Column, wavelength: Column) -> Column:
    """Flat-earth and topographic phase: -4 pi / wavelength times the range difference.

    ``baseline`` and ``alpha`` are the baseline's length and its angle above
    the horizontal at the reference satellite.
    """
    c, ret = earth_radius + sat_height, earth_radius + height
    cos_look = _clamp((slant * slant + c * c - ret * ret) / (2 * slant * c))
    look = F.acos(cos_look)
    along = F.sin(look - alpha)
    rho = F.sqrt(slant * slant + baseline * baseline - 2 * slant * baseline * along)
    return -4 * pi / wavelength * (rho - slant)
