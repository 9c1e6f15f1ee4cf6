"""Selection, alignment and arithmetic of grids keyed by integer lattice indices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phase import wrap
from .keys import pixel


def sel(df: DataFrame, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None, keys: dict[str, list] | None = None) -> DataFrame:
    """Rows within inclusive index ranges and key lists; plain predicates, so a scan prunes by them."""
    if y:
        df = df.where(F.col("yi").between(*y))
    if x:
        df = df.where(F.col("xi").between(*x))
    for k, values in (keys or {}).items():
        df = df.where(F.col(k).isin(values))
    return df


def crop(df: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    return sel(df, (y0, y1), (x0, x1))


def isel(df: DataFrame, dim: str, positions: list[int]) -> DataFrame:
    """Rows at positions of the sorted distinct values of a dimension (negative: from the end).

    The dimension's distinct values (dates, pairs, bursts) are few; they are
    ranked, not the rows.
    """
    values = df.select(dim).distinct()
    up, down = Window.orderBy(dim), Window.orderBy(F.col(dim).desc())
    at = values.withColumn("__p", F.row_number().over(up) - 1).withColumn("__n", -F.row_number().over(down))
    return df.join(at.where(F.col("__p").isin(positions) | F.col("__n").isin(positions)).select(dim), dim, "left_semi")


def where(df: DataFrame, mask: DataFrame, value: str = "value") -> DataFrame:
    """``value`` where the mask (yi, xi, keep) holds, NULL elsewhere."""
    at = pixel(df, mask)  # a mask without batch columns holds for every raster
    j = df.join(mask.select(*at, "keep"), at, "left")
    return j.withColumn(value, F.when(F.coalesce("keep", F.lit(False)), F.col(value))).drop("keep")


def polygon_mask(df: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Rows whose pixel centre (x, y) lies in a polygon: even-odd rule, one expression an edge."""
    x, y, inside = F.col("xi").cast("double"), F.col("yi").cast("double"), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inside = inside != crosses
    return df.where(inside)


def combine_first(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """a's value, b's where a has none."""
    j = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys, "full")
    return j.select(*keys, F.coalesce("__a", "__b").alias(value))


def arithmetic(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column], keys: list[str], wrapped: bool = False, group: str = "burst") -> DataFrame:
    """a op b on equal keys; a burst that b lacks passes unchanged, a pixel that b lacks goes, one without a value stays missing."""
    has = b.select(group).distinct().withColumn("__has", F.lit(True))
    j = a.join(has, group, "left").join(b.select(*keys, F.col("value").alias("__b")), keys, "left")
    v = F.when(F.col("__has").isNull(), F.col("value")).otherwise(op(F.col("value"), F.col("__b")))
    return j.where("__has is null or __b is not null").select(*keys, (wrap(v) if wrapped else v).alias("value"))


def compare(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column], keys: list[str]) -> DataFrame:
    """Boolean grid over the keys that both have."""
    return a.join(b.select(*keys, F.col("value").alias("__b")), keys).select(*keys, op(F.col("value"), F.col("__b")).alias("value"))


def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Variables of both over the keys that both have."""
    return a.join(b, keys)


def align_nearest(df: DataFrame, fy: float, fx: float, target: DataFrame, value: str = "value") -> DataFrame:
    """``value`` of the nearest source pixel for every target pixel; source = target / factor.

    A regular grid's nearest neighbour is a computed index, so this is an
    equi-join.
    """
    t = target.select("yi", "xi", F.rint(F.col("yi") / fy).cast("int").alias("__y"), F.rint(F.col("xi") / fx).cast("int").alias("__x"))
    s = df.select(F.col("yi").alias("__y"), F.col("xi").alias("__x"), value)
    return t.join(s, ["__y", "__x"], "left").drop("__y", "__x")


def interp_linear(df: DataFrame, fy: float, fx: float, target: DataFrame, value: str = "value") -> DataFrame:
    """Bilinear value at source position target / factor; NULL unless all taps with weight exist."""
    py, px = F.col("yi") / fy, F.col("xi") / fx
    t = target.select("yi", "xi", py.alias("py"), px.alias("px"))
    taps = F.array(*(F.struct((F.floor("py") + a).cast("int").alias("ty"), (F.floor("px") + b).cast("int").alias("tx"), ((F.col("py") - F.floor("py")) if a else 1 - (F.col("py") - F.floor("py"))).alias("wy"), ((F.col("px") - F.floor("px")) if b else 1 - (F.col("px") - F.floor("px"))).alias("wx")) for a in (0, 1) for b in (0, 1)))
    e = t.select("yi", "xi", F.explode(taps).alias("k")).select("yi", "xi", F.col("k.ty").alias("ty"), F.col("k.tx").alias("tx"), (F.col("k.wy") * F.col("k.wx")).alias("w")).where("w > 0")
    s = df.select(F.col("yi").alias("ty"), F.col("xi").alias("tx"), F.col(value).alias("v"))
    j = e.join(s, ["ty", "tx"], "left")
    return j.groupBy("yi", "xi").agg(F.when(F.count("v") == F.count("*"), F.sum(F.col("w") * F.col("v"))).alias(value))


def neighbors(df: DataFrame, h: int, w: int, lattice: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Valid pixels in an odd h x w window less its centre; 0 becomes NULL, as do borders.

    Two passes of running counts over index ranges: columns, then rows. Each
    value of ``keys`` is a grid of its own over the whole lattice.
    """
    hy, hx = h // 2, w // 2
    cells = lattice.select("yi", "xi")
    cells = cells.crossJoin(df.select(*keys).distinct()) if keys else cells
    full = cells.join(df.select(*keys, "yi", "xi", F.lit(1).alias("v")), [*keys, "yi", "xi"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    col = full.withColumn("s", F.sum("v").over(Window.partitionBy(*keys, "xi").orderBy("yi").rangeBetween(-hy, hy)))
    box = col.withColumn("n", F.sum("s").over(Window.partitionBy(*keys, "yi").orderBy("xi").rangeBetween(-hx, hx)))
    ext = lattice.agg(F.min("yi").alias("y0"), F.max("yi").alias("y1"), F.min("xi").alias("x0"), F.max("xi").alias("x1"))
    d = box.join(F.broadcast(ext))  # ext is one row
    inner = F.col("yi").between(F.col("y0") + hy, F.col("y1") - hy) & F.col("xi").between(F.col("x0") + hx, F.col("x1") - hx)
    n = F.col("n") - F.col("v")
    return d.select(*keys, "yi", "xi", F.when(inner & (n > 0), n).alias("n"))


def morphology(df: DataFrame, op: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """erosion, dilation, opening or closing of a complete boolean grid (yi, xi, v) by a 3 x 3 cross.

    Each value of ``keys`` is a grid of its own. Outside the grid is False.
    """
    if op == "opening":
        return morphology(morphology(df, "erosion", keys), "dilation", keys)
    if op == "closing":
        return morphology(morphology(df, "dilation", keys), "erosion", keys)
    wy, wx = Window.partitionBy(*keys, "xi").orderBy("yi"), Window.partitionBy(*keys, "yi").orderBy("xi")
    cells = [F.col("v")] + [F.coalesce(f("v").over(w), F.lit(False)) for w in (wy, wx) for f in (F.lag, F.lead)]
    out = cells[0]
    for c in cells[1:]:
        out = out & c if op == "erosion" else out | c
    return df.select(*keys, "yi", "xi", out.alias("v"))


def polyval(df: DataFrame, coeffs: DataFrame, x: Column) -> DataFrame:
    """ramp * x + offset of each row's burst and pair; 0 where the coefficients lack it."""
    return df.join(coeffs, [c for c in coeffs.columns if c not in ("ramp", "offset")], "left").withColumn("poly", F.coalesce(F.col("ramp") * x + F.col("offset"), F.lit(0.0))).drop("ramp", "offset")


def pixels(df: DataFrame, names: list[str], dy: float, dx: float) -> DataFrame:
    """Export rows: coordinates and variables, without pixels that have none."""
    return df.where(F.coalesce(*names).isNotNull()).select((F.col("yi") * dy).alias("y"), (F.col("xi") * dx).alias("x"), *names)


def rgb(df: DataFrame, bands: list[str], lo: float = 0.02, hi: float = 0.98, gamma: float = 1.0, brightness: float = 2.0) -> DataFrame:
    """Bytes of a colour composite: each band stretched between two quantiles."""
    q = df.agg(*(F.percentile(b, F.lit(p)).alias(f"__{b}_{n}") for b in bands for n, p in (("lo", lo), ("hi", hi))))
    d = df.join(F.broadcast(q))  # one row
    out = []
    for b in bands:
        a, z = F.col(f"__{b}_lo"), F.col(f"__{b}_hi")
        s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(b) - a) / F.nullif(z - a, F.lit(0.0))))
        out.append(F.floor(F.least(F.lit(1.0), F.pow(s, gamma) * brightness) * 255).cast("int").alias(f"{b}_byte"))
    return d.select("yi", "xi", *out)


def geojson(df: DataFrame, value: str, dy: float, dx: float, decimals: int = 3) -> DataFrame:
    """A Feature a pixel: its rectangle and the rounded value, as JSON text."""
    x0, x1, y0, y1 = ((F.col("xi") - 0.5) * dx, (F.col("xi") + 0.5) * dx, (F.col("yi") - 0.5) * dy, (F.col("yi") + 0.5) * dy)
    pt = lambda a, b: F.array(F.round(a, 6), F.round(b, 6))
    ring = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(F.round(value, decimals).alias("value")).alias("properties")))
    return df.where(F.col(value).isNotNull()).select("yi", "xi", text.alias("feature"))
