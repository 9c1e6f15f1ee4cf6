"""Scene catalogues, burst identifiers, orbit matching, tile and byte-range arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_burst(burst: Column) -> dict[str, Column]:
    """Parts of ``path_burst_subswath``; NULL where the form is another."""
    at = lambda i: F.nullif(F.regexp_extract(burst, r"^(\d+)_(\d+)_(IW\d|EW\d)$", i), F.lit(""))
    return {"path": at(1).cast("int"), "number": at(2).cast("int"), "subswath": at(3)}


def format_burst(path: Column, number: Column, subswath: Column) -> Column:
    """``path_burst_subswath``, path and burst with leading zeros up to three and six digits, longer ones whole."""
    pad = lambda v, n: F.lpad(v.cast("string"), F.greatest(F.length(v.cast("string")), F.lit(n)), "0")
    return F.concat_ws("_", pad(path, 3), pad(number, 6), subswath)


def search(scenes: DataFrame, start=None, stop=None, direction: str | None = None, polarization: str | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Catalogue rows by time, direction, polarization and bounding box (west, south, east, north)."""
    d = scenes
    if start is not None:
        d = d.where(F.col("time") >= F.lit(start))
    if stop is not None:
        d = d.where(F.col("time") < F.lit(stop))
    if direction:
        d = d.where(F.upper("direction") == direction.upper())
    if polarization:
        d = d.where(F.col("polarization") == polarization)
    if bbox:
        w, s, e, n = bbox
        d = d.where((F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s))
    return d


def match_orbits(scenes: DataFrame, orbits: DataFrame) -> DataFrame:
    """Best orbit file of each scene (id, mission, t): one that covers t, precise before restituted, then the newest.

    ``orbits``: file, mission, kind, start, stop, made (a number, date or
    timestamp). Of files with one mission, start and stop only the best can
    win, so it is found first, by partial aggregation; and each time of a
    mission is looked up once. Only these distinct intervals and times meet, by
    an equi-join on days of validity; a scene takes its time's file. Rows of
    one id share the best file of them all.
    """
    made = F.col("made")
    if (kind := dict(orbits.dtypes)["made"]).startswith(("date", "timestamp")):
        made = F.expr(f"timestampdiff(MICROSECOND, {'timestamp' if kind == 'timestamp' else 'timestamp_ntz'}'1970-01-01', made)")
    # the least of these is the best: without ``made`` last, NaN first
    rank = F.struct(F.when(F.col("kind") == "POEORB", 0).otherwise(1).alias("k"), made.isNull().alias("none"), (~F.isnan(made.cast("double"))).alias("real"), (-made).alias("age"), "file", "kind")
    best = orbits.groupBy("mission", "start", "stop").agg(F.min(rank).alias("best"))
    days = best.withColumn("day", F.explode(F.sequence(F.to_date("start"), F.to_date("stop"))))
    times = scenes.select("mission", "t").distinct().withColumn("day", F.to_date("t"))
    at = times.join(days, ["mission", "day"]).where("t >= start and t <= stop").groupBy("mission", "t").agg(F.min("best").alias("best"))
    own = F.min("best").over(Window.partitionBy("id"))
    got = scenes.select("id", "mission", "t").join(at, ["mission", "t"], "left").select("id", F.when(F.col("id").isNotNull(), own).alias("best"))
    return got.select("id", "best.file", "best.kind")


def merge_regions(chunks: DataFrame, gap: int = 1 << 20) -> DataFrame:
    """Byte regions of each file: chunks (file, start, size) no more than ``gap`` apart become one."""
    run = Window.partitionBy("file").orderBy("start", "size")
    end = F.max(F.col("start") + F.col("size")).over(run.rowsBetween(Window.unboundedPreceding, -1))
    d = chunks.withColumn("new", F.coalesce((F.col("start") - end > gap).cast("int"), F.lit(1)))
    d = d.withColumn("region", F.sum("new").over(run))
    return d.groupBy("file", "region").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("size")) - F.min("start")).alias("size"), F.count("*").alias("chunks")).drop("region")


def degree_tiles(boxes: DataFrame) -> DataFrame:
    """One-degree tiles (lat, lon of the south-west corner) that each box (id, west, south, east, north) needs, with their names."""
    span = lambda a, b: F.explode(F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int")))
    d = boxes.select("id", "west", "east", span(F.col("south"), F.col("north")).alias("lat")).select("id", "lat", span(F.col("west"), F.col("east")).alias("lon"))
    ns = F.concat(F.when(F.col("lat") < 0, "S").otherwise("N"), F.lpad(F.abs("lat").cast("string"), 2, "0"))
    ew = F.concat(F.when(F.col("lon") < 0, "W").otherwise("E"), F.lpad(F.abs("lon").cast("string"), 3, "0"))
    return d.withColumn("tile", F.concat(ns, ew))


def slippy_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """x, y of the web-map tile at a position."""
    n = float(1 << zoom)
    la = F.radians(lat)
    return F.floor((lon + 180) / 360 * n).cast("int"), F.floor((1 - F.ln(F.tan(la) + 1 / F.cos(la)) / F.pi()) / 2 * n).cast("int")


def ref_rep(scenes: DataFrame, reference) -> DataFrame:
    """Reference scene of each burst and the list of its repeats, in order of time."""
    is_ref = F.to_date("time") == F.lit(reference).cast("date")
    return scenes.groupBy("burst").agg(F.max(F.when(is_ref, F.col("scene"))).alias("ref"), F.transform(F.array_sort(F.collect_list(F.when(~is_ref, F.struct("time", "scene")))), lambda x: x["scene"]).alias("reps"))
