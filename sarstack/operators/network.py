"""Pair networks: generation, filters, cleanup, triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(pairs: DataFrame) -> DataFrame:
    """Stable pair numbers in the order of (ref, rep).

    The table has at most one row for each two dates, so its order passes
    through one task.
    """
    return pairs.withColumn("pair_id", F.row_number().over(Window.orderBy("ref", "rep")).cast("int"))


def baseline(acq: DataFrame, days: int, meters: float | None = None, invert: bool = False, min_connections: int = 2, max_connections: int | None = None, cleanup: bool = True) -> DataFrame:
    """Pairs of dates at most ``days`` (and ``meters``) apart.

    A range join by buckets of ``days``: each earlier date meets the dates of
    its own bucket and the next one, so the plan is an equi-join.
    """
    width = max(1, days)
    bucket = F.floor(F.datediff("d", F.lit("1970-01-01").cast("date")) / width)
    a = acq.select(F.col("d").alias("d1"), F.col("bpr").alias("b1"), F.explode(F.array(bucket, bucket + 1)).alias("k"))
    b = acq.select(F.col("d").alias("d2"), F.col("bpr").alias("b2"), bucket.alias("k"))
    gap = F.datediff("d2", "d1")
    j = a.join(b, "k").where((gap > 0) & (gap <= days))
    if meters is not None:
        j = j.where(F.abs(F.col("b1") - F.col("b2")) <= meters)
    ref, rep = ("2", "1") if invert else ("1", "2")
    p = j.select(F.col(f"d{ref}").alias("ref"), F.col(f"d{rep}").alias("rep"), F.round(f"b{ref}", 2).alias("ref_baseline"), F.round(f"b{rep}", 2).alias("rep_baseline"))
    p = p.withColumn("pair", F.concat_ws(" ", F.date_format("ref", "yyyy-MM-dd"), F.date_format("rep", "yyyy-MM-dd"))).withColumn("baseline", F.col("rep_baseline") - F.col("ref_baseline")).withColumn("duration", F.datediff("rep", "ref"))
    if max_connections is not None:
        p = limit_connections(p, max_connections)
    if cleanup:
        p = clean(p, min_connections)
    return numbered(p)


def filter_pairs(pairs: DataFrame, days: int | None = None, meters: float | None = None, dates: list[str] | None = None, pair: list[str] | None = None, count: int | None = None, min_connections: int = 2, cleanup: bool = True) -> DataFrame:
    """Pairs within limits, without given dates or pairs, then the network cleanup."""
    p = pairs
    if days is not None:
        p = p.where(F.col("duration") <= days)
    if meters is not None:
        p = p.where(F.abs("baseline") <= meters)
    if dates:
        p = p.where(~F.col("ref").cast("string").isin(dates) & ~F.col("rep").cast("string").isin(dates))
    if pair:
        p = p.where(~F.concat_ws(" ", F.col("ref").cast("string"), F.col("rep").cast("string")).isin(pair))
    if cleanup:
        return clean(p, max(min_connections, count or 0))
    return drop_dates(p, rare_dates(p, count)) if count else p


def ends(pairs: DataFrame) -> DataFrame:
    """One row for each end of each pair: date, as_ref."""
    return pairs.select(F.explode(F.array(F.struct(F.col("ref").alias("d"), F.lit(1).alias("r")), F.struct(F.col("rep").alias("d"), F.lit(0).alias("r")))).alias("x")).select("x.d", "x.r")


def degrees(pairs: DataFrame) -> DataFrame:
    """d, n (pairs), n_ref, n_rep."""
    return ends(pairs).groupBy("d").agg(F.count("*").alias("n"), F.sum("r").alias("n_ref"), F.sum(1 - F.col("r")).alias("n_rep"))


def rare_dates(pairs: DataFrame, count: int) -> DataFrame:
    return degrees(pairs).where(F.col("n") < count).select("d")


def drop_dates(pairs: DataFrame, dates: DataFrame) -> DataFrame:
    """Pairs with neither end in ``dates``."""
    return pairs.join(dates, pairs.ref == dates.d, "left_anti").join(dates, pairs.rep == dates.d, "left_anti")


def bad_dates(pairs: DataFrame, min_connections: int) -> DataFrame:
    """Dates with too few pairs, or inside the network and only ever ref or only ever rep."""
    deg = degrees(pairs)
    lim = deg.agg(F.min("d").alias("first"), F.max("d").alias("last"))
    one_sided = ((F.col("n_rep") == 0) & (F.col("d") != F.col("first"))) | ((F.col("n_ref") == 0) & (F.col("d") != F.col("last")))
    return deg.join(F.broadcast(lim)).where((F.col("n") < min_connections) | one_sided).select("d")  # lim is one row


def clean(pairs: DataFrame, min_connections: int = 2) -> DataFrame:
    """Drop bad dates until none is left.

    The loop runs on the driver over the pair table alone, which is bounded by
    the square of the number of dates, never by pixels.
    """
    rows = pairs.select("ref", "rep").collect()
    left = [(r.ref, r.rep) for r in rows]
    while left:
        n: dict = {}
        for a, b in left:
            n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
        refs, reps = {a for a, _ in left}, {b for _, b in left}
        first, last = min(n), max(n)
        bad = {d for d, c in n.items() if c < min_connections} | (refs - reps - {first}) | (reps - refs - {last})
        if not bad:
            break
        left = [(a, b) for a, b in left if a not in bad and b not in bad]
    spark = pairs.sparkSession
    kept = spark.createDataFrame(sorted(set(left)), "k_ref date, k_rep date")
    return pairs.join(kept, (pairs.ref == kept.k_ref) & (pairs.rep == kept.k_rep), "left_semi")


def limit_connections(pairs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` shortest pairs out of and into each date, dates in order, each rule seeing the last's result."""
    rows = sorted((r.ref, r.rep) for r in pairs.select("ref", "rep").distinct().collect())
    keep = set(rows)
    for d in sorted({x for p in rows for x in p}):
        for side in (0, 1):
            mine = sorted((p for p in keep if p[side] == d), key=lambda p: (abs((p[1] - p[0]).days), p))
            keep -= set(mine[most:])
    kept = pairs.sparkSession.createDataFrame(sorted(keep), "k_ref date, k_rep date")
    return pairs.join(kept, (pairs.ref == kept.k_ref) & (pairs.rep == kept.k_rep), "left_semi")


def nearest_outgoing(pairs: DataFrame, most: int) -> DataFrame:
    """The outgoing rule alone, as a rank."""
    w = Window.partitionBy("ref").orderBy("duration", "rep")
    return pairs.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most).drop("rk")


def triplets(pairs: DataFrame) -> DataFrame:
    """Long pairs that split at a date: p13 (a, c), p12 (a, b), p23 (b, c)."""
    p = lambda n, a, b: pairs.select(F.col("pair_id").alias(n), F.col("ref").alias(a), F.col("rep").alias(b))
    return p("p12", "a", "b").join(p("p23", "b", "c"), "b").join(p("p13", "a", "c"), ["a", "c"]).select("p12", "p23", "p13", "a", "b", "c")
