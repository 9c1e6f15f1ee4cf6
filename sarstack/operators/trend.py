"""Spatial and temporal trends by normal equations and periodograms."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from .keys import pixel


def solve(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """Cramer-free elimination of a small symmetric system, as column expressions.

    Meant for at most three unknowns; larger ones go through ``solve_staged``.
    """
    n = len(b)
    a, b = [row[:] for row in a], b[:]
    for i in range(n):
        for r in range(i + 1, n):
            f = a[r][i] / F.nullif(a[i][i], F.lit(0.0))
            a[r] = [a[r][c] - f * a[i][c] for c in range(n)]
            b[r] = b[r] - f * b[i]
    x: list[Column] = [F.lit(None)] * n
    for i in reversed(range(n)):
        s = b[i]
        for c in range(i + 1, n):
            s = s - a[i][c] * x[c]
        x[i] = s / F.nullif(a[i][i], F.lit(0.0))
    return x


def solve_staged(df: DataFrame, a: list[list[str]], b: list[str], out: list[str]) -> DataFrame:
    """The same elimination with one projection a step, so expressions stay small."""
    n = len(b)
    keep = [c for c in df.columns if c not in {*sum(a, []), *b}]
    d = df.select(*keep, *(F.col(a[i][j]).alias(f"__a{i}{j}") for i in range(n) for j in range(n)), *(F.col(b[i]).alias(f"__b{i}") for i in range(n)))
    for i in range(n):
        cols = {f"__f{r}": F.col(f"__a{r}{i}") / F.nullif(F.col(f"__a{i}{i}"), F.lit(0.0)) for r in range(i + 1, n)}
        d = d.withColumns(cols) if cols else d
        upd = {f"__a{r}{c}": F.col(f"__a{r}{c}") - F.col(f"__f{r}") * F.col(f"__a{i}{c}") for r in range(i + 1, n) for c in range(i, n)} | {f"__b{r}": F.col(f"__b{r}") - F.col(f"__f{r}") * F.col(f"__b{i}") for r in range(i + 1, n)}
        d = d.withColumns(upd) if upd else d
    for i in reversed(range(n)):
        s = F.col(f"__b{i}")
        for c in range(i + 1, n):
            s = s - F.col(f"__a{i}{c}") * F.col(out[c])
        d = d.withColumn(out[i], s / F.nullif(F.col(f"__a{i}{i}"), F.lit(0.0)))
    return d.select(*keep, *out)


def trend2d(df: DataFrame, regressors: list[str], keys: list[str], value: str = "value", weight: str | None = None, ridge: float = 1e-10) -> DataFrame:
    """Degree-1 fit of ``value`` on standardised regressors for each group; adds ``trend``.

    Standardisation uses all rows. Two aggregations (statistics; moments with
    partial sums) and a join of one row a group back. NULL for groups with
    fewer rows than twice the coefficients.
    """
    st = df.agg(*(f.alias(f"__{n}_{r}") for r in regressors for n, f in (("m", F.avg(r)), ("s", F.stddev_pop(r)))))
    d = df.join(F.broadcast(st))  # one row
    feats = ["__one", *(f"__z_{r}" for r in regressors)]
    d = d.withColumn("__one", F.lit(1.0)).withColumns({f"__z_{r}": (F.col(r) - F.col(f"__m_{r}")) / (F.col(f"__s_{r}") + 1e-10) for r in regressors})
    w = F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0)
    n = len(feats)
    use = d.where(F.col(value).isNotNull())
    cell = lambda i, j: F.sum(w * F.col(feats[min(i, j)]) * F.col(feats[max(i, j)])) + (ridge if i == j else 0.0)
    mom = use.groupBy(*keys).agg(F.count("*").alias("__n"), *(cell(i, j).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)), *(F.sum(w * F.col(feats[i]) * F.col(value)).alias(f"b{i}") for i in range(n)))
    sol = solve_staged(mom, [[f"a{min(i, j)}_{max(i, j)}" for j in range(n)] for i in range(n)], [f"b{i}" for i in range(n)], [f"c{i}" for i in range(n)])
    fit = F.col("c0")
    for i in range(1, n):
        fit = fit + F.col(f"c{i}") * F.col(feats[i])
    out = d.join(sol, keys)
    return out.withColumn("trend", F.when((F.col("__n") >= 2 * n) & F.col(value).isNotNull(), fit)).select(*df.columns, "trend")


def velocity_series(series: DataFrame, min_valid: int = 5) -> DataFrame:
    """c1 of c0 + c1 t + c2 sin 2 pi t + c3 cos 2 pi t by pixel, and the residuals' rms.

    ``series`` has yi, xi, t (years) and value. One aggregation of moments;
    the residual sum of squares follows from the moments too.
    """
    t = F.col("t")
    d = series.where("value is not null").select(*pixel(series), F.lit(1.0).alias("f0"), t.alias("f1"), F.sin(2 * pi * t).alias("f2"), F.cos(2 * pi * t).alias("f3"), "value")
    m = d.groupBy(*pixel(series)).agg(F.count("*").alias("n"), F.sum(F.col("value") ** 2).alias("yy"), *(F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"a{i}{j}") for i in range(4) for j in range(i, 4)), *(F.sum(F.col(f"f{i}") * F.col("value")).alias(f"b{i}") for i in range(4)))
    m = m.withColumns({f"k{i}": F.col(f"b{i}") for i in range(4)})
    s = solve_staged(m, [[f"a{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)], [f"b{i}" for i in range(4)], [f"c{i}" for i in range(4)])
    rss = F.col("yy") - sum((F.col(f"c{i}") * F.col(f"k{i}") for i in range(4)), F.lit(0.0))
    ok = F.col("n") >= min_valid
    return s.select(*pixel(series), F.when(ok, F.col("c1")).alias("velocity"), F.when(ok, F.sqrt(F.greatest(rss, F.lit(0.0)) / F.col("n"))).alias("rmse"), "n")


def velocity_pairs(stack: DataFrame, max_refine: int = 3, bins: int = 16) -> DataFrame:
    """Rate that maximises |sum w e^{i(phase - v dt)}| by pixel, zooming ``max_refine`` times.

    Each pixel's samples become one array; a level scores its candidates by an
    aggregate over that array, so there is one shuffle and no row explosion.
    """
    use = stack.where(((F.col("re") != 0) | (F.col("im") != 0)) & (F.col("corr") > 0))
    lo = stack.where("dt <> 0").agg(F.min(F.abs("dt")).alias("__min"))
    p = use.groupBy(*pixel(stack)).agg(F.collect_list(F.struct(F.atan2("im", "re").alias("a"), F.col("corr").alias("w"), "dt")).alias("s"), F.count("*").alias("n")).where("n >= 4")
    d = p.join(F.broadcast(lo)).withColumn("lo", -(pi / 2) / F.col("__min")).withColumn("step", F.lit(2.0) * (pi / 2) / F.col("__min") / bins)  # one row
    d = d.withColumn("best", F.struct(F.lit(-1.0).alias("S"), F.lit(0.0).alias("v")))
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))
    for _ in range(1 + max_refine):

        def score(v: Column) -> Column:
            add = lambda acc, x: F.struct((acc["c"] + x["w"] * F.cos(x["a"] - v * x["dt"])).alias("c"), (acc["s"] + x["w"] * F.sin(x["a"] - v * x["dt"])).alias("s"))
            return F.aggregate("s", zero, add, lambda acc: acc["c"] * acc["c"] + acc["s"] * acc["s"])

        scored = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct(F.round(score(F.col("lo") + F.col("step") * i), 6).alias("S"), (F.col("lo") + F.col("step") * i).alias("v")))
        # the first candidate with the largest sum; an earlier level's best stays on a tie
        top = F.aggregate(scored, F.col("best"), lambda acc, x: F.when(x["S"] > acc["S"], x).otherwise(acc))
        d = d.withColumn("best", top).withColumn("lo", F.col("best.v") - F.col("step")).withColumn("step", 2 * F.col("step") / bins)
    r = lambda x: F.atan2(F.sin(x["a"] - F.col("best.v") * x["dt"]), F.cos(x["a"] - F.col("best.v") * x["dt"]))
    num = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x["w"] * r(x) * r(x))
    den = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x["w"])
    return d.select(*pixel(stack), F.col("best.v").alias("velocity"), F.sqrt(num / F.nullif(den, F.lit(0.0))).alias("rmse"), "n")


def trend2d_window(df: DataFrame, regressors: list[str], keys: list[str], size: int, value: str = "value", min_valid: int = 8, weight: str | None = None) -> DataFrame:
    """Degree-1 fit in a square window around every pixel, by running sums of the moments.

    Moments are summed along rows, then along columns, over index ranges.
    With ``weight`` they are weighted; a pixel without one, or with zero,
    takes no part and does not count as valid.
    """
    h = size // 2
    feats = ["__one", *regressors]
    n = len(feats)
    d = df.withColumn("__one", F.lit(1.0))
    w = F.col(weight) if weight else F.lit(1.0)
    ok = F.col(value).isNotNull() & (w > 0)
    cols = {f"a{i}_{j}": F.when(ok, w * F.col(feats[i]) * F.col(feats[j])) for i in range(n) for j in range(i, n)} | {f"b{i}": F.when(ok, w * F.col(feats[i]) * F.col(value)) for i in range(n)}
    cols |= {"__n": F.when(ok, F.lit(1.0))}
    d = d.withColumns(cols)
    for part, order in (("xi", "yi"), ("yi", "xi")):
        run = Window.partitionBy(*keys, part).orderBy(order).rangeBetween(-h, h)
        d = d.withColumns({c: F.sum(c).over(run) for c in cols})
    d = d.withColumns({f"a{i}_{i}": F.col(f"a{i}_{i}") + 1e-9 for i in range(n)})
    s = solve_staged(d, [[f"a{min(i, j)}_{max(i, j)}" for j in range(n)] for i in range(n)], [f"b{i}" for i in range(n)], [f"c{i}" for i in range(n)])
    fit = F.col("c0")
    for i in range(1, n):
        fit = fit + F.col(f"c{i}") * F.col(feats[i])
    return s.withColumn("trend", F.when((F.col("__n") >= min_valid) & F.col(value).isNotNull(), fit)).select(*df.columns, "trend")
