"""Two bursts and two polarizations in one table give what each gives alone."""

import pytest
from pyspark.sql import functions as F

from sarstack.operators import aggregate, grid, kernels, trend
from sarstack.plans import fixtures

SF = "/root/testdata/sf0.001"


def same(a, b):
    show = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())
    return show(a) == show(b)


PAIR_OPS = {
    "lstsq": lambda t: kernels.lstsq(t),
    "unwrap1d": lambda t: kernels.unwrap1d(t),
    "trend1d_pairs": lambda t: kernels.trend1d_pairs(t),
    "lstsq_baseline": lambda t: kernels.lstsq_baseline(t),
    "goldstein": lambda t: kernels.goldstein(t, 4, 0.25, 16),
    "unwrap2d": lambda t: kernels.unwrap2d(t),
    "unwrap2d_chunk": lambda t: kernels.unwrap2d_chunk(t, 16, 4),
    "velocity_pairs": lambda t: trend.velocity_pairs(t),
    "coherent": lambda t: aggregate.coherent(t, 0.3).drop("mean_corr"),
    "threshold": lambda t: aggregate.threshold(t).select("pair_id", "yi", "xi", "re", "im", *[c for c in ("burst", "pol") if c in t.columns]),
    "where": lambda t: grid.where(t, t.where("yi % 2 = 0").select(*[c for c in ("burst", "pol") if c in t.columns], "yi", "xi").distinct().withColumn("keep", F.lit(True))),
}


@pytest.fixture(scope="module")
def stack(spark):
    out = fixtures.stack(spark, SF).withColumn("value", F.atan2("im", "re")).select("pair_id", "ref", "rep", "yi", "xi", "re", "im", "corr", "bpr", "days", "dt", "value").where("yi < 5")
    return out.cache()


@pytest.mark.parametrize("name", sorted(PAIR_OPS))
def test_rasters_of_a_batch_stay_apart(stack, name):
    op = PAIR_OPS[name]
    other = stack.withColumn("im", -F.col("im")).withColumn("value", F.col("value") / 2).withColumn("corr", F.col("corr") / 3)
    one = stack.withColumn("burst", F.lit(1)).withColumn("pol", F.lit("VV"))
    two = other.withColumn("burst", F.lit(2)).withColumn("pol", F.lit("VH"))
    got = op(one.unionByName(two))
    assert {"burst", "pol"} <= set(got.columns)
    assert same(got.where("burst = 1 and pol = 'VV'").drop("burst", "pol"), op(stack))
    assert same(got.where("burst = 2 and pol = 'VH'").drop("burst", "pol"), op(other))
