"""The queries that take the whole of their tables, against plain Python or DuckDB over all rows."""

import math
from collections import Counter

import numpy as np
import pytest

from sarstack.operators import kernels
from sarstack.operators import preprocess as pre
from sarstack.plans import fixtures as fx
from sarstack.plans.queries import QUERIES
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_orbit_match_takes_every_file(spark, con):
    scenes = con.sql("SELECT o_orderkey, o_custkey % 2, o_orderdate + INTERVAL 6 HOUR FROM orders").fetchall()
    files = con.sql("SELECT l_orderkey * 10 + l_linenumber, l_suppkey % 2, l_quantity >= 10, l_shipdate, l_shipdate + INTERVAL 30 HOUR, l_extendedprice FROM lineitem").fetchall()
    want = {}
    for i, mission, t in scenes:
        own = [(late, -made, file) for file, m, late, start, stop, made in files if m == mission and start <= t <= stop]
        want[i] = min(own)[2] if own else None
    assert {r.id: r.file for r in QUERIES["orbit_match_all"](spark, SF).collect()} == want


def test_corrcoef_has_every_channel(spark, con):
    x = np.array([r[0] for r in con.sql("SELECT embedding FROM embeddings").fetchall()], float)
    got = np.full((x.shape[1],) * 2, np.nan)
    for r in QUERIES["corrcoef_channels_all"](spark, SF).collect():
        got[r.i, r.j] = r.r
    assert np.allclose(got, np.corrcoef(x.T), atol=0.00501)


@pytest.mark.parametrize("name", ["unwrap2d", "unwrap2d_link", "unwrap2d_chunk", "connected_components", "discontinuity_mask", "interferogram_all"])
def test_every_pair(spark, name):
    pairs = {r.pair_id for r in QUERIES["pair_formation"](spark, SF).select("pair_id").distinct().collect()}
    assert {r.pair_id for r in QUERIES[name](spark, SF).select("pair_id").distinct().collect()} == pairs


@pytest.mark.parametrize("name", ["unwrap2d", "connected_components"])
def test_every_pixel_of_every_pair(spark, name):
    want = {(r.pair_id, r.yi, r.xi) for r in QUERIES["pair_formation"](spark, SF).collect()}
    assert {(r.pair_id, r.yi, r.xi) for r in QUERIES[name](spark, SF).collect()} == want


def test_link_has_every_pixel_of_components_of_four_or_more(spark):
    rows = QUERIES["connected_components"](spark, SF).collect()
    size = Counter((r.pair_id, r.component) for r in rows)
    want = {(r.pair_id, r.yi, r.xi) for r in rows if size[r.pair_id, r.component] >= 4}
    assert {(r.pair_id, r.yi, r.xi) for r in QUERIES["unwrap2d_link"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["unwrap2d", "unwrap2d_link", "unwrap2d_chunk"])
def test_unwrapped_differs_by_whole_turns(spark, name):
    wrapped = {(r.pair_id, r.yi, r.xi): math.atan2(r.im, r.re) for r in QUERIES["pair_formation"](spark, SF).collect()}
    for r in QUERIES[name](spark, SF).collect():
        turns = (r.value - wrapped[r.pair_id, r.yi, r.xi]) / (2 * math.pi)
        assert abs(turns - round(turns)) < 1e-4


@pytest.mark.parametrize("name", ["neighbors_all", "morphology_opening_all"])
def test_every_date(spark, con, name):
    assert QUERIES[name](spark, SF).select("d").distinct().count() == con.sql("SELECT count(DISTINCT cast(ts AS DATE)) FROM events").fetchall()[0][0]


def test_elevation_has_short_baselines(spark):
    want = {(r.pair_id, r.yi, r.xi): r.bpr == 0 for r in fx.stack(spark, SF).select("pair_id", "yi", "xi", "bpr").collect()}
    got = {(r.pair_id, r.yi, r.xi): r.elevation is None for r in QUERIES["elevation_all"](spark, SF).collect()}
    assert got == want


@pytest.fixture
def at_the_edge(spark, monkeypatch):
    """two pixels of one pair: phases pi and (pi - 0.25) / 3."""
    a = [math.pi, (math.pi - 0.25) / 3]
    rows = spark.createDataFrame([(5, 0, i, 5 * math.cos(v), 5 * math.sin(v), 0.9) for i, v in enumerate(a)], "pair_id int, yi int, xi int, re double, im double, corr double")
    monkeypatch.setattr(fx, "stack", lambda s, d: rows)


@pytest.mark.parametrize("name, column, xi", [("wrapped_arithmetic_all", "value", 1), ("polyval_subtract_all", "value", 0), ("reduce_circular_all", "mean", 0)])
def test_rows_at_pi_and_in_sparse_pixels_stay(spark, at_the_edge, name, column, xi):
    got = {r.xi: (r[f"{column}_sin"], r[f"{column}_cos"]) for r in QUERIES[name](spark, SF).collect()}
    assert set(got) == {0, 1} and np.allclose(got[xi], (0, -1), atol=1e-6)


@pytest.mark.parametrize("name, sql", [
    ("subtract_screens_all", "SELECT count(*) FROM stack"),
    ("triplet_closure_all", "SELECT count(*) FROM stack a JOIN stack b ON a.rep = b.ref AND a.yi = b.yi AND a.xi = b.xi JOIN stack c ON c.ref = a.ref AND c.rep = b.rep AND c.yi = a.yi AND c.xi = a.xi"),
])
def test_every_row(spark, con, name, sql):
    assert QUERIES[name](spark, SF).count() == con.sql(fx.SQL + sql).fetchall()[0][0]


def test_trend1d_pairs_refines_as_far_as_the_operator(spark):
    want = kernels.trend1d_pairs(fx.stack(spark, SF), max_refine=9)
    got = {(r.yi, r.xi, r.d): r.value for r in QUERIES["trend1d_pairs"](spark, SF).collect()}
    assert got == {(r.yi, r.xi, r.d): round(r.value, 4) + 0.0 for r in want.collect()}


def lanczos(grid: dict, py: float, px: float) -> float | None:
    """The sum of taps over the sum of weights, None where a tap is missing."""
    weight = lambda x: np.sinc(x) * np.sinc(x / 4) if abs(x) < 4 else 0.0
    taps = [(y, x, weight(py - y) * weight(px - x)) for y in range(math.floor(py) - 3, math.floor(py) + 5) for x in range(math.floor(px) - 3, math.floor(px) + 5)]
    taps = [t for t in taps if abs(t[2]) > 1e-12]
    if any((y, x) not in grid for y, x, _ in taps):
        return None
    return sum(w * grid[y, x] for y, x, w in taps) / sum(w for _, _, w in taps)


def test_resample_lanczos_interpolates(spark):
    sf = "/root/testdata/sf0.01"
    grid = {(r.yi, r.xi): r.ele for r in fx.geometry(fx.slc(spark, sf)).collect()}
    got = {(r.yi, r.xi): r.value for r in QUERIES["resample_lanczos"](spark, sf).collect()}
    want = {(y, x): lanczos(grid, y + 0.25, x + 0.5 * (x % 2)) for y, x in grid}
    assert got == {k: None if v is None else pytest.approx(v, abs=2e-6) for k, v in want.items()}
    assert sum(v is not None and abs(v - grid[k]) > 0.1 for k, v in got.items()) > 20


def test_lanczos_in_both_directions(spark):
    grid = {(y, x): float((7 * y + 3 * x * x) % 50) for y in range(14) for x in range(14)}
    target = {(y, x): (y + 0.3, x + 0.6) for y, x in grid}
    out = pre.resample(spark.createDataFrame([(*k, v) for k, v in grid.items()], "yi int, xi int, value double"), spark.createDataFrame([(*k, *v) for k, v in target.items()], "yi int, xi int, py double, px double"), "lanczos")
    got = {(r.yi, r.xi): r.value for r in out.collect()}
    want = {k: lanczos(grid, *v) for k, v in target.items()}
    assert got == {k: None if v is None else pytest.approx(v, abs=1e-9) for k, v in want.items()}
    assert sum(v is not None for v in got.values()) == 49
