"""Options of the operators that no registered query sets."""

import numpy as np
import pytest

from sarstack.operators import bursts, trend


@pytest.mark.parametrize("method, want", [("median", 0.1), ("mean", np.angle(np.exp(1j * np.array([0.1, 0.1, 0.1, 0.1, 3.0])).mean()))])
def test_offset_of_an_overlap(spark, method, want):
    step = [0.1, 0.1, 0.1, 0.1, 3.0]
    rows = [(1, b, y, x, b * step[y]) for b in (0, 1) for y in range(5) for x in range(4)]
    df = spark.createDataFrame(rows, "pair_id int, burst int, yi int, xi int, value double")
    got = {r.burst: r.offset for r in bursts.fit(df, method=method, min_row=1, min_rows=1, min_pixels=1, min_inliers=1).collect()}
    assert got[0] == 0 and got[1] == pytest.approx(want, abs=6e-4)


def test_window_trend_follows_weights(spark):
    rng = np.random.default_rng(3)
    rows = [(1, y, x, float(y), float(x), float(rng.normal()), float(rng.integers(0, 4))) for y in range(9) for x in range(6)]
    df = spark.createDataFrame(rows, "pair_id int, yi int, xi int, fy double, fx double, value double, w double")
    a = np.array(rows)
    for r in trend.trend2d_window(df, ["fy", "fx"], ["pair_id"], 5, weight="w").collect():
        n = a[(abs(a[:, 1] - r.yi) <= 2) & (abs(a[:, 2] - r.xi) <= 2) & (a[:, 6] > 0)]
        if len(n) < 8:
            assert r.trend is None
            continue
        q = np.sqrt(n[:, 6])
        c = np.linalg.lstsq(np.c_[np.ones(len(n)), n[:, 3:5]] * q[:, None], n[:, 5] * q, rcond=None)[0]
        assert r.trend == pytest.approx(c @ [1, r.fy, r.fx], abs=1e-6)


@pytest.mark.parametrize("wrapped", [True, False])
def test_align_removes_ramps(spark, wrapped):
    rows = [(1, b, y, x, 0.4 * b + 0.004 * b * x) for b in range(3) for y in range(5 * b, 5 * b + 10) for x in range(150)]
    rows += [(1, 9, 500, x, 0.7) for x in range(5)]  # an island stays
    df = spark.createDataFrame(rows, "pair_id int, burst int, yi int, xi int, value double")
    limits = {"min_rows": 3, "min_inliers": 3}
    ramps = {r.burst: r.ramp for r in bursts.fit_ramp(df, wrapped=wrapped).collect()}
    assert ramps == {0: 0.0, 1: 0.004, 2: 0.008, 9: 0.0}
    out = bursts.align(df, wrapped=wrapped, degree=1, **limits)
    got = bursts.overlaps(out).selectExpr("max(abs(v2 - v1)) as worst", "count(*) as n").first()
    assert got.n == 1500 and got.worst < 2e-3
    assert {r.value for r in out.where("burst = 9").collect()} == {0.7}
    flat = bursts.overlaps(bursts.align(df, wrapped=wrapped, **limits)).selectExpr("max(abs(v2 - v1)) as worst").first()
    assert flat.worst > 0.2  # offsets alone leave the ramp
    assert bursts.fit_ramp(df, wrapped=wrapped, min_extent=200).count() == 0
    with pytest.raises(ValueError):
        bursts.align(df, degree=2)


def test_esd_angles_are_solved_and_removed(spark):
    rng = np.random.default_rng(5)
    base = {(y, x): rng.uniform(-3, 3) for y in range(20) for x in range(8)}
    shift = {(d, b): 0.0 if d == 0 or b == 0 else float(rng.uniform(-1, 1)) for d in range(3) for b in range(3)}
    rows = [(d, b, y, x, np.exp(1j * (base[y, x] + 0.2 * b * x + shift[d, b]))) for d in range(3) for b in range(3) for y in range(5 * b, 5 * b + 10) for x in range(8)]
    df = spark.createDataFrame([(d, b, y, x, float(z.real), float(z.imag), "k") for d, b, y, x, z in rows], "d int, burst int, yi int, xi int, re double, im double, extra string")
    before = bursts.esd(df, 10).selectExpr("max(abs(angle)) as worst").first().worst
    out = bursts.esd_align(df, 10)
    assert out.columns == df.columns and out.count() == df.count()
    assert before > 0.1 and bursts.esd(out, 10).selectExpr("max(abs(angle)) as worst").first().worst < 1e-6
    want = {(d, b, y, x): z * np.exp(-1j * shift[d, b]) for d, b, y, x, z in rows}
    assert all(abs(complex(r.re, r.im) - want[r.d, r.burst, r.yi, r.xi]) < 1e-6 for r in out.collect())
    assert bursts.esd_align(df, 10_000).select("re").exceptAll(df.select("re")).count() == 0  # no overlap is large enough
