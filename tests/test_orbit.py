import numpy as np

from sarstack.kernels import orbit
from sarstack.operators.preprocess import to_radar


def circle():
    t = np.arange(0, 200, 10.0)
    w, r = 0.00106, 7071000.0
    p = np.stack([r * np.cos(w * (t - 100)), np.zeros_like(t), r * np.sin(w * (t - 100))], 1)
    v = np.stack([-r * w * np.sin(w * (t - 100)), np.zeros_like(t), r * w * np.cos(w * (t - 100))], 1)
    return t, p, v


def test_see_and_locate_are_inverse():
    t, p, v = circle()
    at = np.array([50.3, 99.9, 133.3])
    pos, vel = orbit.hermite(t, p, v, at)
    rng, h = np.array([820_000.0, 850_000.0, 900_000.0]), np.array([0.0, 300.0, 1500.0])
    for right in (True, False):
        g = orbit.locate(pos, vel, rng, h, right)
        ea, eb = orbit.A + h, orbit.B + h
        assert np.allclose((g[:, 0] ** 2 + g[:, 1] ** 2) / ea**2 + g[:, 2] ** 2 / eb**2, 1)
        got_t, got_r = orbit.see(t, p, v, g)
        assert np.allclose(got_t, at, atol=1e-5) and np.allclose(got_r, rng, atol=1e-3)


def test_points_out_of_the_pass_are_missing(spark):
    t, p, v = circle()
    states = spark.createDataFrame([(float(a), *map(float, b), *map(float, c)) for a, b, c in zip(t, p, v, strict=True)], "t double, px double, py double, pz double, vx double, vy double, vz double")
    pts = spark.createDataFrame([(1, 6378000.0, 300000.0, 10.0), (2, -6378000.0, 0.0, 10.0), (3, 0.0, 0.0, 6356000.0)], "id int, x double, y double, z double")
    got = {r.id: r for r in to_radar(pts, states, 0.0, 1700.0, 700000.0, 64e6).collect()}
    assert abs(got[1].azi / 1700 - 100) < 1 and got[1].rng > 0 and got[3].azi is None
