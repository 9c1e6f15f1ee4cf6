import numpy as np
import pytest

from sarstack.api import Stack
from sarstack.operators.preprocess import robust_plane, tide
from sarstack.plans import fixtures as fx
from sarstack.sources import export

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stack(spark):
    return Stack(fx.slc(spark, SF), "complex", acquisitions=fx.acquisitions(spark, SF))


def test_chain_from_scenes_to_velocity(stack):
    pairs = stack.pairs(stack.baseline(days=3)).filter(days=2).coherent(0.2)
    assert {r.days for r in pairs.df.select("days").distinct().collect()} <= {1, 2}
    series = pairs.angle().unwrap1d().lstsq()
    out = series.displacement_los().velocity().collect()
    assert out and any(r.velocity is not None for r in out)


def test_known_velocity_is_recovered(stack):
    """The fixture's phase moves by 0.02 (user % 7 - 3) rad a day, so pairs show its negative."""
    got = stack.pairs(stack.baseline(days=3, cleanup=False)).velocity().where("n >= 20").collect()
    err = [abs(r.velocity / 365.25 + 0.02 * ((5 * r.yi + r.xi) % 7 - 3)) for r in got]
    assert len(err) >= 8 and np.median(err) < 0.02


def test_wrapped_phase_refuses_real_fits(stack):
    with pytest.raises(TypeError):
        stack.pairs(stack.baseline(days=3)).angle().trend2d(["bpr"])


def test_interferogram_detrend_and_goldstein(stack):
    i = stack.interferogram(stack.baseline(days=2), (0.6, 0.5))
    assert i.detrend1d_baseline().df.count() > 0 and i.goldstein(size=4, tile=16).df.columns


def test_tide_has_the_right_size():
    lat, lon = np.zeros(48), np.zeros(48)
    up = tide(lat, lon, 60310 + np.arange(48) / 24)[:, 2]
    assert 0.15 < up.max() - up.min() < 0.7 and abs(up.mean()) < 0.2


def test_robust_plane_ignores_outliers():
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0, 10, (2, 200))
    v = 1 + 0.5 * x - 0.2 * y + 0.01 * rng.normal(size=200)
    v[:30] += 50
    assert np.allclose(robust_plane(x, y, v), [1, 0.5, -0.2], atol=0.05)
    assert np.isnan(robust_plane(x[:5], y[:5], v[:5])).all()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.5), (1, 2, 2.5)], "yi int, xi int, v double")
    export.to_vtk(df, str(tmp_path / "a.vtk"), ["v"])
    text = (tmp_path / "a.vtk").read_text()
    assert "DIMENSIONS 3 2 1" in text and "1.5 nan nan" in text and "nan nan 2.5" in text
    assert export.archive(df, str(tmp_path / "a.zip")).endswith("a.zip") and (tmp_path / "a.zip").stat().st_size > 0
    with pytest.raises(ValueError):
        export.to_vtk(df.where("yi > 5"), str(tmp_path / "b.vtk"), ["v"])
