import numpy as np
import pytest

from veriframe.functions import kernels as K
from veriframe.functions import schema as S

RNG = np.random.default_rng(3)


def test_schema_has_69_features():
    assert len(S.FEATURES) == 69 == len(set(S.FEATURES))
    assert abs(sum(S.WEIGHTS.values()) - 1) < 1e-12


def test_radial_profile_of_ones():
    assert np.allclose(K.radial_profile(np.ones((128, 128))), 1) and len(K.radial_profile(np.ones((100, 200)))) == 50


def test_slope_of_power_law_and_guards():
    r = np.arange(100)
    p = np.where(r > 0, 1 / np.maximum(r, 1), 1.0)
    slope, fit = K.spectral_slope(p)
    assert -1.5 < slope < -0.5 and fit > 0.9
    assert abs(K.spectral_slope(np.full(50, 2.0))[0]) < 0.3
    assert K.spectral_slope(np.ones(3)) == (0.0, 0.0) and K.high_frequency_ratio(np.zeros(9)) == 0 and K.spectral_falloff(np.ones(4)) == 0
    assert K.spectral_falloff(np.linspace(10, 1, 100)) < 1


def test_eigenvalues_known():
    assert np.allclose(K.eigenvalues(np.diag([5.0, 20, 10])), [20, 10, 5])
    assert np.allclose(K.eigen_ratios(np.array([100.0, 50, 10]))[:2], [2, 5])
    assert K.eigen_ratios(np.array([100.0, 0, 0]))[3] == pytest.approx(1)


def test_flat_image_hits_every_guard():
    f = K.features(K.Raster(np.full((128, 128, 3), 128, np.uint8)), tuple(S.GROUPS))
    assert all(np.isfinite(v) for v in f.values())
    assert f["patch_ratio_mean"] == 0 and f["noise_kurtosis"] == 0 and f["gradient_kurtosis"] == 0 and f["dct_boundary_ratio"] == 1 and f["ela_uniformity"] == 1
    assert f["texture_contrast"] == 0 and f["noise_ms_ratio_1_5"] == 1


@pytest.mark.parametrize("shape", [(1, 1), (5, 9), (40, 63), (70, 300), (257, 260)])
def test_any_size_is_finite_and_repeatable(shape):
    r = K.Raster(RNG.integers(0, 256, (*shape, 3), dtype=np.uint8))
    groups = tuple(g for g in S.GROUPS if g != "metadata")
    a, b = K.features(r, groups, 5), K.features(r, groups, 5)
    assert a == b and all(np.isfinite(v) for v in a.values()) and len(a) == 63


def test_band_shares_do_not_exceed_one():
    low, mid, high, both = K.band_features(K.Raster(RNG.integers(0, 256, (96, 96, 3), dtype=np.uint8)))
    assert 0 < low + mid + high < 1 and both == pytest.approx(mid + high)


def test_dct_is_orthonormal():
    g = RNG.normal(size=(16, 24))
    assert np.allclose((K.block_dct(g) ** 2).sum(), (g**2).sum())


def test_jpeg_keeps_flat_and_gets_better_with_quality():
    flat = np.full((20, 21, 3), 77, np.uint8)
    assert np.array_equal(K.jpeg_round_trip(flat, 80), flat)
    y, x = np.mgrid[0:64, 0:64]
    img = np.stack([x * 3 % 256, y * 2, (x + y) % 256], 2).astype(np.uint8)
    loss = [np.abs(img.astype(int) - K.jpeg_round_trip(img, q)).mean() for q in (30, 70, 95)]
    assert loss[0] > loss[1] > loss[2]


def test_area_resize_keeps_means():
    a = RNG.integers(0, 256, (80, 120, 3), dtype=np.uint8)
    b = K.area_resize(a, 40, 60)
    assert np.abs(b.astype(float) - a.reshape(40, 2, 60, 2, 3).mean((1, 3))).max() <= 0.5
    assert K.augmented(a, "small").shape == (64, 90, 3)


def test_blur_reflects_at_borders():
    assert K.mirrored(4, 3).tolist() == [3, 2, 1, 0, 1, 2, 3, 2, 1, 0]
    assert np.allclose(K.residual(np.full((5, 6), 9.0), 5.0), 0)


def test_laplacian_and_sobel_of_a_ramp():
    img = np.repeat((np.arange(20) * 5)[None, :, None], 12, 0).repeat(3, 2).astype(np.uint8)
    mean, _, _, lap, _ = K.gradient_features(K.Raster(img))
    assert mean == pytest.approx(40 * 18 / 20) and lap < 5


def test_resize_takes_the_whole_image():
    a = np.zeros((4, 8, 3), np.uint8)
    a[:, 4:] = 200
    out = K.resize_to_square(a, 2)
    assert out.shape == (2, 2, 3) and (out[:, 0] == 0).all() and (out[:, 1] == 200).all()
