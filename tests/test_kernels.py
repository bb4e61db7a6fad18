"""Properties of the numpy kernels."""

import numpy as np
import pytest

from tallframe.operators import banks, kernels

RNG = np.random.Generator(np.random.PCG64(0))


@pytest.mark.parametrize("over", [1, 2, 4])
@pytest.mark.parametrize("n", [1000, 1001])
@pytest.mark.parametrize("make", [lambda o: banks.erb_bank(10, 50, 8000, o), lambda o: banks.linear_bank(10, 50, 8000, o), lambda o: banks.erb_bank(8, 100, 8000, o, "ferret")])
def test_squares_sum_to_one_and_analysis_inverts(make, n, over):
    h = banks.responses(make(over), n, 20000)
    np.testing.assert_allclose((h**2).sum(axis=0), 1, atol=1e-9)
    x = RNG.normal(size=n)
    np.testing.assert_allclose(kernels.collapsed(kernels.filtered(x, h), h), x, atol=1e-9)


def test_constant_q_has_unit_energy_inside():
    b = banks.constant_q_bank(20, 0.5, 200, 2)
    h, f = banks.responses(b, 4000, 400), banks.frequencies(4000, 400)
    inner = (f >= b.lobes[3][1]) & (f <= b.lobes[-4][1])
    assert np.mean((h**2).sum(axis=0)[inner]) == pytest.approx(1)
    assert banks.linear_control_bank(20, 0.5, 200, 2).lobes[1][1] > 10
    assert len(banks.linear_octave_control_bank(6, 10, 100).lobes) == 6


def test_envelope_of_a_sinusoid_is_flat():
    x = np.cos(2 * np.pi * 5 * np.arange(100) / 100)
    np.testing.assert_allclose(np.abs(kernels.analytic(x)), 1, atol=1e-9)
    np.testing.assert_allclose(kernels.analytic(x, sign=-1), np.conj(kernels.analytic(x)), atol=1e-9)


@pytest.mark.parametrize("shape", [(20, 16), (21, 15)])
def test_modulation_filters_invert(shape):
    coch = RNG.random(shape)
    filters = [kernels.modulation_filter(None, None, shape, 100, 24)]
    filters += [kernels.modulation_filter(r, s, shape, 100, 24, sign=k) for r in (2, 8) for s in (0.5, 2) for k in (1, -1)]
    np.testing.assert_allclose(kernels.demodulated(kernels.modulated(coch, filters), filters), coch, atol=1e-9)
    assert np.isrealobj(kernels.modulated(coch, filters)[1])


def test_temporal_and_spectral_filters_peak_at_one():
    assert np.abs(kernels.temporal_filter(8, 400, 100)).max() == pytest.approx(1)
    assert kernels.spectral_filter(2, 96, 24).max() == pytest.approx(1)
    assert kernels.temporal_filter(0, 10, 100).tolist() == [1] + [0] * 9
    with pytest.raises(ValueError):
        kernels.spectral_filter(13, 96, 24)


def test_cochleagram_inverts():
    x = RNG.normal(size=2000)
    b = banks.erb_bank(10, 50, 8000, 2)
    h = banks.responses(b, 2000, 20000)
    coch, f, rest = kernels.cochleagram(x, h, banks.centres(b), 20000, 400)
    assert coch.shape == (40, len(f)) and coch.min() >= 0
    np.testing.assert_allclose(kernels.waveform(coch, rest, h, 20000, 400), x, atol=1e-6)


def test_resampling_keeps_a_slow_sinusoid():
    t = np.arange(400) / 100
    y = kernels.resampled(np.sin(2 * np.pi * 2 * t), 50, 100)
    assert len(y) == 200
    np.testing.assert_allclose(y[20:-20], np.sin(2 * np.pi * 2 * np.arange(200) / 50)[20:-20], atol=1e-2)


def test_pchip_is_exact_on_lines_and_monotone():
    x, at = np.array([0.0, 1, 3, 4]), np.linspace(-1, 5, 50)
    np.testing.assert_allclose(kernels.pchip(x, 2 * x + 1, at), 2 * at + 1)
    inner = np.linspace(0, 4, 100)
    assert (np.diff(kernels.pchip(x, np.array([0.0, 0, 5, 6]), inner)) >= -1e-12).all()


def test_rank_and_moment_matching():
    x, y = RNG.normal(size=(100, 3)), 3 * RNG.normal(size=(100, 3))
    out = kernels.rank_matched(x, y)
    np.testing.assert_allclose(np.sort(out, axis=0), np.sort(y, axis=0))
    assert (np.argsort(out, axis=0) == np.argsort(x, axis=0)).all()
    out = kernels.mean_variance_matched(x, y)
    np.testing.assert_allclose([out.mean(axis=0), out.std(axis=0)], [y.mean(axis=0), y.std(axis=0)])


def test_gradient_of_moments_and_its_minimum():
    x, want = RNG.normal(size=200), np.array([0.1, 2, 0.5, 3.0])
    value, grad = kernels.moment_cost(x, want)
    for i in (0, 7, 150):
        e = np.zeros(200)
        e[i] = 1e-6
        assert (kernels.moment_cost(x + e, want)[0] - value) / 1e-6 == pytest.approx(grad[i], abs=1e-5)
    assert kernels.moment_cost(kernels.minimised(lambda z: kernels.moment_cost(z, want), x, 80), want)[0] < 1e-10


def test_autocorrelations():
    x = RNG.normal(size=64)
    ac = kernels.circular_autocorrelation(x)
    assert ac[32] == pytest.approx(np.mean(x * x))
    assert kernels.padded_autocorrelation(x, "rect").shape == (64,)
    np.testing.assert_allclose(kernels.padded_autocorrelation(np.ones(64), "rect", undo=True)[32], 1)


def test_texture_of_independent_channels():
    env = np.abs(RNG.normal(size=(4, 256))) + 1
    h = banks.responses(banks.octave_bank(0.5, 7.9), 256, 16)
    rows = kernels.texture(env, h, [1, 2])
    assert {r[0] for r in rows} == {"mean", "cv", "skew", "kurt", "corr", "mod_power", "ac", "c2_real", "c2_imag"}
    assert all(abs(r[3]) < 0.3 for r in rows if r[0] == "corr")
