import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.kernels import alignment, ear, filters, haspi, loudness, mbstoi, prescription, quality, stoi


@pytest.mark.parametrize("rate, wanted", [(10_000.0, 0.9275623756362125), (9_000.0, 0.9487599218003981)])
def test_mbstoi_golden_values(rate, wanted):
    rng = np.random.RandomState(0)
    left = 100 * rng.random_sample(8000)
    right = left.copy()
    right[4:] = right[:-4]
    noisy = left + 30 * rng.random_sample(8000)
    noisy_right = right + 30 * rng.random_sample(8000)
    s = mbstoi.Settings(fft=64, bands=5, lowest=500, range_db=60)
    assert mbstoi.mbstoi(left, right, noisy, noisy_right, rate, s) == pytest.approx(wanted, rel=1e-7, abs=1e-7)


def test_stoi_falls_with_noise():
    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000) * np.repeat(rng.uniform(0.1, 1, 200), 100)
    noise = rng.normal(size=20_000)
    scores = [stoi.stoi(x, x + g * noise, 10_000) for g in (0, 0.3, 1, 3)]
    assert scores[0] == pytest.approx(1, abs=1e-6) and scores == sorted(scores, reverse=True) and scores[-1] < 0.6
    assert np.isnan(stoi.stoi(x[:100], x[:100], 10_000))


def test_loudness_of_a_full_scale_tone():
    """A 997 Hz sine at full scale in one channel reads -3.01 LUFS."""
    x = np.sin(2 * np.pi * 997 * np.arange(48_000 * 2) / 48_000)
    assert loudness.integrated_loudness(x, 48_000) == pytest.approx(-3.01, abs=0.02)
    assert loudness.integrated_loudness(np.stack([x, x]), 48_000) == pytest.approx(0, abs=0.02)
    assert loudness.integrated_loudness(x * 0, 48_000) == float("-inf")


def plain_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=9), st.lists(st.integers(-5, 5), min_size=1, max_size=9))
def test_warping(a, b):
    assert alignment.dtw(np.array(a, float), np.array(b, float)) == plain_dtw(a, b)


def test_delay():
    x = np.random.default_rng(0).normal(size=100)
    late = np.concatenate([np.zeros(7), x])
    assert alignment.delay(x, late) == 7 and alignment.delay(late, x) == -7
    one, two = alignment.aligned(x, late)
    assert np.array_equal(one, two)


@pytest.mark.parametrize("measure, wanted", [("hasqi", 0.002525809), ("haaqi", 0.111290948)])
def test_quality_golden_values(measure, wanted):
    rng = np.random.RandomState(0)
    x, y = rng.uniform(-1, 1, 8000), rng.uniform(-1, 1, 8000)
    assert quality.MEASURES[measure](x, y, 16_000, np.array([45, 45, 35, 45, 60, 65.0]), rng=rng) == pytest.approx(wanted, rel=1e-6, abs=1e-7)


def test_empty_music():
    none, some = np.zeros(0), np.ones(3)
    assert quality.haaqi(none, none, 16_000, np.zeros(6), rng=None) == 1 and quality.haaqi(none, some, 16_000, np.zeros(6), rng=None) == 0


def test_ear_model_golden_sums():
    rng = np.random.RandomState(0)
    x, noise = rng.random_sample(600), rng.random_sample(600)
    one, two = ear.listen(x, 24_000, x + noise, 24_000, np.array([45, 45, 35, 45, 60, 65.0]), equalised=0, level=65, rng=rng, shift=0.0, bands=10)
    sums = [np.abs(v).sum() for h in (one, two) for v in (h.db, h.motion, h.level)]
    assert sums == pytest.approx([102596.63767028379, 65517.72934742906, 291.3527365691821, 4145.3884196835625, 2366.401656815131, 13.655317152968216], rel=1e-7)


def test_ear_model_stages():
    assert ear.centre_frequencies(10).sum() == pytest.approx(23935.19626226296)
    x = 100 * np.random.RandomState(0).random_sample(600)
    late = np.concatenate([np.zeros(50), x[:-50]])
    assert [np.abs(v).sum() for v in ear.aligned_inputs(x, late)] == pytest.approx([29892.167176853407, 27199.009291096496])
    assert np.abs(ear.middle_ear(x)).sum() == pytest.approx(9241.220369749171)
    assert np.abs(ear.at_model_rate(x / 100, 12_000)).sum() == pytest.approx(604.1522707137393)
    assert quality.smoothed(np.random.RandomState(0).random_sample((4, 600)), 1).sum() == pytest.approx(100.7397658862719)


def test_nalr_golden_sum():
    gains = prescription.nalr_gains_of(np.array([45, 45, 35, 45, 60, 65.0]))
    assert np.abs(prescription.nalr_filter(gains, 44_100)).sum() == pytest.approx(28.846583644263408)


def test_chebyshev_stops():
    b, a = filters.cheby2(7, 30, 0.5)
    response = lambda w: abs(np.polyval(b, np.exp(1j * np.pi * w)) / np.polyval(a, np.exp(1j * np.pi * w)))
    assert response(0) == pytest.approx(1) and response(0.5) == pytest.approx(10**-1.5) and max(map(response, np.linspace(0.5, 1, 50))) < 10**-1.5 + 1e-9


def test_haspi_stages():
    both = np.array([[80.0, 80, 80, 80], [40, 50, 60, 70]])
    assert haspi.low_passed(both, 1000, 16_000)[:, 0] == pytest.approx([48.84481105, 32.32800458])
    x = np.random.RandomState(0).random_sample((6, 700))
    bands = haspi.modulation(x - x.mean(axis=1, keepdims=True), 2560)
    assert bands.shape == (10, 6, 700) and haspi.correlations(bands, 2 * bands) == pytest.approx(1)


def test_haspi_falls_with_noise():
    rng = np.random.RandomState(0)
    x, noise = rng.uniform(-1, 1, 8000) * np.repeat(rng.uniform(0, 1, 80), 100), rng.uniform(-1, 1, 8000)
    levels = np.full(6, 20.0)
    clean, noisy = (haspi.features(x, x + g * noise, 16_000, levels, rng=np.random.RandomState(1)).mean() for g in (0.01, 1))
    assert clean > noisy
    network = haspi.Networks(np.ones((2, 11, 4)), np.ones((2, 5)))
    assert 0 < network(np.full(10, 0.5)) <= 1 / haspi.MOST
    assert np.isnan(haspi.features(x, x, 16_000, np.full(6, 20.0), level=-200, rng=rng)).all()
