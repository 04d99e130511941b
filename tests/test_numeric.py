"""Numeric kernels against hand-made values and published formulas."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motusflow.operators.calibration import fitted
from motusflow.operators.features import detect_peaks, frequency_features
from motusflow.operators.signal import across_axes, butterworth, spline, zero_phase


@pytest.mark.parametrize(
    "x, options, want",
    [
        ([0, 1, 0, 2, 0, 3, 0, 2, 0, 1, 0], {"distance": 2}, [1, 5, 9]),
        ([0, 1, 1, 0, 1, 1, 0], {"edge": "both"}, [1, 2, 4, 5]),
        ([-2, 1, -2, 2, 1, 1, 3, 0], {"threshold": 2}, [1, 6]),
        ([0, 1], {}, []),
        ([0, 1, np.nan, 2, 0], {}, []),
        ([0, -1, 0], {"valley": True}, [1]),
        ([0, 3, 0, 1, 0], {"height": 2}, [1]),
    ],
)
def test_peaks(x, options, want):
    assert detect_peaks(x, **options).tolist() == want


def test_spectrum_of_two_tones():
    t = np.arange(64) / 16
    f, p, total, high = frequency_features(1 + 0.5 * np.sin(4 * np.pi * t) + 0.25 * np.sin(10 * np.pi * t), 16)
    assert (f, round(p, 8), round(total, 6), round(high, 6)) == (2.0, 0.36688475, 0.625, 0.125)


def test_butterworth_lowpass():
    b, a = butterworth(4, [20], 80)
    assert np.allclose(b, [0.093981, 0.375923, 0.563885, 0.375923, 0.093981], atol=1e-6)
    assert np.allclose(a, [1, 0, 0.486029, 0, 0.017665], atol=1e-6)
    with pytest.raises(ValueError):
        butterworth(4, [40], 80)


@pytest.mark.parametrize(
    "rate, want",
    [
        (80, [[0.715576, 0.234605, 0.049819], [0.565425, 0.349426, 0.085148], [0.530096, 0.375923, 0.093981]]),
        (100, [[0.792824, 0.173140, 0.034036], [0.741030, 0.214557, 0.044413], [0.730653, 0.222764, 0.046583]]),
    ],
)
def test_filter_across_axes_is_a_matrix(rate, want):
    got = across_axes(4, [20], rate)
    assert np.allclose(got, want, atol=1e-6) and np.allclose(got.sum(1), 1)


def test_filter_of_a_single_column():
    for kind, want in (("lowpass", 1.0), ("highpass", 0.0)):
        b, a = butterworth(4, [20], 80, kind)
        assert np.isclose(zero_phase(b, a, np.array([1.7]))[0], 1.7 * want)


def test_bandpass_keeps_the_middle():
    b, a = butterworth(2, [5, 10], 80, "bandpass")
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 80)) / np.polyval(a, np.exp(2j * np.pi * f / 80)))
    assert gain(7) > 0.95 and gain(1) < 0.1 and gain(30) < 0.1 and np.isclose(gain(5), 2**-0.5, atol=1e-6)


@given(st.lists(st.floats(-5, 5), min_size=4, max_size=4), st.lists(st.floats(0.1, 3), min_size=5, max_size=20))
@settings(max_examples=30, deadline=None)
def test_spline_reproduces_cubics(c, steps):
    x = np.cumsum(steps)
    at = np.linspace(x[0], x[-1], 17)
    assert np.allclose(spline(x, np.polyval(c, x), at), np.polyval(c, at), rtol=1e-6, atol=1e-5)


def test_calibration_recovers_a_known_distortion():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m, b = np.array([[1.05, 0.02, -0.01], [0.02, 0.97, 0.03], [-0.01, 0.03, 1.02]]), np.array([0.04, -0.03, 0.02])
    got = fitted(v @ np.linalg.inv(m) + b)
    assert got is not None and np.allclose(got[0], m, atol=1e-6) and np.allclose(got[1], b, atol=1e-6)
    assert fitted(v[:8]) is None


def plain_peaks(x, height=None, distance=1, threshold=0, edge="rising", keep_same=False, valley=False):
    """The definition, a sample at a time."""
    x = [-v if valley else v for v in x]
    out = []
    for i in range(1, len(x) - 1):
        a, v, z = x[i - 1 : i + 2]
        if any(np.isnan(t) for t in (a, v, z)):
            continue
        rising, falling = v > a and v >= z, v >= a and v > z
        good = {"rising": rising, "falling": falling, "both": rising or falling, None: rising and falling}[edge]
        if good and (height is None or v >= height) and (threshold <= 0 or min(v - a, v - z) >= threshold):
            out.append(i)
    if distance <= 1:
        return out
    kept = []
    for i in sorted(out, key=lambda i: -x[i]):
        if all(abs(i - k) > distance or (keep_same and not x[k] > x[i]) for k in kept):
            kept.append(i)
    return sorted(kept)


@given(
    st.lists(st.sampled_from([0.0, 1.0, 2.0, 3.0, -1.0, float("nan")]), max_size=25),
    st.fixed_dictionaries({"edge": st.sampled_from(["rising", "falling", "both", None]), "height": st.sampled_from([None, 1.0]), "threshold": st.sampled_from([0, 1, 2]), "distance": st.integers(1, 5), "keep_same": st.booleans(), "valley": st.booleans()}),
)
@settings(max_examples=400, deadline=None)
def test_peaks_are_those_of_the_definition(x, options):
    assert detect_peaks(x, **options).tolist() == plain_peaks(x, **options)


def plain_zero_phase(b, a, x):
    """The difference equation forward and backward, each way led in by a long constant."""

    def once(x):
        seen, y = [x[0]] * 3000 + list(x), []
        for i in range(len(seen)):
            y.append(sum(b[k] * seen[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k))
        return y[3000:]

    return np.array(once(once(x)[::-1])[::-1])


@pytest.mark.parametrize("kind, cutoffs", [("lowpass", [20.0]), ("highpass", [5.0]), ("bandpass", [2.0, 20.0])])
def test_block_filter_equals_the_difference_equation(kind, cutoffs):
    x = np.random.default_rng(0).normal(size=700)
    b, a = butterworth(4, cutoffs, 80, kind)
    assert np.allclose(zero_phase(b, a, x), plain_zero_phase(b, a, x), atol=1e-8)
    both = zero_phase(b, a, np.stack([x, 2 * x], 1))
    assert np.allclose(both[:, 1], 2 * zero_phase(b, a, x), atol=1e-9)


def test_matrices_of_the_twins_are_the_goldens():
    from motusflow.plans.registry import _LOWPASS

    assert np.allclose(_LOWPASS, [[0.715576, 0.234605, 0.049819], [0.565425, 0.349426, 0.085148], [0.530096, 0.375923, 0.093981]], atol=1e-6)


def plain_spline(x, y, at):
    """Cubic pieces by one linear system: values, two continuous derivatives, and a third one at the second and last-but-one knot."""
    n = len(x) - 1
    m, r, row = np.zeros((4 * n, 4 * n)), np.zeros(4 * n), 0
    for i in range(n):
        h = x[i + 1] - x[i]
        m[row, 4 * i], r[row] = 1, y[i]
        m[row + 1, 4 * i : 4 * i + 4], r[row + 1] = [1, h, h**2, h**3], y[i + 1]
        row += 2
        if i < n - 1:
            m[row, 4 * i : 4 * i + 4], m[row, 4 * i + 5] = [0, 1, 2 * h, 3 * h**2], -1
            m[row + 1, 4 * i : 4 * i + 4], m[row + 1, 4 * i + 6] = [0, 0, 2, 6 * h], -2
            row += 2
    for i in (0, n - 2):
        m[row, 4 * i + 3], m[row, 4 * i + 7] = 1, -1
        row += 1
    c = np.linalg.solve(m, r).reshape(n, 4)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 1)
    return sum(c[k, j] * (at - x[k]) ** j for j in range(4))


def test_spline_equals_a_plain_solve():
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.uniform(0.2, 2, 30))
    y, at = rng.normal(size=30), np.linspace(x[0], x[-1], 101)
    assert np.allclose(spline(x, y, at), plain_spline(x, y, at), atol=1e-9)


def test_calibration_starts_with_a_whole_step_and_takes_equal_errors_for_progress():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(10, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m, b = fitted(v)  # nothing to mend: the first error is the last
    assert np.allclose(m, np.eye(3), atol=1e-9) and np.allclose(b, 0, atol=1e-9)
