"""Recursive kernels on short series worked out by hand or by plain loops."""

import numpy as np
import pytest

from quantweave.operators import kernels as k

X = np.array([10.0, 11.0, 10.5, 11.5, 12.0, 11.0, 11.5, 12.5, 12.0, 13.0])


def test_ema_seed_is_the_plain_mean():
    e = k.ema(X, 3)
    assert np.isnan(e[:2]).all()
    assert e[2] == pytest.approx((10 + 11 + 10.5) / 3)
    assert e[3] == pytest.approx(e[2] + 0.5 * (11.5 - e[2]))


def test_rsi_by_hand():
    # moves: +1 -0.5 +1 | averages of the first three: up 2/3, down 0.5/3
    r = k.rsi(X, 3)
    assert np.isnan(r[:3]).all()
    assert r[3] == pytest.approx(100 * (2 / 3) / (2 / 3 + 0.5 / 3))
    up, down = (2 / 3 * 2 + 0.5) / 3, (0.5 / 3 * 2) / 3
    assert r[4] == pytest.approx(100 * up / (up + down))


def test_flat_series_gives_zero_not_nan():
    flat = np.full(12, 5.0)
    assert k.rsi(flat, 3)[5] == 0.0
    assert k.cmo(flat, 3)[5] == 0.0
    assert (k.kdj(flat, flat, flat, 3)[0] == 50.0).all()


def test_macd_lines_share_their_first_row():
    line, sig, hist = k.macd(X, 2, 4, 3)
    first = 4 - 1 + 3 - 1
    for a in (line, sig, hist):
        assert np.isnan(a[:first]).all() and not np.isnan(a[first:]).any()
    fast0 = X[2:4].mean()
    slow0 = X[:4].mean()
    raw = [fast0 - slow0]
    f, s = fast0, slow0
    for v in X[4:6]:
        f, s = f + (v - f) * 2 / 3, s + (v - s) * 2 / 5
        raw.append(f - s)
    assert sig[first] == pytest.approx(np.mean(raw))


def test_true_range_needs_a_previous_close():
    h, lo, c = X + 1, X - 1, X
    tr = k.true_range(h, lo, c)
    assert np.isnan(tr[0])
    assert tr[1] == pytest.approx(max(2.0, abs(12 - 10), abs(10 - 10)))


def test_adx_starts_after_two_periods():
    h, lo = X + 0.5, X - 0.5
    a = k.adx(h, lo, X, 3)
    assert np.isnan(a[:5]).all() and not np.isnan(a[5:]).any()


def test_short_history_is_all_missing():
    assert np.isnan(k.rsi(X[:3], 42)).all()
    assert np.isnan(k.trix(X, 30)).all()
