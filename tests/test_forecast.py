import datetime as dt

import numpy as np
import pytest

from shopgrain.operators import forecast, sales


def test_ar_coefficient_is_recovered():
    rng = np.random.default_rng(0)
    w = np.zeros(800)
    for t in range(1, 800):
        w[t] = 0.6 * w[t - 1] + rng.normal()
    ar, _, _ = forecast.fit_arma(w, 1, 0)
    assert ar[0] == pytest.approx(0.6, abs=0.08)
    e = rng.normal(size=2001)
    _, ma, _ = forecast.fit_arma(e[1:] + 0.5 * e[:-1], 0, 1)
    assert ma[0] == pytest.approx(0.5, abs=0.1)


def test_differenced_line_stays_level_without_drift():
    f, aic = forecast.arima_forecast(np.full(60, 7.0), (1, 1, 1), 5)
    assert np.allclose(f, 7.0) and np.isfinite(aic)


def test_grid_and_metrics(spark):
    day = dt.date(2023, 1, 1)
    rows = [(s, day + dt.timedelta(days=7 * i), 100.0 + 10 * np.sin(i / 3) + k) for k, s in enumerate(("total", "category:a")) for i in range(80) if i != 30]
    weekly = spark.createDataFrame([(s, d, float(v)) for s, d, v in rows], "series string, date date, revenue double")
    grid = forecast.forecast_grid(weekly).persist()
    m = forecast.forecast_metrics(grid)
    assert m.count() == 12 and m.where("rank = 1").count() == 2
    assert grid.groupBy("series", "p", "d", "q").count().select("count").distinct().collect()[0][0] == 79 - int(79 * 0.8)
    best = m.where("rank = 1 and series = 'total'").first()
    assert 0 < best["mape"] < 20 and best["rmse"] >= best["mae"]
    both = forecast.history_and_forecast(weekly, grid, m)
    assert both.where("kind = 'history'").count() == 158


def test_weekly_ends_on_sunday(make_tx):
    w = sales.weekly_sales(make_tx([dict(day=0), dict(day=6), dict(day=7), dict(day=7, returned=1)]))
    assert {(r["date"], r["transactions"]) for r in w.collect()} == {(dt.date(2024, 1, 7), 2), (dt.date(2024, 1, 14), 1)}


def test_short_series_stay_in_the_result(spark):
    import datetime as dt

    weeks = [("short", dt.date(2024, 1, 7) + dt.timedelta(weeks=i), float(i + 1)) for i in range(8)]
    grid = forecast.forecast_grid(spark.createDataFrame(weeks, "series string, date date, revenue double"))
    rows = grid.collect()
    assert rows and all(r.forecast is None and r.aic is None and r.actual is not None for r in rows)
    assert {r.verdict for r in forecast.forecast_metrics(grid).collect()} == {"no forecast"}


def covariance(ar, ma, n, terms=4000):
    """Autocovariances of the process with unit noise, from its moving-average weights."""
    psi = np.zeros(terms)
    for k in range(terms):
        psi[k] = (1.0 if k == 0 else 0.0) + (ma[k - 1] if 0 < k <= len(ma) else 0.0) + sum(ar[i] * psi[k - 1 - i] for i in range(len(ar)) if k - 1 - i >= 0)
    gamma = [float(psi[: terms - h] @ psi[h:]) for h in range(n)]
    return np.array([[gamma[abs(i - j)] for j in range(n)] for i in range(n)])


@pytest.mark.parametrize("ar, ma", [([0.6], []), ([], [0.5]), ([0.5, -0.3], [0.4]), ([0.7], [-0.4, 0.3]), ([], []), ([0.2, 0.3], [0.5, 0.2])])
def test_likelihood_equals_the_multivariate_normal(ar, ma):
    w = np.random.default_rng(len(ar) + len(ma)).normal(size=60)
    squares, logs, _ = forecast.arma_filter(w, np.array([ar]).reshape(1, -1), np.array([ma]).reshape(1, -1))
    c = covariance(ar, ma, 60)
    assert squares[0] == pytest.approx(w @ np.linalg.solve(c, w), rel=1e-8)
    assert logs[0] == pytest.approx(np.linalg.slogdet(c)[1], abs=1e-8)


def test_fit_is_the_maximum_and_recovers_the_process():
    rng = np.random.default_rng(0)
    e, w = rng.normal(size=601), np.zeros(601)
    for t in range(1, 601):
        w[t] = 0.7 * w[t - 1] + e[t] + 0.4 * e[t - 1]
    w = w[1:]
    ar, ma, value, _ = forecast.maximum_likelihood(w, 1, 1)
    assert ar[0] == pytest.approx(0.7, abs=0.08) and ma[0] == pytest.approx(0.4, abs=0.1)

    def deviance(a, b):
        squares, logs, _ = forecast.arma_filter(w, np.array([[a]]), np.array([[b]]))
        return len(w) * (np.log(2 * np.pi * squares[0] / len(w)) + 1) + logs[0]

    assert value == pytest.approx(deviance(ar[0], ma[0]))
    grid = [deviance(a, b) for a in np.arange(-0.95, 0.96, 0.05) for b in np.arange(-0.95, 0.96, 0.05)]
    assert value <= min(grid) + 1e-6


def test_numbers_and_coefficients_are_inverse():
    x = np.array([[0.3, -0.8, 0.5]])
    assert np.allclose(forecast._numbers(forecast._coefficients(x)[0]), x[0])
    assert np.allclose(forecast._numbers(np.array([1.2, 0.5])), 0.1)


def test_orders_are_compared_on_one_sample():
    """A random walk without differences (coefficient near 1) and with one: both likelihoods are of the same 99 values, so they hardly differ."""
    y = np.cumsum(np.random.default_rng(2).normal(size=100))
    assert abs(forecast.arima_forecast(y, (1, 0, 0), 1, 1)[1] - forecast.arima_forecast(y, (0, 1, 0), 1, 1)[1]) < 8


def test_forecast_of_an_autoregression_decays():
    rng = np.random.default_rng(5)
    y = np.zeros(300)
    for t in range(1, 300):
        y[t] = 0.8 * y[t - 1] + rng.normal()
    f, _ = forecast.arima_forecast(y, (1, 0, 0), 4)
    ar = forecast.maximum_likelihood(y, 1, 0)[0][0]
    assert np.allclose(f, y[-1] * ar ** np.arange(1, 5))
