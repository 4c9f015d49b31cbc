"""Weekly forecasts: every (series, order) pair is fitted in its own task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.expr import MONEY_SCALE, ladder, money_units, safe_divide, week_end


def weekly_series(tx: DataFrame) -> DataFrame:
    """Kept weekly revenue of the total, each category and each region: (series, date, revenue).

    One grouping-sets pass; a series has one row per week, however many orders there are.
    """
    d = tx.where(F.col("returned") == 0).withColumn("date", week_end(F.col("order_date")))
    g = d.groupingSets([["date"], ["date", "category"], ["date", "region"]], "date", "category", "region").agg(
        F.sum(money_units(F.col("total_amount"))).alias("u"), F.grouping("category").alias("_c"), F.grouping("region").alias("_r"))
    name = F.when(F.col("_c") == 0, F.concat(F.lit("category:"), "category")).when(F.col("_r") == 0, F.concat(F.lit("region:"), "region")).otherwise("total")
    return g.select(name.alias("series"), "date", (F.col("u").cast("double") / MONEY_SCALE).alias("revenue")).where("revenue > 0")


def _lags(x: np.ndarray, n: int, start: int) -> np.ndarray:
    return np.column_stack([x[start - i : len(x) - i] for i in range(1, n + 1)]) if n else np.empty((len(x) - start, 0))


def fit_arma(w: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-step least squares: a long autoregression gives residuals, then lags of both are regressed.

    Returns AR coefficients, MA coefficients and in-sample residuals (zero before the first fit).
    """
    e = np.zeros(len(w))
    if q:
        m = min(max(p + q, int(np.ceil(np.log(len(w)) ** 1.5))), len(w) // 4)
        b = np.linalg.lstsq(_lags(w, m, m), w[m:], rcond=None)[0]
        e[m:] = w[m:] - _lags(w, m, m) @ b
        start = m + q
    else:
        start = p
    x = np.hstack([_lags(w, p, start), _lags(e, q, start)])
    coef = np.linalg.lstsq(x, w[start:], rcond=None)[0] if x.shape[1] else np.empty(0)
    ar, ma = coef[:p], coef[p:]
    r = np.zeros(len(w))
    for t in range(max(p, q), len(w)):
        r[t] = w[t] - sum(ar[i] * w[t - 1 - i] for i in range(p)) - sum(ma[i] * r[t - 1 - i] for i in range(q))
    return ar, ma, r


def _coefficients(x: np.ndarray) -> np.ndarray:
    """Rows of any numbers to rows of autoregressive coefficients of a stationary process: the numbers' hyperbolic tangents are its partial autocorrelations."""
    r = np.tanh(x)
    out = np.zeros_like(r)
    for k in range(r.shape[1]):
        out[:, :k] = out[:, :k] - r[:, k : k + 1] * out[:, :k][:, ::-1]
        out[:, k] = r[:, k]
    return out


def _numbers(coefficients: np.ndarray) -> np.ndarray:
    """The inverse of ``_coefficients`` for one row; small numbers where the coefficients are not those of a stationary process."""
    a, out = coefficients.astype(float).copy(), np.zeros(len(coefficients))
    for k in range(len(a) - 1, -1, -1):
        if abs(a[k]) >= 0.99:
            return np.full(len(coefficients), 0.1)
        out[k] = np.arctanh(a[k])
        a = (a[:k] + a[k] * a[:k][::-1]) / (1 - a[k] ** 2)
    return out


def _shifted(m: np.ndarray) -> np.ndarray:
    """Every row moved up by one, the last one zero."""
    return np.concatenate([m[:, 1:], np.zeros_like(m[:, :1])], axis=1)


def arma_filter(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kalman filter of stationary processes on ``w``, one per row of ``ar`` and ``ma``: sums of the squared innovations over their scale and of the scales' logarithms, and the last states.

    The first state has the process's own covariance, so the likelihood is that of all values, none left out or set to zero.
    """
    n_fits, r = len(ar), max(ar.shape[1], ma.shape[1] + 1)
    phi = np.zeros((n_fits, r))
    phi[:, : ar.shape[1]] = ar
    load = np.zeros((n_fits, r))
    load[:, 0], load[:, 1 : 1 + ma.shape[1]] = 1, ma
    step = np.zeros((n_fits, r, r))
    step[:, :, 0] = phi
    step[:, np.arange(r - 1), np.arange(1, r)] = 1
    noise = load[:, :, None] * load[:, None, :]
    kron = np.einsum("bij,bkl->bikjl", step, step).reshape(n_fits, r * r, r * r)
    cov = np.linalg.solve(np.eye(r * r) - kron, noise.reshape(n_fits, r * r, 1)).reshape(n_fits, r, r)
    state, squares, logs = np.zeros((n_fits, r)), np.zeros(n_fits), np.zeros(n_fits)
    steady = False
    for value in w:
        if not steady:
            scale = cov[:, 0, 0]
            moved = phi[:, :, None] * cov[:, :1, :] + _shifted(cov)
            gain = moved[:, :, 0] / scale[:, None]
            turned = moved.transpose(0, 2, 1)
            after = phi[:, :, None] * turned[:, :1, :] + _shifted(turned) + noise - gain[:, :, None] * gain[:, None, :] * scale[:, None, None]
            steady = np.abs(after - cov).max() < 1e-11
            cov, log_scale = after, np.log(scale)
        v = value - state[:, 0]
        squares += v * v / scale
        logs += log_scale
        state = phi * state[:, :1] + _shifted(state) + gain * v[:, None]
    return squares, logs, state


def _deviance(w: np.ndarray, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """-2 log likelihood at its best variance, and the last states, for rows of numbers (p for the autoregressive part, the others for the moving average)."""
    squares, logs, state = arma_filter(w, _coefficients(x[:, :p]), -_coefficients(x[:, p:]))
    s2 = np.maximum(squares / len(w), 1e-12)
    return len(w) * (np.log(2 * np.pi * s2) + 1) + logs, state


def maximum_likelihood(w: np.ndarray, p: int, q: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """AR and MA coefficients of the greatest exact Gaussian likelihood, -2 log likelihood and the state after the last value. BFGS from the least-squares fit; gradients and step lengths are tried side by side."""
    k = p + q
    start = np.full((1, k), 0.1)
    if k and np.ptp(w) > 0:
        ar, ma, _ = fit_arma(w, p, q)
        start = np.vstack([start, np.append(_numbers(ar), _numbers(-ma))])
    x = start[int(np.argmin(_deviance(w, start, p)[0]))]
    hessian = np.eye(k) * 0.01
    last, gradient, eps = np.inf, np.zeros(k), 1e-5
    for _ in range(rounds if k else 0):
        around = np.vstack([x, x + eps * np.eye(k), x - eps * np.eye(k)])
        values = _deviance(w, around, p)[0]
        if last - values[0] < 1e-5:
            break
        before, gradient, last = gradient, (values[1 : k + 1] - values[k + 1 :]) / (2 * eps), values[0]
        if before.any():
            y, s = gradient - before, moved
            if (sy := float(s @ y)) > 1e-12:
                fold = np.eye(k) - np.outer(s, y) / sy
                hessian = fold @ hessian @ fold.T + np.outer(s, s) / sy
        direction = -hessian @ gradient
        lengths = np.array([1.0, 0.5, 0.2, 0.05, 0.01, 0.001])[:, None] * min(1.0, 2.0 / max(np.abs(direction).max(), 1e-12))
        tries = np.clip(x + lengths * direction, -6, 6)
        found = _deviance(w, tries, p)[0]
        best = int(np.argmin(found))
        if not found[best] < last:
            break
        moved, x = tries[best] - x, tries[best]
    value, state = _deviance(w, x[None, :], p)
    return _coefficients(x[None, :p])[0], -_coefficients(x[None, p:])[0], float(value[0]), state[0]


def arima_forecast(y: np.ndarray, order: tuple[int, int, int], steps: int, most_differences: int | None = None) -> tuple[np.ndarray, float]:
    """Forecast of ``steps`` values and AIC by the exact likelihood. With ``most_differences``, the largest among the orders that are compared, every order's likelihood is that of the same values of ``y``."""
    p, d, q = order
    levels = [y]
    for _ in range(d):
        levels.append(np.diff(levels[-1]))
    w = levels[-1][max(0, (most_differences or d) - d) :]
    ar, ma, deviance, state = maximum_likelihood(w, p, q)
    out = np.empty(steps)
    phi = np.zeros(len(state))
    phi[:p] = ar
    for t in range(steps):
        out[t] = state[0]
        state = phi * state[0] + np.append(state[1:], 0.0)
    for level in reversed(levels[:-1]):
        out = level[-1] + np.cumsum(out)
    return out, deviance + 2 * (p + q + 1)


#: Training weeks below which no model is fitted.
MIN_TRAIN = 12


def forecast_grid(weekly: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(series, p, d, q, date, actual, forecast, aic) over the test weeks of every series and order.

    Missing weeks of the grid are filled on the straight line between their neighbours for the fit and
    are not scored. A series with fewer than MIN_TRAIN training weeks has its test weeks with a null forecast.
    """
    s = cfg.sales
    orders = [list(o) for o in s.arima_orders]
    grid = weekly.withColumn("o", F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in orders])))
    grid = grid.select("series", F.col("o")[0].alias("p"), F.col("o")[1].alias("d"), F.col("o")[2].alias("q"), "date", "revenue")
    ratio, most = s.train_ratio, max(o[1] for o in orders)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        name, p, d, q = key
        pdf = pdf.sort_values("date").reset_index(drop=True)
        cut = int(len(pdf) * ratio)
        if cut < MIN_TRAIN:  # too short to fit: its test weeks stay in the result, without a forecast
            rest = pdf[cut:]
            return pd.DataFrame({"series": name, "p": p, "d": d, "q": q, "date": rest["date"], "actual": rest["revenue"], "forecast": np.nan, "aic": np.nan})
        days = pd.to_datetime(pdf["date"])
        full = pd.Series(pdf["revenue"].to_numpy(), index=days).asfreq("7D")
        train = full[: days[cut - 1]].interpolate()
        test = full[days[cut]:]
        steps = int((test.index[-1] - train.index[-1]).days // 7)
        f, aic = arima_forecast(train.to_numpy(), (int(p), int(d), int(q)), steps, most)
        f = pd.Series(f, index=pd.date_range(train.index[-1], periods=steps + 1, freq="7D")[1:])
        test = test.dropna()
        return pd.DataFrame({"series": name, "p": p, "d": d, "q": q, "date": test.index.date, "actual": test.to_numpy(), "forecast": f[test.index].to_numpy(), "aic": aic})

    schema = "series string, p int, d int, q int, date date, actual double, forecast double, aic double"
    return grid.groupBy("series", "p", "d", "q").applyInPandas(fit, schema)


def forecast_metrics(grid: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """MAE, RMSE, MAPE and AIC per series and order, the best order by MAPE and its verdict."""
    e = F.col("actual") - F.col("forecast")
    m = grid.groupBy("series", "p", "d", "q").agg(
        F.count("*").alias("weeks"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(safe_divide(F.abs(e), F.col("actual"))) * 100).alias("mape"), F.max("aic").alias("aic"))
    order = Window.partitionBy("series").orderBy("mape", "p", "d", "q")  # six orders per series
    m = m.withColumn("rank", F.row_number().over(order))
    return m.withColumn("verdict", ladder((F.col("mape").isNull(), "no forecast"), (F.col("mape") < cfg.sales.mape_excellent, "excellent"), (F.col("mape") < cfg.sales.mape_good, "good"), default="poor"))


def forecast_residuals(grid: DataFrame, metrics: DataFrame) -> DataFrame:
    """Test-week errors of the best order of each series."""
    best = metrics.where("rank = 1").select("series", "p", "d", "q")
    return grid.join(best, ["series", "p", "d", "q"]).withColumn("residual", F.col("actual") - F.col("forecast"))


def history_and_forecast(weekly: DataFrame, grid: DataFrame, metrics: DataFrame) -> DataFrame:
    """Observed weeks and the best forecast in one table (series, date, kind, value)."""
    h = weekly.select("series", "date", F.lit("history").alias("kind"), F.col("revenue").alias("value"))
    f = forecast_residuals(grid, metrics).select("series", "date", F.lit("forecast").alias("kind"), F.col("forecast").alias("value"))
    return h.unionByName(f)


def forecast_verdicts(metrics: DataFrame, trend: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """MAPE verdict of the best total model and growth verdict of the rolling trend, as rule rows."""
    best = metrics.where((F.col("series") == "total") & (F.col("rank") == 1)).select(F.lit("mape").alias("rule_id"), F.col("mape").alias("metric"), "verdict")
    pct = F.col("pct_change")
    growth = trend.select(F.lit("growth").alias("rule_id"), pct.alias("metric"), ladder((pct > 10, "strong growth"), (pct > 0, "modest growth"), default="decline").alias("verdict"))
    return best.unionByName(growth)
