"""Forecasters.

Those without a fit are windows: one pass gives every origin's forecast at
once, and cells pick theirs by an equi-join.  Fitted ones are grouped maps over
a series and horizon; a fit is used until ``REFIT`` further rows are known.

Each returns ``unique_id, origin, h, ds_target, yhat, median, q10 .. q90, fail,
fail_reason`` (:data:`FORECAST`); a model that can't forecast returns the row
with a reason instead of raising.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DECILES, Q_COLUMNS, log, positive, q_array, ratio, spread_deciles
from .panel import asof_join, series
from .windows import LAGS, har_features, lag_features, rolling_sum

KEY = ["unique_id", "origin", "h", "ds_target"]
FORECAST = "unique_id string, origin date, h int, ds_target date, yhat double, median double, " + ", ".join(f"{q} double" for q in Q_COLUMNS) + ", fail boolean, fail_reason string"
#: Rows of the estimation window, pairs that calibration needs, rows after which
#: a model is fitted again.
ESTIMATION, PAIRS, REFIT = 250, 60, 5


def _deciles(x: Column | str, w) -> Column:
    return F.percentile(x, F.array(*map(F.lit, DECILES))).over(w)


def _finish(df: DataFrame, yhat: Column, quantiles: Column, reason: Column, median: Column | None = None) -> DataFrame:
    """The forecast row: everything null where there is a reason."""
    ok = reason.isNull()
    median = yhat if median is None else median
    return df.select(
        *KEY,
        F.when(ok, yhat).alias("yhat"),
        F.when(ok, median).alias("median"),
        *spread_deciles(F.when(ok, quantiles)),
        (~ok).alias("fail"),
        reason.alias("fail_reason"),
    )


def random_walk(panel: DataFrame, cells: DataFrame, horizons: list[int], n: int = ESTIMATION) -> DataFrame:
    """The last level; deciles are the level plus those of the ``h``-row changes
    of an estimation window of ``n`` rows."""
    out = None
    for h in horizons:
        moved = panel.withColumn("_d", F.col("y") - F.lag("y", h).over(series()))
        state = moved.select("unique_id", F.col("ds").alias("origin"), "y", _deciles("_d", series().rowsBetween(-(n - h - 1), 0)).alias("_q"))
        mine = cells.where(F.col("h") == h).join(state, ["unique_id", "origin"])
        q = F.transform("_q", lambda x: x + F.col("y"))
        part = _finish(mine, F.col("y"), q, F.when(F.col("y").isNull(), "insufficient_history"))
        out = part if out is None else out.unionByName(part)
    return out


def calibrated(forecast: Column, ratios: Column, pairs: Column) -> Column:
    """Forecast times the deciles of past realised-to-forecast ratios; null with
    fewer than PAIRS pairs."""
    return F.when(pairs >= PAIRS, F.transform(ratios, lambda r: r * forecast))


def naive_prev(rv: DataFrame, cells: DataFrame, horizons: list[int], n: int = ESTIMATION) -> DataFrame:
    """The last value, or the last whole block of ``h`` rows; deciles from the
    ratios of consecutive blocks.

    Blocks end at the origin, so their place moves with it: partitioning by the
    row number modulo ``h`` makes consecutive blocks neighbours.
    """
    out = None
    for h in horizons:
        rows = rolling_sum(rv, h).withColumn("_m", F.col("rn") % h)
        lane = Window.partitionBy("unique_id", "_m").orderBy("rn")
        rows = rows.withColumn("_r", positive(ratio(positive("s"), F.lag(positive("s")).over(lane))))
        w = lane.rowsBetween(-(n // h - 2), 0)
        state = rows.select("unique_id", F.col("ds").alias("origin"), "s", _deciles("_r", w).alias("_q"), F.count("_r").over(w).alias("n_pairs"))
        mine = cells.where(F.col("h") == h).join(state, ["unique_id", "origin"])
        reason = F.when(F.col("s").isNull(), "insufficient_history").when(F.col("s") <= 0, "nonpositive_forecast")
        part = _finish(mine, F.col("s"), calibrated(F.col("s"), F.col("_q"), F.col("n_pairs")), reason)
        out = part if out is None else out.unionByName(part)
    return out


def seasonal(panel: DataFrame, cells: DataFrame, last: int) -> DataFrame:
    """Median of the last ``last`` values on the target's weekday (1: the last
    value itself); deciles of all values on that weekday so far."""
    day = Window.partitionBy("unique_id", "dow").orderBy("ds")
    recent, all_ = day.rowsBetween(1 - last, 0), day.rowsBetween(Window.unboundedPreceding, 0)
    state = panel.withColumn("dow", F.weekday("ds")).select(
        F.concat_ws("|", "unique_id", "dow").alias("lane"),
        "ds",
        F.struct(
            F.percentile("y", F.lit(0.5)).over(recent).alias("y"), F.count("y").over(recent).alias("have"), _deciles("y", all_).alias("q")
        ).alias("x"),
    )
    asked = cells.select(*KEY, F.concat_ws("|", "unique_id", F.weekday("ds_target")).alias("lane"), F.col("origin").alias("ds"))
    found = asof_join(asked, state, "x", "lane")
    reason = F.when(F.coalesce(F.col("x.have"), F.lit(0)) < last, "insufficient_history")
    return _finish(found, F.col("x.y"), F.col("x.q"), reason)


def summed(targets: str | dict[int, str], h: int) -> bool:
    """Whether a horizon's target is the sum of its ``h`` rows, not the last of
    them.  ``targets``: "direct" or "sum" for all horizons or for each."""
    return h > 1 and (targets if isinstance(targets, str) else targets.get(h, "direct")) == "sum"


def ewma_path(returns: DataFrame, lam: float = 0.94) -> DataFrame:
    """``unique_id, ds, sigma2``: the variance forecast for the next row, with
    the mean of the first 20 squares as its start.

    The recursion in closed form over pieces of 512 rows, of which the powers
    of ``lam`` stay far from overflow.
    """

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        r2 = np.square(pdf["ret"].to_numpy("float64"))
        out, s = np.empty(len(r2)), float(np.mean(r2[:20]))
        for at in range(0, len(r2), 512):
            part = r2[at : at + 512]
            fade = lam ** np.arange(1, len(part) + 1)
            out[at : at + 512] = fade * (s + (1 - lam) * np.cumsum(part / fade))
            s = float(out[at + len(part) - 1])
        return pd.DataFrame({"unique_id": pdf["unique_id"], "ds": pdf["ds"], "sigma2": out})

    clean = returns.where(F.col("ret").isNotNull())
    return clean.groupBy("unique_id").applyInPandas(path, "unique_id string, ds date, sigma2 double")


def ewma(rv: DataFrame, returns: DataFrame, cells: DataFrame, n: int = ESTIMATION, horizons: list[int] | None = None, targets: str | dict[int, str] = "direct") -> DataFrame:
    """Exponentially weighted variance of a row ahead, or ``h`` times that for
    a sum; deciles from ratios of the realised to what had been forecast.

    Direct: for the same row.  Sums: of blocks of ``h`` rows back from the
    origin, within the estimation window, to ``h`` times what had been forecast
    for the row before the block.
    """
    path = ewma_path(returns)
    path = path.withColumn("for_ds", F.lag("sigma2").over(series()))
    out = None
    for h in horizons or [1]:
        if summed(targets, h):
            rows = rolling_sum(rv, h).join(path, ["unique_id", "ds"], "left")
            rows = rows.withColumn("_r", positive(ratio(positive("s"), positive(h * F.lag("for_ds", h).over(series())))))
            pairs = n // h - (n % h == 0)
            w, times = Window.partitionBy("unique_id", F.col("rn") % h).orderBy("rn").rowsBetween(1 - pairs, 0), h
        else:
            rows = rv.join(path, ["unique_id", "ds"], "left").withColumn("_r", positive(ratio(positive("y"), positive("for_ds"))))
            w, times = series().rowsBetween(1 - n, 0), 1
        state = rows.select(
            "unique_id",
            F.col("ds").alias("origin"),
            (times * F.last("sigma2", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))).alias("f"),
            _deciles("_r", w).alias("_q"),
            F.count("_r").over(w).alias("n_pairs"),
        )
        mine = (cells.where(F.col("h") == h) if horizons else cells).join(state, ["unique_id", "origin"])
        reason = F.when(F.col("f").isNull(), "insufficient_return_history").when(F.col("f") <= 0, "nonpositive_forecast")
        part = _finish(mine, F.col("f"), calibrated(F.col("f"), F.col("_q"), F.col("n_pairs")), reason)
        out = part if out is None else out.unionByName(part)
    return out


def index_regression(rv: DataFrame, index: DataFrame) -> DataFrame:
    """At every row: intercept, slope and residual variance of the regression of
    the next row's log value on the log of the latest index, over all pairs
    whose target is known; and the forecast for the next row."""
    rows = asof_join(rv, index).withColumn("lx", log("x"))
    rows = rows.withColumn("px", F.lag("lx").over(series())).withColumn("ly", F.when(F.col("px").isNotNull(), log("y")))
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    fit = rows.select(
        "unique_id",
        F.col("ds").alias("origin"),
        "lx",
        F.regr_count("ly", "px").over(w).alias("n"),
        F.regr_slope("ly", "px").over(w).alias("b"),
        F.regr_intercept("ly", "px").over(w).alias("a"),
        F.regr_syy("ly", "px").over(w).alias("syy"),
        F.regr_sxy("ly", "px").over(w).alias("sxy"),
        F.regr_sxx("ly", "px").over(w).alias("sxx"),
    ).where((F.col("n") >= 4) & F.col("lx").isNotNull() & (F.col("sxx") > 0))
    s2 = (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / F.col("n")
    mu = F.col("a") + F.col("b") * F.col("lx")
    return fit.select("unique_id", "origin", "n", "a", "b", s2.alias("sigma2"), F.exp(mu + s2 / 2).alias("mean"), F.exp(mu).alias("median"))


def _grouped(cells: DataFrame, rows: DataFrame, fit_predict, columns: list[str], refit: int = REFIT) -> DataFrame:
    """Cogroup a series' cells with its rows and forecast them one refit block,
    of ``refit`` rows, after another.  ``fit_predict(known, origins) -> list of (mean, median,
    deciles or None)`` sees rows up to the block's first origin for the fit and
    up to each origin for the state."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("ds").reset_index(drop=True)
        out = []
        for h, mine in left.groupby("h"):
            mine = mine.sort_values("origin").reset_index(drop=True)
            seen, at = np.searchsorted(right["ds"].to_numpy(), mine["origin"].to_numpy(), side="right"), 0
            while at < len(mine):
                # A fit serves the origins until ``refit`` further rows are known.
                end = max(at + 1, int(np.searchsorted(seen, seen[at] + refit)))
                block, known, at = mine.iloc[at:end], seen[at:end], end
                try:
                    made = fit_predict(right, known, int(h))
                except (ValueError, np.linalg.LinAlgError, ZeroDivisionError) as e:
                    made = [str(e) or "fit_error"] * len(block)
                for (_, cell), m in zip(block.iterrows(), made):
                    bad = m if isinstance(m, str) else None
                    mean, median, q = (None, None, None) if bad else m
                    q = [None] * 9 if q is None else list(q)
                    out.append([cell["unique_id"], cell["origin"], int(h), cell["ds_target"], mean, median, *q, bad is not None, bad])
        names = [c.split(" ")[0] for c in FORECAST.split(", ")]
        return pd.DataFrame(out, columns=names)

    # Aliases give the columns identities of their own where cells come from rows.
    rows = rows.select(*[F.col(c).alias(c) for c in columns])
    return cells.groupBy("unique_id").cogroup(rows.groupBy("unique_id")).applyInPandas(run, FORECAST)


def _tail(y: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the whole blocks of ``h`` rows back from the end start, if there is
    a row before, and their sums."""
    skip = len(y) % h
    start = skip + h * np.arange(len(y) // h)
    total = y[skip:].reshape(-1, h).sum(1)
    return start[start > 0], total[start > 0]


def log_regression(rows: DataFrame, cells: DataFrame, names: list[str], least: int, reach: int, n: int | None, targets: str | dict[int, str], refit: int = REFIT) -> DataFrame:
    """Regression of the log target on features known ``h`` rows before, or for
    sums, of non-overlapping blocks, on those before the block; the mean with
    the residual variance, the median, and deciles of the residuals.

    ``n``: rows of the estimation window, all if None; a feature looks back
    over ``reach`` rows and is missing where the window has fewer.
    """

    def fit_predict(rows: pd.DataFrame, known: np.ndarray, h: int):
        x, y = rows[names].to_numpy("float64"), rows["y"].to_numpy("float64")
        at = max(0, int(known[0]) - n) if n else 0
        v, f = y[at : known[0]], x[at : known[0]].copy()
        f[: reach - 1] = np.nan
        if summed(targets, h):
            start, total = _tail(v, h)
            f, v = f[start - 1], total
        else:
            f, v = f[: max(0, len(v) - h)], v[h:]
        with np.errstate(invalid="ignore", divide="ignore"):
            target = np.log(v)
        good = np.isfinite(f).all(1) & np.isfinite(target)
        if good.sum() < least:
            raise ValueError("insufficient_history")
        design = np.column_stack([np.ones(len(f)), f])[good]
        beta = np.linalg.lstsq(design, target[good], rcond=None)[0]
        resid = target[good] - design @ beta
        s2, q = float(np.mean(resid**2)), np.quantile(resid, DECILES)
        out = []
        for k in known:
            f = x[k - 1] if k else np.full(len(names), np.nan)
            if not np.isfinite(f).all():
                out.append("insufficient_history")
                continue
            mu = float(beta[0] + f @ beta[1:])
            out.append((math.exp(mu + s2 / 2), math.exp(mu), np.exp(mu + q)))
        return out

    return _grouped(cells, rows, fit_predict, ["unique_id", "ds", "y", *names], refit)


def har(rv: DataFrame, cells: DataFrame, n: int | None = None, targets: str | dict[int, str] = "direct", refit: int = REFIT) -> DataFrame:
    """Log regression on the day's, the week's and the month's mean."""
    return log_regression(har_features(rv), cells, ["l1", "l5", "l22"], 5, 22, n, targets, refit)


def dvol(rv: DataFrame, index: DataFrame, cells: DataFrame, n: int | None = None, targets: str | dict[int, str] = "direct", refit: int = REFIT) -> DataFrame:
    """Log regression on the daily variance that the latest volatility index
    (per cent a year, ``unique_id, ds, x``) stands for.  Days without an index
    are dropped; one of zero has no log, and its pairs are skipped."""
    rows = asof_join(rv, index.where(F.col("x").isNotNull())).withColumn("lx", 2 * log(F.col("x") / 100) - math.log(365))
    some = rows.where(F.col("x").isNotNull()).select("unique_id").distinct()
    made = log_regression(rows, cells.join(some, "unique_id", "left_semi"), ["lx"], 4, 1, n, targets, refit)
    nulls = [F.lit(None).cast("double").alias(c) for c in ("yhat", "median", *Q_COLUMNS)]
    none = cells.join(some, "unique_id", "left_anti").select("unique_id", "origin", F.col("h").cast("int").alias("h"), "ds_target", *nulls, F.lit(True).alias("fail"), F.lit("missing_dvol_history").alias("fail_reason"))
    return made.unionByName(none)


def nelder_mead(f, start: np.ndarray, steps: int = 160) -> np.ndarray:
    """Minimum of a function by the simplex method."""
    n = len(start)
    points = [start] + [start + 0.25 * (np.arange(n) == i) for i in range(n)]
    simplex = sorted(((f(p), i, p) for i, p in enumerate(points)), key=lambda s: s[0])
    for step in range(steps):
        centre = np.mean([p for _, _, p in simplex[:-1]], axis=0)
        worst = simplex[-1][2]
        tried = centre + (centre - worst)
        value = f(tried)
        if value < simplex[0][0]:
            far = centre + 2 * (centre - worst)
            if (v := f(far)) < value:
                tried, value = far, v
        elif value >= simplex[-2][0]:
            tried = centre + (0.5 if value < simplex[-1][0] else -0.5) * (centre - worst)
            value = f(tried)
            if value >= simplex[-1][0]:
                best = simplex[0][2]
                simplex = [simplex[0]] + [(f(q := best + 0.5 * (p - best)), i, q) for _, i, p in simplex[1:]]
                simplex.sort(key=lambda s: s[0])
                continue
        simplex[-1] = (value, step, tried)
        simplex.sort(key=lambda s: s[0])
    return simplex[0][2]


def garch_filter(r2: np.ndarray, down: np.ndarray, p: tuple[float, float, float, float]) -> np.ndarray:
    """Conditional variances, the last one for the next row.

    The recursion s <- drive + b s over pieces of 32 rows at once: within a
    piece a triangle of powers of b, then what each piece carries on.
    """
    w, a, g, b = p
    n, size, first = len(r2), 32, float(np.mean(r2))
    drive = np.zeros(-(-n // size) * size)
    drive[:n] = w + (a + g * down) * r2
    power = b ** np.arange(size + 1)
    back = np.subtract.outer(np.arange(size), np.arange(size))
    own = np.where(back >= 0, power[np.abs(back)], 0.0) @ drive.reshape(-1, size).T
    carried, s = [], first
    for last in own[-1].tolist():
        carried.append(s)
        s = power[size] * s + last
    return np.append(first, (own + np.outer(power[1:], carried)).T.ravel()[:n])


def garch_fit(r: np.ndarray, asymmetric: bool) -> tuple[float, float, float, float]:
    """Gaussian quasi-maximum likelihood with variance targeting."""
    if len(r) < 30:
        raise ValueError("insufficient_return_history")
    r2, down = r * r, (r < 0).astype(float) if asymmetric else np.zeros(len(r))
    v = float(np.mean(r2))
    if not v > 0:
        raise ValueError("invalid_context")

    def params(z: np.ndarray) -> tuple[float, float, float, float]:
        stay = 0.999 / (1 + math.exp(-z[0]))
        react = stay / (1 + math.exp(-z[1]))
        skew = react / (1 + math.exp(-z[2])) if asymmetric else 0.0
        a, g, b = react - skew, 2 * skew, stay - react
        return v * (1 - stay), a, g, b

    def loss(z: np.ndarray) -> float:
        s = garch_filter(r2, down, params(z))[:-1]
        return float(np.mean(np.log(s) + r2 / s))

    return params(nelder_mead(loss, np.array([3.0, -2.0, -2.0][: 3 if asymmetric else 2])))


def garch(returns: DataFrame, cells: DataFrame, asymmetric: bool = False, n: int = 1000, rv: DataFrame | None = None, targets: str | dict[int, str] = "direct", refit: int = REFIT) -> DataFrame:
    """GARCH(1,1), or GJR with its leverage term, on returns times 100; the
    forecast is the variance of the ``h``-th row ahead, or the sum up to it.

    With the realised variances ``rv``, deciles come from their ratios to the
    conditional variances of the same rows, or of blocks back from the origin
    to ``h`` times the variance of the row before.
    """

    fitted: dict[tuple, tuple] = {}

    def fit_predict(rows: pd.DataFrame, known: np.ndarray, h: int):
        r, real = 100 * rows["ret"].to_numpy("float64"), rows["y"].to_numpy("float64")
        has = np.isfinite(r)
        first = np.flatnonzero(has[: known[0]])[-n:]
        # Horizons share fits.
        key = (rows["unique_id"].iloc[0], int(known[0]))
        if key not in fitted:
            fitted[key] = garch_fit(r[first], asymmetric)
        w, a, g, b = p = fitted[key]
        stay, out = a + g / 2 + b, []
        for k in known:
            at = np.flatnonzero(has[:k])[-n:]
            x = r[at]
            path = garch_filter(x * x, (x < 0).astype(float) * asymmetric, p) / 1e4
            steps, s = [], float(path[-1])
            for _ in range(h):
                steps.append(s)
                s = w / 1e4 + stay * s
            point = sum(steps) if summed(targets, h) else steps[-1]
            past = np.full(k, np.nan)
            past[at] = path[:-1]
            there = np.flatnonzero(np.isfinite(real[:k]))
            if summed(targets, h):
                start, total = _tail(real[there], h)
                ratios = total / (h * past[there[start - 1]])
            else:
                ratios = real[there] / past[there]
            ratios = ratios[np.isfinite(ratios) & (ratios > 0)]
            out.append((point, point, point * np.quantile(ratios, DECILES) if len(ratios) >= PAIRS else None))
        return out

    rows = returns.select("unique_id", "ds", "ret")
    seen = rv.select("unique_id", "ds", "y") if rv is not None else rows.select("unique_id", "ds", F.lit(None).cast("double").alias("y"))
    return _grouped(cells, rows.join(seen, ["unique_id", "ds"], "full_outer"), fit_predict, ["unique_id", "ds", "ret", "y"], refit)


def _smooth(y: np.ndarray, alpha: float, beta: float, gamma: float, season: int, trend: bool, cyclic: bool):
    """Additive exponential smoothing: residuals and the final state."""
    level = float(np.mean(y[:season]))
    slope = float(np.mean(y[season : 2 * season] - y[:season]) / season) if trend else 0.0
    cycle = (y[:season] - level).tolist() if cyclic else [0.0] * season
    errors = []
    for i, x in enumerate(y.tolist()):
        e = x - (level + slope + cycle[i % season])
        errors.append(e)
        level += slope + alpha * e
        slope += alpha * beta * e if trend else 0.0
        cycle[i % season] += gamma * e if cyclic else 0.0
    return np.array(errors), level, slope, cycle


def ets(panel: DataFrame, cells: DataFrame, season: int = 7, n: int = 400, refit: int = REFIT) -> DataFrame:
    """Additive exponential smoothing with or without trend and season, chosen
    by the corrected information criterion; Gaussian deciles."""
    z = np.array([-1.281552, -0.841621, -0.524401, -0.253347, 0.0, 0.253347, 0.524401, 0.841621, 1.281552])

    def fit_predict(rows: pd.DataFrame, known: np.ndarray, h: int):
        y = rows["y"].to_numpy("float64")
        first = y[max(0, known[0] - n) : known[0]]
        if len(first) < 2 * season:
            raise ValueError("insufficient_history")
        best = None
        for trend, cyclic in ((False, False), (True, False), (False, True), (True, True)):
            for alpha in (0.05, 0.2, 0.5, 0.9):
                spec = (alpha, 0.1, 0.05, season, trend, cyclic)
                e = _smooth(first, *spec)[0]
                k, m = 3 + 2 * trend + (1 + season) * cyclic, len(e)
                score = m * math.log(float(np.mean(e * e)) + 1e-300) + 2 * k + 2 * k * (k + 1) / max(1, m - k - 1)
                if best is None or score < best[0]:
                    best = (score, spec)
        out = []
        for at in known:
            x = y[max(0, at - n) : at]
            e, level, slope, cycle = _smooth(x, *best[1])
            mean = level + h * slope + cycle[(len(x) + h - 1) % season]
            alpha = best[1][0]
            sd = float(np.std(e)) * math.sqrt(1 + (h - 1) * alpha * alpha)
            out.append((mean, mean, mean + sd * z))
        return out

    return _grouped(cells, panel.where(F.col("y").isNotNull()), fit_predict, ["unique_id", "ds", "y"], refit)


def theta(panel: DataFrame, cells: DataFrame, season: int = 7, n: int = 400, refit: int = REFIT) -> DataFrame:
    """The theta method: half the trend line, half smoothing of the doubled
    curvature, on data without their weekly pattern; residual deciles."""

    def fit_predict(rows: pd.DataFrame, known: np.ndarray, h: int):
        y, out, alpha = rows["y"].to_numpy("float64"), [], None
        for at in known:
            x = y[max(0, at - n) : at]
            m = len(x)
            if m < 2 * season:
                out.append("insufficient_history")
                continue
            cycle = np.array([np.mean(x[i::season]) for i in range(season)]) - np.mean(x)
            flat = x - cycle[np.arange(m) % season]
            b, a = np.polyfit(np.arange(m), flat, 1)
            doubled = 2 * flat - (a + b * np.arange(m))
            if alpha is None:
                alpha = min((0.05, 0.1, 0.2, 0.4, 0.8), key=lambda w: float(np.mean(_smooth(doubled, w, 0, 0, season, False, False)[0] ** 2)))
            e, level, _, _ = _smooth(doubled, alpha, 0, 0, season, False, False)
            mean = 0.5 * (a + b * (m - 1 + h)) + 0.5 * level + cycle[(m + h - 1) % season]
            out.append((mean, mean, mean + np.quantile(0.5 * e, DECILES)))
        return out

    return _grouped(cells, panel.where(F.col("y").isNotNull()), fit_predict, ["unique_id", "ds", "y"], refit)


def trend_reference(panel: DataFrame, cells: DataFrame, n: int = 400, refit: int = REFIT) -> DataFrame:
    """A reference model with a point forecast only: ridge regression on a
    trend and yearly and weekly Fourier terms."""

    def design(days: np.ndarray) -> np.ndarray:
        t = days.astype("datetime64[D]").astype("int64").astype(float)
        terms = [np.ones(len(t)), (t - t.mean()) / 365.25 if len(t) > 1 else np.zeros(len(t))]
        for period, order in ((365.25, 3), (7.0, 3)):
            for k in range(1, order + 1):
                terms += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
        return np.column_stack(terms)

    def fit_predict(rows: pd.DataFrame, known: np.ndarray, h: int):
        days, y, out = pd.to_datetime(rows["ds"]).to_numpy(), rows["y"].to_numpy("float64"), []
        for k in known:
            if k < 14:
                out.append("insufficient_history")
                continue
            d = days[max(0, k - n) : k]
            both = design(np.append(d, d[-1] + np.timedelta64(h, "D")))
            x, v = both[:-1], y[max(0, k - n) : k]
            beta = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ v)
            out.append((float(both[-1] @ beta), None, None))
        return out

    return _grouped(cells, panel.where(F.col("y").isNotNull()), fit_predict, ["unique_id", "ds", "y"], refit)


def external(panel: DataFrame, cells: DataFrame, backend, context: int = 512, refit: int = REFIT) -> DataFrame:
    """A slot for a model outside: ``backend(list of contexts, h) -> list of
    (mean, nine deciles)`` is called once for each refit block."""

    def fit_predict(rows: pd.DataFrame, known: np.ndarray, h: int):
        y = rows["y"].to_numpy("float64")
        made = backend([y[max(0, k - context) : k] for k in known], h)
        return [(mean, q[4], sorted(q)) for mean, q in made]

    return _grouped(cells, panel.where(F.col("y").isNotNull()), fit_predict, ["unique_id", "ds", "y"], refit)


def stub_backend(contexts: list[np.ndarray], h: int) -> list[tuple[float, list[float]]]:
    """Deterministic stand-in: mean and deciles of the last 64 values."""
    return [(float(np.mean(c[-64:])), np.quantile(c[-64:], DECILES).tolist()) for c in contexts]


def boosted_trees(panel: DataFrame, cells: DataFrame, h: int, refit: str, iterations: int = 12, until: str | None = None) -> DataFrame:
    """Gradient-boosted models over all series, one for the mean and one with
    the absolute loss for the median, fitted on rows whose target is known at
    ``refit``, with in-sample residual deciles; for origins from then on, before
    ``until``."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = [f"lag_{k}" for k in LAGS] + ["rm7", "rm28", "dow", "month", "month_end", "series"]
    rows = lag_features(panel).join(panel.select("unique_id", "ds", "y", F.lead("y", h).over(series()).alias("target"), F.lead("ds", h).over(series()).alias("at")), ["unique_id", "ds"])
    rows = rows.dropna(subset=[f"lag_{LAGS[-1]}", "y"])
    rows = StringIndexer(inputCol="unique_id", outputCol="series", handleInvalid="keep").fit(rows).transform(rows)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    train = rows.where(F.col("target").isNotNull() & (F.col("at") <= F.to_date(F.lit(refit)))).select("unique_id", "ds", "features", "target")
    asked = {"featuresCol": "features", "labelCol": "target", "maxIter": iterations, "maxDepth": 4, "seed": 7}
    mean, middle = GBTRegressor(**asked).fit(train), GBTRegressor(**asked, lossType="absolute", predictionCol="middle").fit(train)
    resid = mean.transform(train).select((F.col("target") - F.col("prediction")).alias("r")).agg(F.percentile("r", F.array(*map(F.lit, DECILES))).alias("q")).first()["q"]
    made = middle.transform(mean.transform(rows)).select("unique_id", F.col("ds").alias("origin"), "prediction", "middle")
    mine = cells.where((F.col("h") == h) & (F.col("origin") >= F.to_date(F.lit(refit))))
    mine = (mine.where(F.col("origin") < F.to_date(F.lit(until))) if until else mine).join(made, ["unique_id", "origin"], "left")
    q = F.array(*[F.col("prediction") + F.lit(float(r)) for r in resid])
    return _finish(mine, F.col("prediction"), q, F.when(F.col("prediction").isNull(), "insufficient_history"), F.col("middle"))


def boosted_refits(panel: DataFrame, cells: DataFrame, h: int, every: int = REFIT, iterations: int = 12) -> DataFrame:
    """:func:`boosted_trees` fitted again at every ``every``-th day that has an
    origin.  The days are a schedule's, so few; each fit is a job over all rows."""
    days = [str(r.origin) for r in cells.where(F.col("h") == h).select("origin").distinct().orderBy("origin").collect()][::every]
    out = None
    for day, until in zip(days, [*days[1:], None]):
        part = boosted_trees(panel, cells, h, day, iterations, until)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else boosted_trees(panel, cells, h, "1970-01-01", iterations)


def validated(forecasts: DataFrame, is_positive: Column, tolerance: float = 1e-12) -> DataFrame:
    """The forecast contract: a forecast that counts has a finite mean; deciles
    are all there and monotone or all null; where values must be positive a
    forecast that isn't fails and is emptied."""
    from ..functions.columns import finite

    q = q_array()
    whole = F.forall(q, lambda x: x.isNotNull() & ~F.isnan(x))
    steps = F.zip_with(F.slice(q, 1, 8), F.slice(q, 2, 8), lambda a, b: b >= a - tolerance)
    mono = F.coalesce(whole & F.forall(steps, lambda x: x), F.lit(False))
    stored = F.coalesce(F.col("fail"), F.lit(False))
    reason = (
        F.when(stored, F.coalesce("fail_reason", F.lit("unknown")))
        .when(finite("yhat").isNull(), "missing_forecast")
        .when(F.coalesce(is_positive, F.lit(False)) & (F.col("yhat") <= 0), "nonpositive_forecast")
    )
    keep = reason.isNull()
    return forecasts.withColumns(
        {"fail": ~keep, "fail_reason": reason, "yhat": F.when(keep, F.col("yhat")), "median": F.when(keep, F.col("median"))}
        | {c: F.when(keep & mono, F.col(c)) for c in Q_COLUMNS}
    )


#: Models by name: the tasks they serve and whether they are for reference only.
REGISTRY = {
    "RW": ({"price"}, False),
    "NaivePrev": ({"rv"}, False),
    "EWMA": ({"rv"}, False),
    "GARCH": ({"rv"}, False),
    "GJR-GARCH": ({"rv"}, False),
    "HAR-RV": ({"rv"}, False),
    "DVOL": ({"rv"}, False),
    "SeasonalNaive7": ({"volume"}, False),
    "SeasonalMedian4": ({"volume"}, False),
    "AutoETS": ({"price", "volume"}, False),
    "AutoTheta": ({"price", "volume"}, False),
    "BoostedTrees": ({"price", "volume", "rv"}, False),
    "External": ({"price", "volume", "rv"}, False),
    "Trend": ({"price", "volume"}, True),
}


def supports(model: str, uid: Column | str = "unique_id") -> Column:
    """Whether a model applies to a series: GARCH to realised variances, its
    asymmetric form to the equity index only, DVOL to assets with an index."""
    uid = F.col(uid) if isinstance(uid, str) else uid
    if model == "GJR-GARCH":
        return uid == "RV_N225_GK"
    if model == "DVOL":
        return uid.isin("RV_BTC", "RV_ETH")
    return uid.startswith("RV_") if model == "GARCH" else uid.isNotNull()


def reference_models(names: list[str]) -> list[str]:
    """Of these the ones that reports show beside the others only."""
    return [n for n in names if REGISTRY.get(n, (None, False))[1]]


def resolve_models(task: str, names: list[str] | None = None) -> list[str]:
    """Names of a task's models, all or the ones asked for, case-insensitive."""
    own = {n.lower(): n for n, (tasks, _) in REGISTRY.items() if task in tasks}
    if names is None:
        return list(own.values())
    unknown = [n for n in names if n.lower() not in own]
    if unknown:
        raise ValueError(f"no such model for {task}: {', '.join(unknown)}")
    found = [own[n.lower()] for n in names]
    if len(set(found)) != len(found):
        raise ValueError("a model is named twice")
    return found
