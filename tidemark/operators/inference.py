"""Statistical tests over loss tables.

Statistics that are sums are aggregates with partial combination; those that
resample, or need a tail of the t distribution, are grouped maps over one small
group each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.columns import hln_factor, kupiec_lr, newey_west_lag, ratio, xlogy


def dm_statistic(pairs: DataFrame, keys: list[str], h: int, max_lag: int | None = None, a: str = "loss", b: str = "bench_loss", order: str = "origin") -> DataFrame:
    """Diebold-Mariano statistic with Bartlett weights and the small-sample
    factor: ``n, lag, dbar, statistic, reason``.

    Autocovariances come from one window.  Their number, the lag of
    :func:`newey_west_lag` for the largest group, grows slowly: 12 at 14,000
    rows, 31 at a million.  It is counted first unless ``max_lag`` is given; a
    group that needs more than that raises.
    """
    if max_lag is None:
        most = pairs.groupBy(*keys).count().agg(F.max(newey_west_lag(F.col("count").cast("double")))).first()[0]
        max_lag = max(0, most or 0)
    w, all_ = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    d = pairs.withColumn("_d", F.col(a) - F.col(b)).withColumn("_c", F.col("_d") - F.avg("_d").over(all_))
    sums = [F.sum(F.col("_c") * F.col(f"_c{k}")).alias(f"g{k}") for k in range(max_lag + 1)]
    d = d.select(*keys, "_d", "_c", *[(F.col("_c") if not k else F.lag("_c", k).over(w)).alias(f"_c{k}") for k in range(max_lag + 1)])
    out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("dbar"), F.max(F.abs("_d")).alias("_most"), *sums)
    out = out.withColumn("lag", F.least(newey_west_lag(F.col("n")), F.col("n").cast("int") - 1))
    out = out.withColumn("lag", F.when(F.col("lag") > max_lag, F.raise_error(F.lit("a group needs more lags than max_lag")).cast("int")).otherwise(F.col("lag")))
    var = F.col("g0") / F.col("n")
    for k in range(1, max_lag + 1):
        weight = F.when(F.col("lag") >= k, 2 * (1 - k / (F.col("lag") + 1.0))).otherwise(0.0)
        var = var + weight * F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / F.col("n")
    out = out.withColumn("_v", var).withColumn("_f", hln_factor(F.col("n").cast("double"), h))
    reason = (
        F.when(F.col("n") < 2, "too few pairs")
        .when(F.col("_most") == 0, F.lit(None))
        .when(F.col("_v") < 0, "variance below zero")
        .when(F.col("_v") == 0, "variance of zero")
        .when(F.col("_f").isNull() | (F.col("_f") == 0), "no small-sample factor")
    )
    stat = F.when(F.col("_most") == 0, F.lit(0.0)).when(F.col("_v") > 0, F.col("_f") * F.col("dbar") / F.sqrt(F.col("_v") / F.col("n")))
    return out.select(*keys, "n", "lag", "dbar", F.when(reason.isNull(), stat).alias("statistic"), reason.alias("reason"))


def with_pvalue(df: DataFrame, fn, *columns: str, name: str = "pvalue") -> DataFrame:
    """A p-value column by ``fn`` of other columns, in Arrow batches."""

    @F.pandas_udf("double")
    def p(*cols: pd.Series) -> pd.Series:
        return pd.Series([math.nan if any(pd.isna(x) for x in v) else float(fn(*v)) for v in zip(*cols)]).astype("float64")

    return df.withColumn(name, F.nanvl(p(*columns), F.lit(None).cast("double")))


def dm_test(pairs: DataFrame, keys: list[str], h: int) -> DataFrame:
    return with_pvalue(dm_statistic(pairs, keys, h), lambda s, n: 2 * special.t_sf(abs(s), n - 1), "statistic", "n")


def pt_statistic(rows: DataFrame, keys: list[str], actual: Column, predicted: Column) -> DataFrame:
    """Pesaran-Timmermann directional accuracy: ``n, hit_rate, expected,
    statistic`` (null for a variance that isn't positive)."""
    up = rows.select(*keys, (actual > 0).cast("double").alias("y"), (predicted > 0).cast("double").alias("x")).dropna()
    g = up.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("hit_rate"), F.avg("y").alias("py"), F.avg("x").alias("px"))
    py, px, n = F.col("py"), F.col("px"), F.col("n")
    g = g.withColumn("expected", py * px + (1 - py) * (1 - px))
    e = F.col("expected")
    var = e * (1 - e) / n - (
        F.pow(2 * py - 1, 2) * px * (1 - px) / n + F.pow(2 * px - 1, 2) * py * (1 - py) / n + 4 * px * py * (1 - px) * (1 - py) / (n * n)
    )
    return g.withColumn("_v", var).select(*keys, "n", "hit_rate", "expected", F.when((F.col("_v") > 0) & (n >= 2), (F.col("hit_rate") - e) / F.sqrt("_v")).alias("statistic"))


def pt_test(rows: DataFrame, keys: list[str], actual: Column, predicted: Column) -> DataFrame:
    return with_pvalue(pt_statistic(rows, keys, actual, predicted), lambda s: 2 * special.normal_sf(abs(s)), "statistic")


def sign_counts(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    v = F.col(x)
    return df.groupBy(*keys).agg(F.count_if(v > 0).alias("n_positive"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"))


def sign_test(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    return with_pvalue(sign_counts(df, keys, x), lambda a, b: special.sign_pvalue(int(a), int(b)), "n_positive", "n_negative")


def kupiec(rows: DataFrame, keys: list[str], violation: Column, p: float) -> DataFrame:
    v = rows.select(*keys, violation.cast("int").alias("v")).dropna()
    g = v.groupBy(*keys).agg(F.sum("v").alias("n_viol"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("lr_uc", kupiec_lr(F.col("n_viol"), F.col("n"), p))


def kupiec_test(rows: DataFrame, keys: list[str], violation: Column, p: float) -> DataFrame:
    return with_pvalue(kupiec(rows, keys, violation, p), lambda x: special.chi2_sf(x, 1), "lr_uc")


def christoffersen(rows: DataFrame, keys: list[str], violation: Column, p: float, order: str = "origin") -> DataFrame:
    """Independence and conditional coverage: transitions, ``lr_ind, lr_cc,
    reason``; null statistics where a state or transition doesn't occur."""
    v = rows.select(*keys, order, violation.cast("int").alias("v")).dropna()
    v = v.withColumn("u", F.lag("v").over(Window.partitionBy(*keys).orderBy(order)))
    count = lambda a, b: F.count_if((F.col("u") == a) & (F.col("v") == b))
    g = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("n_viol"), count(0, 0).alias("n00"), count(0, 1).alias("n01"), count(1, 0).alias("n10"), count(1, 1).alias("n11")
    )
    n00, n01, n10, n11, n = (F.col(c) for c in ("n00", "n01", "n10", "n11", "n"))
    reason = (
        F.when(n < 2, "too few observations")
        .when((F.col("n_viol") == 0) | (F.col("n_viol") == n), "only one state occurs")
        .when((n00 + n01 == 0) | (n10 + n11 == 0), "a state has no successor")
    )
    d = lambda a, b: ratio(a.cast("double"), b.cast("double"))
    ll = lambda k, m, q: xlogy(k, q) + xlogy(m - k, 1 - q)
    own = ll(n01, n00 + n01, d(n01, n00 + n01)) + ll(n11, n10 + n11, d(n11, n10 + n11))
    lr = F.greatest(F.lit(0.0), -2 * (ll(n01 + n11, n - 1, d(n01 + n11, n - 1)) - own))
    g = g.withColumn("reason", reason).withColumn("lr_ind", F.when(reason.isNull(), lr))
    return g.withColumn("lr_cc", F.col("lr_ind") + kupiec_lr(F.col("n_viol"), n, p)).select(*keys, "n", "n_viol", "n00", "n01", "n10", "n11", "lr_ind", "lr_cc", "reason")


def christoffersen_test(rows: DataFrame, keys: list[str], violation: Column, p: float, order: str = "origin") -> DataFrame:
    out = with_pvalue(christoffersen(rows, keys, violation, p, order), lambda x: special.chi2_sf(x, 1), "lr_ind", name="p_ind")
    return out.withColumn("p_cc", F.exp(-F.col("lr_cc") / 2))


def holm(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Step-down adjusted p-values within each family; null passes through."""
    parts = [*family, F.col(p).isNull()]
    w = Window.partitionBy(*parts).orderBy(p, tie)
    left = F.count(p).over(Window.partitionBy(*family)) - F.row_number().over(w) + 1
    scaled = df.withColumn("_s", F.when(F.col(p).isNotNull(), left * F.col(p)))
    run = F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn("holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), run))).drop("_s")


def block_index(n: int, block: int, reps: int, seed: int) -> np.ndarray:
    """Rows of ``reps`` moving-block resamples of ``n`` rows."""
    block = max(1, min(block, n))
    many = -(-n // block)
    starts = np.random.default_rng(seed).integers(0, n - block + 1, size=(reps, many))
    return (starts[:, :, None] + np.arange(block)).reshape(reps, -1)[:, :n]


def bootstrap_mean(x: np.ndarray, block: int, reps: int = 2000, seed: int = 0) -> tuple[float, float, float, float]:
    """Mean, 95 % interval and two-sided p-value by moving blocks."""
    x = x[np.isfinite(x)]
    if not len(x):
        return (math.nan,) * 4
    draws = x[block_index(len(x), block, reps, seed)].mean(1)
    low, high = np.percentile(draws, (2.5, 97.5))
    p = 2 * min((np.sum(draws <= 0) + 1) / (reps + 1), (np.sum(draws >= 0) + 1) / (reps + 1))
    return float(x.mean()), float(low), float(high), float(min(1.0, p))


def _per_group(df: DataFrame, keys: list[str], columns: list[str], order: list[str], schema: str, fn) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = fn(pdf.sort_values(order) if order else pdf)
        return pd.DataFrame([[*key, *made]], columns=[*keys, *names])

    types = dict(df.dtypes)
    whole = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema
    return df.select(*dict.fromkeys([*keys, *columns, *order])).groupBy(*keys).applyInPandas(run, whole)


def mbb_mean(df: DataFrame, keys: list[str], x: str, order: list[str], block: int, reps: int = 2000, seed: int = 0) -> DataFrame:
    return _per_group(df, keys, [x], order, "estimate double, ci_low double, ci_high double, pvalue double", lambda p: bootstrap_mean(p[x].to_numpy("float64"), block, reps, seed))


def tost(model: np.ndarray, bench: np.ndarray, margin: float = 1.05, block: int = 1, reps: int = 2000, seed: int = 0) -> tuple:
    """Non-inferiority of the relative mean absolute error: estimate, 90 %
    interval, p-value and whether its upper end is below the margin."""
    ok = np.isfinite(model) & np.isfinite(bench)
    a, b = np.abs(model[ok]), np.abs(bench[ok])
    if not len(a) or not b.mean() > 0:
        return math.nan, math.nan, math.nan, math.nan, False, int(len(a))
    estimate = a.mean() / b.mean()
    i = block_index(len(a), block, reps, seed)
    below = b[i].mean(1)
    draws = (a[i].mean(1)[below > 0]) / below[below > 0]
    low, high = np.percentile(draws, (5, 95))
    p = (np.sum(draws - estimate <= estimate - margin) + 1) / (len(draws) + 1)
    return float(estimate), float(low), float(high), float(p), bool(high < margin), int(len(a))


def tost_rel_mae(pairs: DataFrame, keys: list[str], margin: float = 1.05, block: int = 1, reps: int = 2000, seed: int = 0) -> DataFrame:
    return _per_group(
        pairs, keys, ["loss", "bench_loss"], ["origin", "unique_id"], "ratio double, ci_low double, ci_high double, pvalue double, reject boolean, n_used long",
        lambda p: tost(p["loss"].to_numpy("float64"), p["bench_loss"].to_numpy("float64"), margin, block, reps, seed),
    )


def model_confidence_set(losses: np.ndarray, names: list[str], size: float = 0.1, reps: int = 1000, block: int | None = None, seed: int = 0) -> dict[str, float]:
    """P-values of the range statistic with a stationary bootstrap, worst model
    first; a model whose p-value is above ``size`` belongs to the set."""
    n, m = losses.shape
    block = block or max(1, round(math.sqrt(n)))
    rng = np.random.default_rng(seed)
    fresh = rng.random((reps, n)) < 1 / block
    fresh[:, 0] = True
    start = rng.integers(0, n, (reps, n))
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
    index = (np.take_along_axis(start, at, 1) + np.arange(n) - at) % n
    draws = np.stack([losses[index, k].mean(1) for k in range(m)], 1)
    mean = losses.mean(0)
    left, out, most = list(range(m)), {}, 0.0
    while len(left) > 1:
        d = mean[left][:, None] - mean[left][None, :]
        b = draws[:, left][:, :, None] - draws[:, left][:, None, :] - d
        sd = np.sqrt((b * b).mean(0))
        np.fill_diagonal(sd, 1.0)
        sd[sd == 0] = 1.0
        t = d / sd
        p = float(np.mean(np.abs(b / sd).max((1, 2)) >= np.abs(t).max()))
        most = max(most, p)
        worst = left[int(t.max(1).argmax())]
        out[names[worst]] = most
        left.remove(worst)
    out[names[left[0]]] = 1.0
    return out


def mcs(matrix: DataFrame, models: list[str], size: float = 0.1, reps: int = 1000, seed: int = 0, least: int = 30) -> DataFrame:
    """``model, pvalue, included, reason`` from a complete loss matrix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unique_id", "origin"])
        if len(models) < 2 or pdf["origin"].nunique() < least:
            return pd.DataFrame([(m, None, None, "insufficient") for m in models], columns=["model", "pvalue", "included", "reason"])
        p = model_confidence_set(pdf[models].to_numpy("float64"), models, size, reps, None, seed)
        return pd.DataFrame([(m, p[m], p[m] > size, None) for m in models], columns=["model", "pvalue", "included", "reason"])

    return matrix.groupBy(F.lit(1).alias("_")).applyInPandas(run, "model string, pvalue double, included boolean, reason string")


def mde_empirical(df: DataFrame, keys: list[str], x: str, order: list[str], block: int, reps: int = 2000, seed: int = 0) -> DataFrame:
    """Minimum detectable effect from the bootstrap's standard error."""

    def one(p: pd.DataFrame) -> tuple:
        v = p[x].to_numpy("float64")
        v = v[np.isfinite(v)]
        if len(v) < 2:
            return math.nan, len(v)
        draws = v[block_index(len(v), block, reps, seed)].mean(1)
        df_ = max(2, len(v) - 1)
        return float((special.t_ppf(0.975, df_) + special.t_ppf(0.8, df_)) * np.std(draws, ddof=1)), len(v)

    return _per_group(df, keys, [x], order, "mde double, n long", one)


def primary_test(ratios: DataFrame, keys: list[str], reps: int = 2000, seed: int = 0) -> DataFrame:
    """Over per-series mean differences: their mean, the sign test, a bootstrap
    with blocks of one, and the effect in standard deviations beside what can be
    detected."""

    def one(p: pd.DataFrame) -> tuple:
        d = p["dbar"].to_numpy("float64")
        mean, low, high, pv = bootstrap_mean(d, 1, reps, seed)
        sign = special.sign_pvalue(int((d > 0).sum()), int((d < 0).sum()))
        sd = float(np.std(d, ddof=1)) if len(d) > 1 else math.nan
        return mean, sign, low, high, pv, abs(mean) / sd if sd > 0 else math.nan, special.mde(len(d)), len(d)

    schema = "dbar double, sign_p double, ci_low double, ci_high double, boot_p double, effect double, mde double, n_series long"
    return _per_group(ratios, keys, ["dbar"], ["unique_id"], schema, one)
