"""Column expressions: losses, transforms, classifications.

NaN and infinities count as missing: :func:`finite` turns them into null, and
no expression here returns NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The nine deciles and their column names.
DECILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
Q_COLUMNS = [f"q{round(100 * p)}" for p in DECILES]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """The value, or null where it isn't a finite number."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)


def positive(x: Column | str) -> Column:
    x = finite(x)
    return F.when(x > 0, x)


def log(x: Column | str) -> Column:
    return F.ln(positive(x))


def garman_klass(o, h, l, c) -> Column:
    """Daily variance from open, high, low and close."""
    return 0.5 * F.pow(log(_c(h)) - log(_c(l)), 2) - (2 * math.log(2) - 1) * F.pow(log(_c(c)) - log(_c(o)), 2)


def abs_error(y, f) -> Column:
    return F.abs(finite(y) - finite(f))


def qlike(y, f) -> Column:
    """y/f - ln(y/f) - 1; null unless both are positive."""
    ratio = positive(y) / positive(f)
    return ratio - F.ln(ratio) - 1


def pinball(y, q, tau: float) -> Column:
    d = finite(y) - finite(q)
    return F.greatest(tau * d, (tau - 1) * d)


def covered(y, lo, hi) -> Column:
    """1 inside the closed interval, 0 outside, null if anything is missing."""
    y, lo, hi = finite(y), finite(lo), finite(hi)
    return ((y >= lo) & (y <= hi)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def adapter_group(uid: Column | str) -> Column:
    """Class of a series by its identifier, as estimation windows need it."""
    uid = _c(uid)
    return (
        F.when(uid.startswith("VOL_"), "volume")
        .when(uid.startswith("RV_N225"), "rv_equity")
        .when(uid.startswith("RV_"), "rv_crypto")
        .when(uid.startswith("JGB_"), "rates")
        .when(uid.startswith("EUR"), "fx")
        .when(uid.startswith("N225"), "equity")
        .otherwise("crypto")
    )


def report_group(uid: Column | str) -> Column:
    """Class of a series as reports show it: variances go with their asset."""
    uid = _c(uid)
    return (
        F.when(uid.startswith("JGB_"), "rates")
        .when(uid.contains("N225"), "equity")
        .when(uid.startswith("EUR"), "fx")
        .otherwise("crypto")
    )


def is_special(uid: Column | str) -> Column:
    """Series that main tables leave out."""
    uid = _c(uid)
    return uid.isin("EURCNY", "EURKRW", "EURMXN") | uid.contains("XRP")


def return_id(uid: Column | str) -> Column:
    """The series of returns that belongs to one of realised variances; other
    identifiers are their own."""
    uid = _c(uid)
    asset = F.concat(F.regexp_replace(uid, "^RV_", ""), F.lit("-USD"))
    return F.when(uid == "RV_N225_GK", "N225").when(uid.startswith("RV_"), asset).otherwise(uid)


def kth(xs: Column | str, k: Column | int) -> Column:
    """The ``k``-th smallest of an array's values, from 1; null beyond them."""
    some = F.array_sort(F.filter(_c(xs), lambda x: x.isNotNull()))
    return F.try_element_at(some, F.lit(k) if isinstance(k, int) else k)


def levels_to_deciles(name: str) -> Column:
    """Nine deciles out of a point forecast and the ends of its central
    intervals, columns like ``name-lo-80``."""
    low = [F.col(f"`{name}-lo-{x}`") for x in (80, 60, 40, 20)]
    high = [F.col(f"`{name}-hi-{x}`") for x in (20, 40, 60, 80)]
    return F.array(*[x.cast("double") for x in (*low, F.col(name), *high)])


def value_column(columns: list[str]) -> str:
    """The column that holds a table's values."""
    for name in ("y", "rv", "value"):
        if name in columns:
            return name
    raise ValueError("the table has no column of values")


def quantile_column(columns: list[str], p: float) -> str:
    """The column of a quantile, however its name writes the probability."""
    for name in (f"q{round(100 * p):02d}", f"q{p:g}", f"q_{p:g}", f"{p:g}", *(["median"] if p == 0.5 else [])):
        if name in columns:
            return name
    raise ValueError(f"the table has no column of the quantile {p:g}")


def q_array() -> Column:
    return F.array(*Q_COLUMNS)


def spread_deciles(quantiles: Column) -> list[Column]:
    """Nine columns out of an array of nine."""
    return [F.try_element_at(quantiles, F.lit(i + 1)).alias(c) for i, c in enumerate(Q_COLUMNS)]


def monotone_quantiles(q: Column) -> Column:
    """The deciles in order; null unless all nine are finite."""
    good = F.forall(q, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.when(F.coalesce(good, F.lit(False)), F.array_sort(q))


def series_weekday(ds: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_c(ds))


def newey_west_lag(n: Column) -> Column:
    """The largest integer below 4 (n / 100)^(2/9)."""
    return (F.ceil(4 * F.pow(n / 100.0, 2.0 / 9.0)) - 1).cast("int")


def hln_factor(n: Column, h: Column | int) -> Column:
    h = F.lit(h) if isinstance(h, int) else h
    x = (n + 1 - 2 * h + h * (h - 1) / n) / n
    return F.when(x >= 0, F.sqrt(x))


def xlogy(x: Column, p: Column) -> Column:
    """x ln p with 0 ln 0 = 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * log(p))


def kupiec_lr(n_viol: Column, n: Column, p: float) -> Column:
    """Likelihood ratio of unconditional coverage."""
    fit = ratio(n_viol.cast("double"), n.cast("double"))
    null = xlogy(n_viol, F.lit(p)) + xlogy(n - n_viol, F.lit(1 - p))
    own = xlogy(n_viol, fit) + xlogy(n - n_viol, 1 - fit)
    return F.greatest(F.lit(0.0), -2 * (null - own))


def overlap_design_effect(h: int, step: int) -> float:
    """Variance inflation of overlapping horizons: 1 + 2 sum max(0, h - k step) / h."""
    return 1.0 + 2 * sum(max(0, h - k * step) / h for k in range(1, math.ceil(h / step)))
