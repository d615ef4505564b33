"""Schedules and rolling features; each on one shuffle by series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log
from .panel import series


def origin_schedule(panel: DataFrame, start: str, end: str, horizons: list[tuple[int, int]]) -> DataFrame:
    """Forecast cells ``(unique_id, origin, h, ds_target)``.

    Time steps are observed rows of each series.  An origin is a row within the
    window whose ``h``-th next row is within it too; of these every ``step``-th
    per series and horizon is taken.  ``horizons``: pairs ``(h, step)``.
    """
    rows = panel.where(F.col("y").isNotNull()).select("unique_id", F.col("ds").alias("origin"), "ds")
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(s).alias("step"), F.lead("ds", h).over(series()).alias("ds_target")) for h, s in horizons])
    cells = rows.withColumn("ahead", ahead).withColumn("c", F.explode("ahead")).select("unique_id", "origin", "c.*")
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    cells = cells.where((F.col("origin") >= a) & (F.col("origin") <= b) & (F.col("ds_target") <= b))
    nth = F.row_number().over(Window.partitionBy("unique_id", "h").orderBy("origin")) - 1
    return cells.withColumn("_n", nth).where(F.col("_n") % F.col("step") == 0).select("unique_id", "origin", "h", "ds_target")


LAGS = [*range(1, 15), 21, 28]


def lag_features(panel: DataFrame) -> DataFrame:
    """Lags, rolling means and calendar features of each row."""
    lags = [F.lag("y", k).over(series()).alias(f"lag_{k}") for k in LAGS]
    means = [F.avg("y").over(series().rowsBetween(1 - k, 0)).alias(f"rm{k}") for k in (7, 28)]
    return panel.select(
        "unique_id", "ds", *lags, *means, F.weekday("ds").alias("dow"), F.month("ds").alias("month"), (F.col("ds") == F.last_day("ds")).cast("int").alias("month_end")
    )


def har_features(panel: DataFrame) -> DataFrame:
    """Logs of the value and of its means over 5 and 22 rows; null unless all
    22 rows are positive."""
    w22 = series().rowsBetween(-21, 0)
    whole = (F.count("y").over(w22) == 22) & (F.min("y").over(w22) > 0)
    parts = [("l1", F.col("y")), ("l5", F.avg("y").over(series().rowsBetween(-4, 0))), ("l22", F.avg("y").over(w22))]
    return panel.select("unique_id", "ds", "y", *[F.when(whole, log(x)).alias(n) for n, x in parts])


def vol_proxy(panel: DataFrame, rows: int = 21) -> DataFrame:
    """Rolling population deviation of changes; 0 where there is none."""
    change = panel.withColumn("_d", F.col("y") - F.lag("y").over(series()))
    return change.select("unique_id", "ds", "y", F.coalesce(F.stddev_pop("_d").over(series().rowsBetween(1 - rows, 0)), F.lit(0.0)).alias("vol_proxy"))


def rolling_sum(panel: DataFrame, h: int) -> DataFrame:
    """``s``: sum of the ``h`` rows up to each row, null unless all are there;
    ``rn``: the row's number; ``start_ds``: the first row's day."""
    w = series().rowsBetween(1 - h, 0)
    return panel.select(
        "unique_id", "ds", "y", F.row_number().over(series()).alias("rn"), F.when(F.count("y").over(w) == h, F.sum("y").over(w)).alias("s"), F.lag("ds", h).over(series()).alias("before_ds")
    )
