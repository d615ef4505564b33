"""Operators on long panels ``(unique_id, ds, y)``.

All of them shuffle at most once, by ``unique_id``; windows with the same
partition and order share that shuffle and its sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import adapter_group, finite, garman_klass, log, report_group

def series() -> WindowSpec:
    """Rows of each series in the order of days."""
    return Window.partitionBy("unique_id").orderBy("ds")


def canonical(df: DataFrame, uid: str = "unique_id", ds: str = "ds", y: str = "y") -> DataFrame:
    """Typed long rows with null for anything that isn't a finite number."""
    return df.select(F.col(uid).cast("string").alias("unique_id"), F.to_date(ds).alias("ds"), finite(y).alias("y")).where(F.col("ds").isNotNull())


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_priority(history: DataFrame, current: DataFrame) -> DataFrame:
    """Union of two panels in which the current one wins per series and day."""
    both = history.withColumn("_rank", F.lit(0)).unionByName(current.withColumn("_rank", F.lit(1)))
    return both.groupBy("unique_id", "ds").agg(F.max_by("y", "_rank").alias("y"))


def melt(wide: DataFrame, ds: str, values: list[str], prefix: str) -> DataFrame:
    """One row per date and value column; missing values go."""
    long = wide.unpivot([ds], values, "name", "y")
    return long.select(F.concat(F.lit(prefix), "name").alias("unique_id"), F.col(ds).alias("ds"), "y").where(F.col("y").isNotNull())


def asof_slice(panel: DataFrame, origins: list[str]) -> DataFrame:
    """What is known at each origin: rows up to that day."""
    days = F.explode(F.array(*[F.to_date(F.lit(o)) for o in origins]))
    return panel.withColumn("origin", days).where(F.col("ds") <= F.col("origin"))


def asof_summary(panel: DataFrame, origins: list[str]) -> DataFrame:
    """Rows, last day and last value known at each origin: each row is read
    once, whatever the number of origins."""
    return (
        asof_slice(panel, origins)
        .groupBy("origin", "unique_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("ds").alias("last_ds"), F.max_by("y", "ds").alias("last_y"))
    )


def estimation_tail(panel: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each series."""
    w = Window.partitionBy("unique_id").orderBy(F.col("ds").desc())
    return panel.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def block_sums(panel: DataFrame, h: int, alignment: str) -> DataFrame:
    """Sums of non-overlapping blocks of ``h`` rows from the series' start or up
    to its end; null if the block has a null."""
    whole = Window.partitionBy("unique_id")
    rows = panel.withColumn("_i", F.row_number().over(series()) - 1)
    skip = F.count(F.lit(1)).over(whole) % h if alignment == "end" else F.lit(0)
    rows = rows.withColumn("_b", F.floor((F.col("_i") - skip) / h)).where(F.col("_b") >= 0)
    blocks = rows.groupBy("unique_id", "_b").agg(
        F.min("ds").alias("ds"), F.max("ds").alias("block_end_ds"), F.count(F.lit(1)).alias("_n"), F.count("y").alias("_have"), F.sum("y").alias("_y")
    )
    return blocks.where(F.col("_n") == h).select("unique_id", "ds", F.when(F.col("_have") == h, F.col("_y")).alias("y"), "block_end_ds")


def gk_daily(ohlc: DataFrame) -> DataFrame:
    return ohlc.select("unique_id", "ds", garman_klass("open", "high", "low", "close").alias("rv"))


def open_close_returns(ohlc: DataFrame) -> DataFrame:
    return ohlc.select("unique_id", "ds", (log("close") - log("open")).alias("ret"))


def realized_variance(candles: DataFrame, per_day: int) -> DataFrame:
    """Sum of squared log changes within each UTC day that has all of its
    ``per_day`` candles on the grid with positive closes.

    Every day from a series' first to its last is there; others than complete
    ones have null and a reason.  ``candles``: ``unique_id, ts, close``, one row
    per candle.
    """
    step = 86400 // per_day
    second = F.unix_timestamp(F.col("ts").cast("timestamp")) if dict(candles.dtypes)["ts"] != "timestamp_ntz" else F.unix_timestamp(F.col("ts"))
    rows = candles.select("unique_id", F.to_date("ts").alias("ds"), (second % 86400).alias("s"), log("close").alias("p"))
    day = Window.partitionBy("unique_id", "ds").orderBy("s")
    days = (
        rows.withColumn("d", F.col("p") - F.lag("p").over(day))
        .groupBy("unique_id", "ds")
        .agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("n_pos"), F.sum(F.pow("d", 2)).alias("v"), F.max(F.col("s") % step).alias("off"))
    )
    grid = days.groupBy("unique_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b")).select("unique_id", F.explode(F.sequence("a", "b")).alias("ds"))
    whole = (F.col("n") == per_day) & (F.col("n_pos") == per_day) & (F.col("off") == 0)
    rv = F.when(F.coalesce(whole, F.lit(False)), F.col("v"))
    return grid.join(days, ["unique_id", "ds"], "left").select(
        "unique_id",
        "ds",
        rv.alias("rv"),
        F.greatest(F.lit(0.0), F.coalesce(F.col("n") - 1, F.lit(0)).cast("double")).alias("m_intervals"),
        F.when(rv.isNull(), "missing_intervals").alias("reason"),
    )


def series_meta(panel: DataFrame) -> DataFrame:
    """First and last day, observations and both classes of each series."""
    return panel.groupBy("unique_id").agg(F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.count("y").alias("n_obs")).select(
        "*", adapter_group("unique_id").alias("grp"), report_group("unique_id").alias("report_grp")
    )


def broken_invariants(panel: DataFrame) -> DataFrame:
    """Series and days that occur twice."""
    return panel.groupBy("unique_id", "ds").count().where("count > 1")


def asof_join(left: DataFrame, right: DataFrame, value: str = "x", key: str = "unique_id", ds: str = "ds") -> DataFrame:
    """To each left row the latest right value of its key on or before its day.

    One shuffle and one sort of both sides together, no range join: right rows
    come first on their day and the last one seen is carried forward.
    """
    names = left.columns
    a = left.withColumn("_side", F.lit(1)).withColumn("_x", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*[(F.col(c) if c in (key, ds) else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in names], F.lit(0).alias("_side"), F.col(value).alias("_x"))
    w = Window.partitionBy(key).orderBy(ds, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_x", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*names, F.col("_last").alias(value))


def log_change_variance(panel: DataFrame, until: str | None = None) -> DataFrame:
    """``unique_id, sigma2``: sample variance of the changes of the log value;
    0 with fewer than three rows or a value that isn't positive."""
    rows = panel.where(F.col("y").isNotNull())
    rows = rows.where(F.col("ds") <= F.to_date(F.lit(until))) if until else rows
    moved = rows.withColumn("_d", F.ln(F.when(F.col("y") > 0, F.col("y"))) - F.lag(F.ln(F.when(F.col("y") > 0, F.col("y")))).over(series()))
    whole = (F.count(F.lit(1)) >= 3) & (F.min("y") > 0)
    return moved.groupBy("unique_id").agg(F.when(whole, F.var_samp("_d")).otherwise(0.0).alias("sigma2"))


def estimation_windows(panel: DataFrame, sizes: dict[str, int], expanding: bool = False) -> DataFrame:
    """The last rows of each series, as many as its group asks for; all of them
    where the group has no size, or for ``expanding`` windows."""
    if expanding or not sizes:
        return panel
    from ..functions.columns import adapter_group

    size = F.coalesce(*[F.when(adapter_group("unique_id") == g, F.lit(n)) for g, n in sizes.items()], F.when(adapter_group("unique_id").contains("crypto"), F.lit(sizes.get("crypto"))))
    place = F.row_number().over(Window.partitionBy("unique_id").orderBy(F.desc("ds")))
    return panel.withColumn("_n", place).where(size.isNull() | (F.col("_n") <= size)).drop("_n")
