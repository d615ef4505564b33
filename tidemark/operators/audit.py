"""Audits: each gives one row ``name, passed, violation_count, n_rows`` or the
violations themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def result(name: str, counts: DataFrame) -> DataFrame:
    """``counts`` has one row with ``violation_count`` and ``n_rows``."""
    return counts.select(
        F.lit(name).alias("name"),
        (F.coalesce("violation_count", F.lit(0)) == 0).alias("passed"),
        F.coalesce("violation_count", F.lit(0)).cast("long").alias("violation_count"),
        F.col("n_rows").cast("long").alias("n_rows"),
    )


def _count(df: DataFrame, bad: Column) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("violation_count"), F.count(F.lit(1)).alias("n_rows"))


def missing_on_grid(rows: DataFrame, key: str, epoch: str, step: int) -> DataFrame:
    """Grid points between a key's first and last that have no row."""
    seen = rows.select(key, epoch).distinct()
    grid = seen.groupBy(key).agg(F.min(epoch).alias("a"), F.max(epoch).alias("b")).select(key, F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias(epoch))
    return grid.join(seen, [key, epoch], "left_anti")


def audit_grid(rows: DataFrame, key: str, epoch: str, step: int, most_missing: float = 0.005) -> DataFrame:
    """Per key: points expected, missing, repeated and off the grid."""
    have = rows.groupBy(key, epoch).agg(F.count(F.lit(1)).alias("n"))
    seen = have.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum(F.col("n") - 1).alias("n_repeated"),
        F.count_if(F.col(epoch) % step != 0).alias("n_off_grid"),
        (F.floor((F.max(epoch) - F.min(epoch)) / step) + 1).alias("n_expected"),
    )
    gaps = missing_on_grid(rows, key, epoch, step).groupBy(key).agg(F.count(F.lit(1)).alias("n_missing"))
    out = seen.join(gaps, key, "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    passed = (F.col("n_missing") <= most_missing * F.col("n_expected")) & (F.col("n_repeated") == 0) & (F.col("n_off_grid") == 0)
    return out.withColumn("passed", passed)


def audit_ohlc(ohlc: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    missing = o.isNull() | h.isNull() | l.isNull() | c.isNull()
    bad = missing | (h < F.greatest(o, c)) | (l > F.least(o, c)) | (F.least(o, h, l, c) <= 0)
    return result("ohlc", _count(ohlc, bad))


def audit_dates(panel: DataFrame, expected_first: str) -> DataFrame:
    """Series that don't begin on the expected day, days out of order, and days
    at the weekend (Saturdays only from 1990 on)."""
    by = Window.partitionBy("unique_id").orderBy("ds")
    rows = panel.withColumn("_p", F.lag("ds").over(by)).withColumn("_first", F.min("ds").over(Window.partitionBy("unique_id")))
    return rows.agg(
        F.count_distinct(F.when(F.col("_first") != F.to_date(F.lit(expected_first)), F.col("unique_id"))).alias("late_series"),
        F.count_if(F.col("_p") >= F.col("ds")).alias("not_increasing"),
        F.count_if((F.weekday("ds") == 6) | ((F.weekday("ds") == 5) & (F.year("ds") >= 1990))).alias("weekend_rows"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def audit_zero_null(panel: DataFrame) -> DataFrame:
    return panel.groupBy("unique_id").agg(F.count_if(F.col("y") == 0).alias("n_zero"), F.avg(F.col("y").isNull().cast("double")).alias("null_rate"))


def audit_rv(rv: DataFrame, most_missing: float = 0.05) -> DataFrame:
    """Per series: missing rate, values that aren't positive, and whether it
    passes."""
    g = rv.groupBy("unique_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("rv").isNull().cast("double")).alias("missing_rate"), F.count_if(F.col("rv") <= 0).alias("n_nonpositive")
    )
    return g.withColumn("passed", (F.col("missing_rate") <= most_missing) & (F.col("n_nonpositive") == 0))


def interval_histogram(rv: DataFrame) -> DataFrame:
    return rv.groupBy("unique_id", "m_intervals").agg(F.count(F.lit(1)).alias("n_days"))


def page_overlaps(pages: DataFrame, key: str = "epoch") -> DataFrame:
    """Points that several pages hold, and of these the ones that differ."""
    point = F.struct(*[c for c in pages.columns if c != "page"])
    g = pages.groupBy(key).agg(F.count_distinct("page").alias("n_pages"), F.count_distinct(point).alias("n_values"))
    return g.agg(F.count_if(F.col("n_pages") > 1).alias("overlaps"), F.count_if(F.col("n_values") > 1).alias("conflicts"))


def sample_rows(panel: DataFrame, n: int, seed: int) -> DataFrame:
    """Up to ``n`` rows of each series, chosen by hash: the same in any order and
    partitioning."""
    w = Window.partitionBy("unique_id").orderBy(F.xxhash64("unique_id", "ds", F.lit(seed)), "ds")
    return panel.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
