"""From forecasts to losses, ratios, leaderboards and calibration.

Fact tables have ``task, model`` before the forecast columns.  Panels are
joined by shuffled equi-joins on the series and day; metric tables are plain
aggregates with partial combination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DECILES, Q_COLUMNS, abs_error, covered, finite, pinball, qlike, ratio
from .panel import series
from .windows import vol_proxy

CELL = ["unique_id", "origin", "h", "ds_target"]


def actuals(cells: DataFrame, panel: DataFrame, block: bool) -> DataFrame:
    """What came true for each cell: the target day's value, or (``block``) the
    sum of the last ``h`` rows after the origin up to the target, null if one of
    them is null.

    The sum is a window over the panel, not a range join: rows after the origin
    are at least ``h``, so its last ``h`` are those up to the target.
    """
    cells = cells.select(*CELL).distinct()
    if not block:
        return cells.join(panel.select("unique_id", F.col("ds").alias("ds_target"), F.col("y").alias("actual")), ["unique_id", "ds_target"], "left")
    horizons = [r.h for r in cells.select("h").distinct().orderBy("h").collect()]
    sums = None
    for h in horizons:
        w = series().rowsBetween(1 - h, 0)
        part = panel.select(
            "unique_id", F.col("ds").alias("ds_target"), F.lit(h).cast("int").alias("h"), F.when(F.count("y").over(w) == h, F.sum("y").over(w)).alias("actual")
        )
        sums = part if sums is None else sums.unionByName(part)
    return cells.join(sums, ["unique_id", "ds_target", "h"], "left")


def evaluated(facts: DataFrame, panel: DataFrame, rv: bool, block: bool = False) -> DataFrame:
    """Facts with ``actual``, the volatility proxy and level at the origin, the
    evaluation's failure and reason, ``error`` and ``loss``.

    A stored reason comes before a non-positive value (variances only, of the
    forecast or of what came true), before a missing actual, before a missing
    forecast.
    """
    rows = facts.join(actuals(facts, panel, block), CELL, "left")
    level = vol_proxy(panel).select("unique_id", F.col("ds").alias("origin"), F.col("y").alias("origin_actual"), "vol_proxy")
    rows = rows.join(level, ["unique_id", "origin"], "left")
    y, f = finite("actual"), finite("yhat")
    low = F.coalesce((F.col("actual") <= 0) | (F.col("yhat") <= 0), F.lit(False)) if rv else F.lit(False)
    stored = F.coalesce(F.col("fail"), F.lit(False))
    failed = stored | low | y.isNull() | f.isNull()
    said = F.when(F.coalesce("fail_reason", F.lit("")) != "", F.col("fail_reason"))
    reason = F.coalesce(
        said, F.when(low, "nonpositive_forecast"), F.when(y.isNull(), "missing_actual"), F.when(f.isNull(), "missing_forecast"), F.lit("")
    )
    scale = F.when(F.col("unique_id").startswith("JGB_"), 100.0).otherwise(1.0)
    return rows.withColumns(
        {
            "evaluation_fail": failed,
            "evaluation_fail_reason": F.when(failed, reason).otherwise(""),
            "error": F.when(~failed, (f - y) * (1.0 if rv else scale)),
            "loss": F.when(~failed, qlike(y, f) if rv else abs_error(y, f) * scale),
            "loss_metric": F.lit("qlike" if rv else "mae"),
        }
    )


def metric(rows: DataFrame, keys: list[str], value: Column, whole: Column, name: str) -> DataFrame:
    """A mean over complete cases with how many were used and dropped."""
    ok = F.coalesce(whole, F.lit(False))
    return rows.groupBy(*keys).agg(
        F.avg(F.when(ok, value)).alias(name), F.count_if(ok).alias("n_used"), F.count_if(~ok).alias("n_dropped")
    )


def point_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    e = finite("yhat") - finite("actual")
    out = metric(rows, keys, F.abs(e), e.isNotNull(), "mae")
    mse = metric(rows, keys, e * e, e.isNotNull(), "mse").select(*keys, "mse", F.sqrt("mse").alias("rmse"))
    return out.join(mse, keys).select(*keys, "mae", "mse", "rmse", "n_used", "n_dropped")


def qlike_metric(rows: DataFrame, keys: list[str]) -> DataFrame:
    loss = qlike("actual", "yhat")
    return metric(rows, keys, loss, loss.isNotNull(), "qlike")


def _whole() -> Column:
    ok = finite("actual").isNotNull()
    for q in Q_COLUMNS:
        ok = ok & finite(q).isNotNull()
    return ok


def pinball_metric(rows: DataFrame, keys: list[str], q: str, tau: float) -> DataFrame:
    loss = pinball("actual", q, tau)
    return metric(rows, keys, loss, loss.isNotNull(), "pinball")


def wql(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(2 / 9) times the sum of the mean pinball losses over the mean absolute
    actual, over rows that have all deciles; null for a zero denominator."""
    ok = F.coalesce(_whole(), F.lit(False))
    total = sum((F.avg(F.when(ok, pinball("actual", q, p))) for q, p in zip(Q_COLUMNS, DECILES)), F.lit(0.0))
    value = F.try_divide(F.lit(2 / 9) * total, F.nullif(F.avg(F.when(ok, F.abs("actual"))), F.lit(0.0)))
    return rows.groupBy(*keys).agg(value.alias("wql"), F.count_if(ok).alias("n_used"), F.count_if(~ok).alias("n_dropped"))


def coverage(rows: DataFrame, keys: list[str], lo: str = "q10", hi: str = "q90") -> DataFrame:
    hit = covered("actual", lo, hi)
    return metric(rows, keys, hit, hit.isNotNull(), "coverage")


def coverage_by_tercile(rows: DataFrame, keys: list[str], lo: str = "q10", hi: str = "q90", vol: str = "vol_proxy") -> DataFrame:
    """Coverage in the lower, middle and upper third of volatility; the cuts are
    interpolated quantiles and belong to the lower class."""
    hit = covered("actual", lo, hi)
    rows = rows.withColumn("_hit", hit).where(F.col("_hit").isNotNull() & finite(vol).isNotNull())
    cuts = rows.groupBy(*keys).agg(F.percentile(vol, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_cut"))
    both = rows.join(cuts, keys)
    tercile = F.when(F.col(vol) <= F.col("_cut")[0], "low").when(F.col(vol) <= F.col("_cut")[1], "middle").otherwise("high")
    return both.groupBy(*keys, tercile.alias("tercile")).agg(F.avg("_hit").alias("coverage"), F.count(F.lit(1)).alias("n_used"))


def calibration_curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Observed coverage of the four central intervals."""
    pairs = [(0.8, "q10", "q90"), (0.6, "q20", "q80"), (0.4, "q30", "q70"), (0.2, "q40", "q60")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("nominal"), covered("actual", lo, hi).alias("hit")) for n, lo, hi in pairs]))
    return rows.select(*keys, each.alias("c")).where("c.hit is not null").groupBy(*keys, F.col("c.nominal").alias("nominal")).agg(F.avg("c.hit").alias("observed"), F.count(F.lit(1)).alias("n_used"))


def paired_losses(rows: DataFrame, benchmark: str, keys: list[str] = ["task", "h"]) -> DataFrame:
    """Losses of each model beside the benchmark's on the same series and
    origin, both successful."""
    good = rows.where(~F.col("evaluation_fail") & finite("loss").isNotNull())
    bench = good.where(F.col("model") == benchmark).select(*keys, "unique_id", "origin", F.col("loss").alias("bench_loss"))
    return good.select(*keys, "model", "unique_id", "origin", "loss").join(bench, [*keys, "unique_id", "origin"])


def series_ratios(pairs: DataFrame, keys: list[str] = ["task", "h"]) -> DataFrame:
    """Per series: ratio of mean losses, mean difference and pairs."""
    return pairs.groupBy(*keys, "model", "unique_id").agg(
        F.try_divide(F.avg("loss"), F.nullif(F.avg("bench_loss"), F.lit(0.0))).alias("ratio"),
        F.avg(F.col("loss") - F.col("bench_loss")).alias("dbar"),
        F.count(F.lit(1)).alias("n"),
    )


def leaderboard(rows: DataFrame, benchmark: str, keys: list[str] = ["task", "h"]) -> DataFrame:
    """Median and mean of per-series ratios, share of series won, failures with
    their reasons, and whether the baseline is broken for the model (a ratio
    above 5 or more than 40 % failures)."""
    ratios = series_ratios(paired_losses(rows, benchmark, keys), keys)
    board = ratios.groupBy(*keys, "model").agg(
        F.percentile("ratio", F.lit(0.5)).alias("median_ratio"),
        F.avg("ratio").alias("mean_ratio"),
        F.avg((F.col("ratio") < 1).cast("double")).alias("win_rate"),
        F.count("ratio").alias("n_series"),
        F.sum("n").alias("n_used"),
    )
    reasons = rows.where("evaluation_fail").groupBy(*keys, "model", "evaluation_fail_reason").count()
    reasons = reasons.groupBy(*keys, "model").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "evaluation_fail_reason", "count"))), ";").alias("reasons")
    )
    fails = rows.groupBy(*keys, "model").agg(F.count_if("evaluation_fail").alias("n_fail"), F.avg(F.col("evaluation_fail").cast("double")).alias("fail_rate"))
    out = fails.join(board, [*keys, "model"], "left").join(reasons, [*keys, "model"], "left")
    return out.withColumn("broken", broken_baseline(F.col("median_ratio"), F.col("fail_rate"))).withColumn("reasons", F.coalesce("reasons", F.lit("")))


def broken_baseline(median_ratio: Column, fail_rate: Column) -> Column:
    return F.coalesce(median_ratio > 5, F.lit(False)) | F.coalesce(fail_rate > 0.4, F.lit(False))


def runtime(rows: DataFrame, keys: list[str] = ["task", "h"]) -> DataFrame:
    """Total and mean seconds over distinct origins; an origin's rows share it."""
    each = rows.groupBy(*keys, "model", "origin").agg(F.max("runtime_s").alias("s"))
    return each.groupBy(*keys, "model").agg(F.sum("s").alias("runtime_total"), F.avg("s").alias("runtime_mean"))


def half_split(rows: DataFrame, benchmark: str, keys: list[str] = ["task", "h"]) -> DataFrame:
    """Mean ratio in the first and the second half of the origins."""
    pairs = paired_losses(rows, benchmark, keys)
    days = pairs.select(*keys, "origin").distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("origin"))
    halves = days.withColumn("half", F.when(place <= F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / 2), "first").otherwise("second"))
    ratios = series_ratios(pairs.join(halves, [*keys, "origin"]), [*keys, "half"])
    return ratios.groupBy(*keys, "half", "model").agg(F.avg("ratio").alias("mean_ratio"), F.count("ratio").alias("n_series"))


def group_breakdown(rows: DataFrame, benchmark: str, group: Column, keys: list[str] = ["task", "h"]) -> DataFrame:
    """Median ratio by class of series and over all of them."""
    ratios = series_ratios(paired_losses(rows, benchmark, keys), keys).withColumn("grp", group)
    wide = ratios.withColumn("grp", F.explode(F.array(F.col("grp"), F.lit("all"))))
    return wide.groupBy(*keys, "grp", "model").agg(F.percentile("ratio", F.lit(0.5)).alias("median_ratio"), F.count("ratio").alias("n_series"))


def loss_difference(rows: DataFrame, benchmark: str, keys: list[str] = ["task", "h"]) -> DataFrame:
    """Mean loss difference at each origin."""
    pairs = paired_losses(rows, benchmark, keys)
    return pairs.groupBy(*keys, "model", "origin").agg(F.avg(F.col("loss") - F.col("bench_loss")).alias("dbar"), F.count(F.lit(1)).alias("n"))


def mcs_gate(rows: DataFrame, required: DataFrame) -> DataFrame:
    """Which models have a successful row for every required series."""
    good = rows.where(~F.col("evaluation_fail") & finite("loss").isNotNull()).select("model", "unique_id").distinct()
    need = required.select("unique_id").distinct()
    n = need.agg(F.count(F.lit(1)).alias("need"))
    have = good.join(need, "unique_id", "left_semi").groupBy("model").agg(F.count(F.lit(1)).alias("have"))
    models = rows.select("model").distinct().join(have, "model", "left")
    return models.crossJoin(F.broadcast(n)).select("model", F.coalesce("have", F.lit(0)).alias("have"), "need", (F.coalesce("have", F.lit(0)) == F.col("need")).alias("covered"))


def mcs_matrix(rows: DataFrame, models: list[str]) -> DataFrame:
    """Losses by series and origin, a column for each model, complete rows."""
    good = rows.where(~F.col("evaluation_fail"))
    return good.groupBy("unique_id", "origin").pivot("model", models).agg(F.first("loss")).dropna()


def relative_mae(pairs: DataFrame, keys: list[str], a: str = "loss", b: str = "bench_loss") -> DataFrame:
    """Mean absolute error by that of the benchmark over the same cells."""
    return pairs.groupBy(*keys).agg(F.try_divide(F.avg(F.abs(a)), F.nullif(F.avg(F.abs(b)), F.lit(0.0))).alias("rel_mae"), F.count(F.lit(1)).alias("n"))


def reason_counts(rows: DataFrame, keys: list[str] = ["task", "h", "model"]) -> DataFrame:
    """Failures by reason as a map."""
    each = rows.where("evaluation_fail").groupBy(*keys, "evaluation_fail_reason").count()
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("evaluation_fail_reason", "count")))).alias("reasons"))


def coverage_notes(board: DataFrame, reasons: DataFrame, model: str, reason: str = "invalid_context", keys: list[str] = ["task", "h"]) -> DataFrame:
    """Where a model's board has fewer series than the others' largest, and
    failures for ``reason`` are why."""
    own = board.where(F.col("model") == model).select(*keys, "n_series")
    most = board.where(F.col("model") != model).groupBy(*keys).agg(F.max("n_series").alias("most_series"))
    why = reasons.where(F.col("model") == model).select(*keys, F.coalesce(F.try_element_at("reasons", F.lit(reason)), F.lit(0)).alias("n_failures"))
    out = own.join(most, keys).join(why, keys).where((F.coalesce("n_series", F.lit(0)) != F.col("most_series")) & (F.col("n_failures") > 0))
    return out.select(*keys, F.lit(model).alias("model"), "n_series", "most_series", F.lit(reason).alias("reason"), "n_failures")


def label_mismatch(expected: DataFrame, produced: DataFrame, keys: list[str] = ["unique_id", "h", "ds_target"]) -> DataFrame:
    """Labels that are missing from what was produced, or extra in it."""
    a, b = expected.select(*keys).distinct(), produced.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("kind", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("kind", F.lit("extra")))
