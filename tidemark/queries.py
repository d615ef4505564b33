"""The registered queries over the star schema's tables, and their SQL twins."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import Q_COLUMNS, kth, levels_to_deciles, overlap_design_effect, return_id, spread_deciles
from .functions.special import mde
from .operators import audit, evaluate, inference, models, panel, windows
from .plans import tables as t
from .ship import ship
from .sources import store
from .streaming import operators as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

P = "PARTITION BY unique_id ORDER BY ds"
QL = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"

#: Building blocks of the SQL twins.
CTE: dict[str, str] = {
    "price": "SELECT o_orderpriority AS unique_id, CAST(o_orderdate AS DATE) AS ds, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2",
    "volume": "SELECT l_returnflag || l_linestatus AS unique_id, CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2",
    "lvol": "SELECT unique_id, ds, ln(1 + y) AS y FROM volume",
    "ohlc": """SELECT l_returnflag || l_linestatus AS unique_id, CAST(l_shipdate AS DATE) AS ds,
        first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS open, max(l_extendedprice) AS high,
        min(l_extendedprice) AS low, last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS close
        FROM lineitem GROUP BY 1, 2""",
    "rv": "SELECT unique_id, ds, 0.5 * power(ln(high) - ln(low), 2) - (2 * ln(2) - 1) * power(ln(close) - ln(open), 2) AS y FROM ohlc",
    "ret": "SELECT unique_id, ds, ln(close) - ln(open) AS ret FROM ohlc",
    "candles": """SELECT event_type AS unique_id, date_trunc('hour', ts) AS ts, last(value ORDER BY ts, event_id) AS close, count(*) AS n
        FROM events GROUP BY 1, 2""",
    "pidx": f"""SELECT unique_id, ds, 100 * sqrt(365 * m) AS x FROM (SELECT *, avg(y) OVER ({P} ROWS 20 PRECEDING) AS m,
        row_number() OVER ({P}) AS rn FROM price) WHERE rn % 3 = 0 AND m > 0""",
    "ridx": f"""SELECT unique_id, ds, 100 * sqrt(365 * m) AS x FROM (SELECT *, avg(y) OVER ({P} ROWS 20 PRECEDING) AS m,
        row_number() OVER ({P}) AS rn FROM rv) WHERE rn % 3 = 0 AND m > 0""",
}


def _cells(name: str, source: str, horizons: list[tuple[int, int]]) -> None:
    parts = " UNION ALL ".join(
        f"SELECT unique_id, ds AS origin, {h} AS h, {s} AS step, lead(ds, {h}) OVER ({P}) AS ds_target FROM {source} WHERE y IS NOT NULL" for h, s in horizons
    )
    CTE[name] = f"""SELECT unique_id, origin, h, ds_target FROM (
        SELECT *, row_number() OVER (PARTITION BY unique_id, h ORDER BY origin) - 1 AS k FROM ({parts})
        WHERE origin BETWEEN DATE '{t.START}' AND DATE '{t.END}' AND ds_target <= DATE '{t.END}') WHERE k % step = 0"""


_cells("pcells", "price", [(1, 5), (5, 5)])
_cells("vcells", "lvol", [(1, 5)])
_cells("rcells", "rv", [(1, 5)])
_cells("rcells5", "rv", [(1, 5), (5, 5)])
_cells("rcells3", "rv", [(3, 5)])


def _rw(name: str, source: str, cells: str, horizons: list[int]) -> None:
    CTE[name] = " UNION ALL ".join(
        f"""SELECT c.*, s.y AS yhat, s.q, s.y IS NULL AS fail, CASE WHEN s.y IS NULL THEN 'insufficient_history' END AS fail_reason
        FROM {cells} c JOIN (SELECT unique_id, ds, y, list_transform(quantile_cont(d, {QL}) OVER ({P} ROWS {models.ESTIMATION - h - 1} PRECEDING), lambda x: x + y) AS q
        FROM (SELECT *, y - lag(y, {h}) OVER ({P}) AS d FROM {source})) s ON c.unique_id = s.unique_id AND c.origin = s.ds WHERE c.h = {h}"""
        for h in horizons
    )


def _prev(name: str, cells: str, horizons: list[int]) -> None:
    CTE[name] = " UNION ALL ".join(
        f"""SELECT c.unique_id, c.origin, c.h, c.ds_target, s.s AS yhat,
        CASE WHEN s.np >= {models.PAIRS} AND s.s > 0 THEN list_transform(s.rq, lambda x: x * s.s) END AS q, coalesce(s.s <= 0, true) AS fail,
        CASE WHEN s.s IS NULL THEN 'insufficient_history' WHEN s.s <= 0 THEN 'nonpositive_forecast' END AS fail_reason
        FROM {cells} c JOIN (
            SELECT *, quantile_cont(r, {QL}) OVER w AS rq, count(r) OVER w AS np FROM (
                SELECT *, CASE WHEN s > 0 AND ps > 0 THEN s / ps END AS r FROM (
                    SELECT *, lag(CASE WHEN s > 0 THEN s END) OVER (PARTITION BY unique_id, rn % {h} ORDER BY rn) AS ps FROM (
                        SELECT unique_id, ds, row_number() OVER ({P}) AS rn,
                               CASE WHEN count(y) OVER ({P} ROWS {h - 1} PRECEDING) = {h} THEN sum(y) OVER ({P} ROWS {h - 1} PRECEDING) END AS s FROM rv)))
            WINDOW w AS (PARTITION BY unique_id, rn % {h} ORDER BY rn ROWS {models.ESTIMATION // h - 2} PRECEDING)) s
        ON c.unique_id = s.unique_id AND c.origin = s.ds WHERE c.h = {h}"""
        for h in horizons
    )


def _seasonal(name: str, last: int) -> None:
    CTE[name] = f"""SELECT c.unique_id, c.origin, c.h, c.ds_target, CASE WHEN s.have >= {last} THEN s.y END AS yhat,
        CASE WHEN s.have >= {last} THEN s.q END AS q, coalesce(s.have, 0) < {last} AS fail,
        CASE WHEN coalesce(s.have, 0) < {last} THEN 'insufficient_history' END AS fail_reason
        FROM (SELECT *, isodow(ds_target) AS dow FROM vcells) c ASOF LEFT JOIN (
            SELECT unique_id, ds, isodow(ds) AS dow, quantile_cont(y, 0.5) OVER w AS y, count(y) OVER w AS have,
                   quantile_cont(y, {QL}) OVER (PARTITION BY unique_id, isodow(ds) ORDER BY ds ROWS UNBOUNDED PRECEDING) AS q
            FROM lvol WINDOW w AS (PARTITION BY unique_id, isodow(ds) ORDER BY ds ROWS {last - 1} PRECEDING)) s
        ON c.unique_id = s.unique_id AND c.dow = s.dow AND c.origin >= s.ds"""


_rw("rw_price", "price", "pcells", [1, 5])
_rw("rw_vol", "lvol", "vcells", [1])
_prev("prev", "rcells", [1])
_prev("prev5", "rcells5", [1, 5])
_seasonal("sn7", 1)
_seasonal("sm4", 4)
# The recursion in closed form: positive terms only, so its sum is stable.
CTE["path"] = f"""SELECT unique_id, ds, power(0.94, k) * (seed + 0.06 * sum(r2 * power(0.94, -k)) OVER ({P} ROWS UNBOUNDED PRECEDING)) AS sigma2
    FROM (SELECT *, ret * ret AS r2, row_number() OVER ({P}) AS k,
                 avg(CASE WHEN n <= 20 THEN ret * ret END) OVER (PARTITION BY unique_id) AS seed
          FROM (SELECT *, row_number() OVER ({P}) AS n FROM ret WHERE ret IS NOT NULL))"""
CTE["ewma"] = f"""SELECT c.unique_id, c.origin, c.h, c.ds_target, s.f AS yhat,
    CASE WHEN s.np >= {models.PAIRS} AND s.f > 0 THEN list_transform(s.rq, lambda x: x * s.f) END AS q, coalesce(s.f <= 0, true) AS fail,
    CASE WHEN s.f IS NULL THEN 'insufficient_return_history' WHEN s.f <= 0 THEN 'nonpositive_forecast' END AS fail_reason
    FROM rcells c JOIN (
        SELECT unique_id, ds, last_value(sigma2 IGNORE NULLS) OVER ({P} ROWS UNBOUNDED PRECEDING) AS f,
               quantile_cont(r, {QL}) OVER w AS rq, count(r) OVER w AS np
        FROM (SELECT rv.unique_id, rv.ds, p.sigma2, CASE WHEN rv.y > 0 AND p.for_ds > 0 THEN rv.y / p.for_ds END AS r FROM rv
              LEFT JOIN (SELECT *, lag(sigma2) OVER ({P}) AS for_ds FROM path) p ON rv.unique_id = p.unique_id AND rv.ds = p.ds)
        WINDOW w AS ({P} ROWS {models.ESTIMATION - 1} PRECEDING)) s ON c.unique_id = s.unique_id AND c.origin = s.ds"""
# Blocks of three rows: ratios to three times the forecast for the row before.
CTE["ewma3"] = f"""SELECT c.unique_id, c.origin, c.h, c.ds_target, 3 * s.f AS yhat,
    CASE WHEN s.np >= {models.PAIRS} AND s.f > 0 THEN list_transform(s.rq, lambda x: x * 3 * s.f) END AS q, coalesce(s.f <= 0, true) AS fail
    FROM rcells3 c JOIN (
        SELECT unique_id, ds, f, quantile_cont(r, {QL}) OVER w AS rq, count(r) OVER w AS np
        FROM (SELECT *, CASE WHEN s > 0 AND pf > 0 THEN s / (3 * pf) END AS r FROM (
            SELECT v.unique_id, v.ds, v.rn, v.s, lag(p.for_ds, 3) OVER (PARTITION BY v.unique_id ORDER BY v.ds) AS pf,
                   last_value(p.sigma2 IGNORE NULLS) OVER (PARTITION BY v.unique_id ORDER BY v.ds ROWS UNBOUNDED PRECEDING) AS f
            FROM (SELECT unique_id, ds, row_number() OVER ({P}) AS rn,
                         CASE WHEN count(y) OVER ({P} ROWS 2 PRECEDING) = 3 THEN sum(y) OVER ({P} ROWS 2 PRECEDING) END AS s FROM rv) v
            LEFT JOIN (SELECT *, lag(sigma2) OVER ({P}) AS for_ds FROM path) p ON v.unique_id = p.unique_id AND v.ds = p.ds))
        WINDOW w AS (PARTITION BY unique_id, rn % 3 ORDER BY rn ROWS {models.ESTIMATION // 3 - 1} PRECEDING)) s ON c.unique_id = s.unique_id AND c.origin = s.ds"""
_m = "unique_id, origin, h, ds_target, yhat, q, fail, fail_reason"
CTE["vfacts"] = " UNION ALL ".join(f"SELECT 'volume' AS task, '{n}' AS model, {_m} FROM {c}" for n, c in (("SeasonalNaive7", "sn7"), ("SeasonalMedian4", "sm4"), ("RW", "rw_vol")))
CTE["rfacts"] = " UNION ALL ".join(f"SELECT 'rv' AS task, '{n}' AS model, {_m} FROM {c}" for n, c in (("NaivePrev", "prev"), ("EWMA", "ewma")))


def _rows(name: str, facts: str, source: str, positive: bool) -> None:
    low = "coalesce(actual <= 0 OR yhat <= 0, false)" if positive else "false"
    loss = "(actual / yhat) - ln(actual / yhat) - 1" if positive else "abs(actual - yhat)"
    CTE[name] = f"""SELECT *, CASE WHEN NOT evaluation_fail THEN {loss} END AS loss FROM (
        SELECT *, fail OR {low} OR actual IS NULL OR yhat IS NULL AS evaluation_fail,
               CASE WHEN fail THEN fail_reason WHEN {low} THEN 'nonpositive_forecast' WHEN actual IS NULL THEN 'missing_actual'
                    WHEN yhat IS NULL THEN 'missing_forecast' ELSE '' END AS reason
        FROM (SELECT f.task, f.model, f.unique_id, f.origin, f.h, f.ds_target, CASE WHEN f.fail THEN NULL ELSE f.yhat END AS yhat, f.q, f.fail, f.fail_reason,
                     a.y AS actual, o.y AS origin_actual, o.vol_proxy
              FROM {facts} f LEFT JOIN {source} a ON f.unique_id = a.unique_id AND f.ds_target = a.ds
              LEFT JOIN (SELECT *, coalesce(stddev_pop(d) OVER ({P} ROWS 20 PRECEDING), 0) AS vol_proxy
                         FROM (SELECT *, y - lag(y) OVER ({P}) AS d FROM {source})) o ON f.unique_id = o.unique_id AND f.origin = o.ds))"""


_rows("vrows", "vfacts", "lvol", False)
_rows("rrows", "rfacts", "rv", True)
CTE["allrows"] = "SELECT * FROM vrows UNION ALL SELECT * FROM rrows"


def _pairs(name: str, rows: str, bench: str) -> None:
    CTE[name] = f"""SELECT m.task, m.h, m.model, m.unique_id, m.origin, m.loss, b.loss AS bench_loss FROM {rows} m JOIN {rows} b
        ON m.task = b.task AND m.h = b.h AND m.unique_id = b.unique_id AND m.origin = b.origin
        WHERE b.model = '{bench}' AND NOT m.evaluation_fail AND NOT b.evaluation_fail AND m.loss IS NOT NULL AND b.loss IS NOT NULL"""


_pairs("vpairs", "vrows", "SeasonalNaive7")
_pairs("rpairs", "rrows", "EWMA")
CTE["vratios"] = "SELECT task, h, model, unique_id, avg(loss) / nullif(avg(bench_loss), 0) AS ratio, avg(loss - bench_loss) AS dbar, count(*) AS n FROM vpairs GROUP BY ALL"
CTE["rratios"] = "SELECT task, h, model, unique_id, avg(loss) / nullif(avg(bench_loss), 0) AS ratio, avg(loss - bench_loss) AS dbar, count(*) AS n FROM rpairs GROUP BY ALL"


def sql(body: str) -> str:
    """The statement with the building blocks it uses, in order."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name in CTE:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                add(CTE[name])

    add(body)
    with_ = ", ".join(f"{name} AS ({CTE[name]})" for name in CTE if name in need)
    return f"WITH {with_} {body}" if with_ else body


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @functools.wraps(f)
        def shipped(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        QUERIES[f.__name__] = shipped
        if oracle:
            ORACLES[f.__name__] = sql(oracle)
        return shipped

    return add


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; the name stays."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c, digits).alias(x) if isinstance(x, str) else F.round(c, digits)


def rq(digits: int = 6) -> list[Column]:
    return [r(c, digits) for c in Q_COLUMNS]


def sq(digits: int = 6) -> str:
    return ", ".join(f"round(q[{i + 1}], {digits}) AS {c}" for i, c in enumerate(Q_COLUMNS))


# Panels and their operators


@query("""SELECT c.unique_id, count(*) AS n_used, round(avg(abs(a.y - s.y)), 6) AS mae FROM pcells c
    JOIN price s ON c.unique_id = s.unique_id AND c.origin = s.ds JOIN price a ON c.unique_id = a.unique_id AND c.ds_target = a.ds
    WHERE c.h = 1 GROUP BY 1""")
def flagship_rw_mae(spark, d):
    p = t.price(spark, d)
    cells = windows.origin_schedule(p, t.START, t.END, [(1, 5)])
    walk = p.select("unique_id", F.col("ds").alias("origin"), F.col("y").alias("yhat"))
    rows = evaluate.actuals(cells, p, block=False).join(walk, ["unique_id", "origin"])
    return evaluate.point_metrics(rows, ["unique_id"]).select("unique_id", "n_used", r("mae"))


@query("SELECT unique_id, ds, round(y, 6) AS y FROM price")
def panel_price(spark, d):
    return t.price(spark, d).select("unique_id", "ds", r("y"))


@query("SELECT unique_id, ds, round(y, 6) AS y FROM volume")
def panel_volume(spark, d):
    return t.volume(spark, d).select("unique_id", "ds", r("y"))


@query("SELECT unique_id, ds, open, high, low, close FROM ohlc")
def panel_ohlc(spark, d):
    return t.ohlc(spark, d)


@query("""SELECT 'EUR' || unique_id AS unique_id, min(ds) AS first_ds, max(ds) AS last_ds, count(y) AS n_obs, 'fx' AS grp, 'fx' AS report_grp FROM price GROUP BY 1
    UNION ALL SELECT 'VOL_' || unique_id, min(ds), max(ds), count(y), 'volume', 'crypto' FROM volume GROUP BY 1
    UNION ALL SELECT 'RV_' || unique_id, min(ds), max(ds), count(y), 'rv_crypto', 'crypto' FROM rv GROUP BY 1""")
def meta_series(spark, d):
    parts = [("EUR", t.price), ("VOL_", t.volume), ("RV_", t.rv)]
    named = [f(spark, d).withColumn("unique_id", F.concat(F.lit(p), "unique_id")) for p, f in parts]
    return panel.series_meta(named[0].unionByName(named[1]).unionByName(named[2]))


@query("SELECT 'EUR' || unique_id AS unique_id, ds, round(y, 6) AS y FROM price")
def fx_unpivot(spark, d):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = t.price(spark, d).groupBy("ds").pivot("unique_id", names).agg(F.first("y"))
    return panel.melt(wide, "ds", names, "EUR").select("unique_id", "ds", r("y"))


@query("""SELECT unique_id, ds, round(CASE WHEN ds >= DATE '2000-06-01' THEN y + 1 ELSE y END, 6) AS y FROM price""")
def merge_priority(spark, d):
    p = t.price(spark, d)
    return panel.merge_priority(p.where("ds < '2001-01-01'"), p.where("ds >= '2000-06-01'").withColumn("y", F.col("y") + 1)).select("unique_id", "ds", r("y"))


ORIGINS = ["1998-06-30", "2000-01-03", "2001-06-29"]


@query(f"""SELECT origin, unique_id, count(*) AS n, max(ds) AS last_ds, round(arg_max(y, ds), 6) AS last_y
    FROM price JOIN (SELECT unnest([{", ".join(f"DATE '{o}'" for o in ORIGINS)}]) AS origin) o ON ds <= origin GROUP BY 1, 2""")
def asof_slice(spark, d):
    return panel.asof_summary(t.price(spark, d), ORIGINS).select("origin", "unique_id", "n", "last_ds", r("last_y"))


@query("SELECT unique_id, ds, round(y, 6) AS y FROM price QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 250")
def estimation_tail(spark, d):
    return panel.estimation_tail(t.price(spark, d), 250).select("unique_id", "ds", r("y"))


@query("SELECT unique_id, ds, round(y, 9) AS rv FROM rv")
def gk_daily(spark, d):
    return panel.gk_daily(t.ohlc(spark, d)).select("unique_id", "ds", r("rv", 9))


RV_DAYS = """SELECT g.unique_id, g.ds, CASE WHEN n = 24 AND np = 24 THEN round(v, 6) END AS rv, CAST(greatest(0, coalesce(n, 0) - 1) AS DOUBLE) AS m_intervals,
        CASE WHEN n = 24 AND np = 24 THEN NULL ELSE 'missing_intervals' END AS reason
    FROM (SELECT unique_id, CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS ds FROM candles GROUP BY 1) g
    LEFT JOIN (SELECT unique_id, ds, count(*) AS n, count(p) AS np, sum(power(p - pp, 2)) AS v FROM (
        SELECT *, lag(p) OVER (PARTITION BY unique_id, ds ORDER BY ts) AS pp FROM (
            SELECT unique_id, ts, CAST(ts AS DATE) AS ds, CASE WHEN close > 0 THEN ln(close) END AS p FROM candles)) GROUP BY 1, 2) x
    ON g.unique_id = x.unique_id AND g.ds = x.ds"""


@query(RV_DAYS)
def rv_complete_days(spark, d):
    return panel.realized_variance(t.candles(spark, d), 24).withColumn("rv", F.round("rv", 6))


def _hsum(align: str) -> str:
    skip = "count(*) OVER (PARTITION BY unique_id) % 5" if align == "end" else "0"
    return f"""SELECT unique_id, min(ds) AS ds, round(CASE WHEN count(y) = 5 THEN sum(y) END, 6) AS y, max(ds) AS block_end_ds FROM (
        SELECT *, CAST(floor((row_number() OVER ({P}) - 1 - {skip}) / 5.0) AS BIGINT) AS b FROM volume) WHERE b >= 0 GROUP BY unique_id, b HAVING count(*) = 5"""


@query(_hsum("start"))
def hsum_start(spark, d):
    return panel.block_sums(t.volume(spark, d), 5, "start").withColumn("y", F.round("y", 6))


@query(_hsum("end"))
def hsum_end(spark, d):
    return panel.block_sums(t.volume(spark, d), 5, "end").withColumn("y", F.round("y", 6))


@query("SELECT unique_id, origin, h, ds_target FROM pcells")
def origin_schedule(spark, d):
    return windows.origin_schedule(t.price(spark, d), t.START, t.END, [(1, 5), (5, 5)])


@query(f"""SELECT unique_id, ds, {", ".join(f"round(lag(y, {k}) OVER ({P}), 6) AS lag_{k}" for k in windows.LAGS)},
    {", ".join(f"round(avg(y) OVER ({P} ROWS {k - 1} PRECEDING), 6) AS rm{k}" for k in (7, 28))},
    CAST(isodow(ds) - 1 AS INT) AS dow, CAST(month(ds) AS INT) AS month, CAST(ds = last_day(ds) AS INT) AS month_end FROM volume""")
def lag_features(spark, d):
    f = windows.lag_features(t.volume(spark, d))
    return f.select("unique_id", "ds", *[r(f"lag_{k}") for k in windows.LAGS], r("rm7"), r("rm28"), "dow", "month", "month_end")


@query(f"""SELECT unique_id, ds, CASE WHEN ok THEN round(ln(y), 6) END AS l1, CASE WHEN ok THEN round(ln(m5), 6) END AS l5, CASE WHEN ok THEN round(ln(m22), 6) END AS l22
    FROM (SELECT *, avg(y) OVER ({P} ROWS 4 PRECEDING) AS m5, avg(y) OVER w AS m22, count(y) OVER w = 22 AND min(y) OVER w > 0 AS ok
          FROM rv WINDOW w AS ({P} ROWS 21 PRECEDING))""")
def har_features(spark, d):
    return windows.har_features(t.rv(spark, d)).select("unique_id", "ds", r("l1"), r("l5"), r("l22"))


@query(f"""SELECT unique_id, ds, round(coalesce(stddev_pop(d) OVER ({P} ROWS 20 PRECEDING), 0), 6) AS vol_proxy FROM (SELECT *, y - lag(y) OVER ({P}) AS d FROM price)""")
def vol_proxy(spark, d):
    return windows.vol_proxy(t.price(spark, d)).select("unique_id", "ds", r("vol_proxy"))


@query("SELECT p.unique_id, p.ds, round(p.y, 6) AS y, round(x.x, 6) AS x FROM price p ASOF LEFT JOIN pidx x ON p.unique_id = x.unique_id AND p.ds >= x.ds")
def asof_join(spark, d):
    p = t.price(spark, d)
    return panel.asof_join(p, t.index(p)).select("unique_id", "ds", r("y"), r("x"))


# Forecasters


@query(f"SELECT unique_id, origin, h, round(yhat, 6) AS yhat, {sq()} FROM rw_price")
def rw_deciles(spark, d):
    p = t.price(spark, d)
    cells = windows.origin_schedule(p, t.START, t.END, [(1, 5), (5, 5)])
    return models.random_walk(p, cells, [1, 5]).select("unique_id", "origin", "h", r("yhat"), *rq())


@query(f"SELECT unique_id, origin, h, CASE WHEN NOT fail THEN round(yhat, 8) END AS yhat, {sq(8)}, fail, fail_reason FROM prev5")
def naive_prev(spark, d):
    v = t.rv(spark, d)
    cells = windows.origin_schedule(v, t.START, t.END, [(1, 5), (5, 5)])
    return models.naive_prev(v, cells, [1, 5]).select("unique_id", "origin", "h", r("yhat", 8), *rq(8), "fail", "fail_reason")


@query(f"SELECT unique_id, origin, h, round(yhat, 6) AS yhat, {sq()}, fail FROM sn7")
def seasonal_naive7(spark, d):
    p = t.log_volume(spark, d)
    return models.seasonal(p, windows.origin_schedule(p, t.START, t.END, [(1, 5)]), 1).select("unique_id", "origin", "h", r("yhat"), *rq(), "fail")


@query(f"SELECT unique_id, origin, h, round(yhat, 6) AS yhat, {sq()}, fail FROM sm4")
def seasonal_median4(spark, d):
    p = t.log_volume(spark, d)
    return models.seasonal(p, windows.origin_schedule(p, t.START, t.END, [(1, 5)]), 4).select("unique_id", "origin", "h", r("yhat"), *rq(), "fail")


@query("SELECT unique_id, ds, round(sigma2, 8) AS sigma2 FROM path")
def ewma_point(spark, d):
    return models.ewma_path(t.returns(spark, d)).select("unique_id", "ds", r("sigma2", 8))


@query(f"SELECT unique_id, origin, h, round(yhat, 8) AS yhat, {sq(7)} FROM ewma")
def ewma_calibrated(spark, d):
    v = t.rv(spark, d)
    cells = windows.origin_schedule(v, t.START, t.END, [(1, 5)])
    return models.ewma(v, t.returns(spark, d), cells).select("unique_id", "origin", "h", r("yhat", 8), *rq(7))


@query(f"SELECT unique_id, origin, h, round(yhat, 8) AS yhat, {sq(7)}, fail FROM ewma3")
def ewma_sum(spark, d):
    v = t.rv(spark, d)
    cells = windows.origin_schedule(v, t.START, t.END, [(3, 5)])
    return models.ewma(v, t.returns(spark, d), cells, horizons=[3], targets="sum").select("unique_id", "origin", "h", r("yhat", 8), *rq(7), "fail")


@query(f"""SELECT unique_id, origin, n, round(a, 5) AS a, round(b, 5) AS b, round((syy - sxy * sxy / sxx) / n, 5) AS sigma2, round(exp(a + b * lx), 5) AS median
    FROM (SELECT unique_id, ds AS origin, lx, regr_count(ly, px) OVER w AS n, regr_slope(ly, px) OVER w AS b, regr_intercept(ly, px) OVER w AS a,
                 regr_syy(ly, px) OVER w AS syy, regr_sxy(ly, px) OVER w AS sxy, regr_sxx(ly, px) OVER w AS sxx
          FROM (SELECT *, CASE WHEN px IS NOT NULL AND y > 0 THEN ln(y) END AS ly FROM (SELECT *, lag(lx) OVER ({P}) AS px FROM (
                SELECT v.unique_id, v.ds, v.y, ln(x.x) AS lx FROM rv v ASOF LEFT JOIN ridx x ON v.unique_id = x.unique_id AND v.ds >= x.ds)))
          WINDOW w AS ({P} ROWS UNBOUNDED PRECEDING))
    WHERE n >= 30 AND lx IS NOT NULL AND sxx > 0 AND origin BETWEEN DATE '{t.START}' AND DATE '{t.END}'""")
def dvol_regression(spark, d):
    v = t.rv(spark, d)
    fit = models.index_regression(v, t.index(v)).where((F.col("n") >= 30) & F.col("origin").between(F.lit(t.START), F.lit(t.END)))
    return fit.select("unique_id", "origin", "n", r("a", 5), r("b", 5), r("sigma2", 5), r("median", 5))


def _wide_cells(p: DataFrame, horizons: list[tuple[int, int]]) -> DataFrame:
    return windows.origin_schedule(p, t.START, t.END, horizons)


@query()
def har_forecast(spark, d):
    v = t.rv(spark, d)
    return models.har(v, _wide_cells(v, [(1, 1), (5, 5)]), targets={5: "sum"})


@query()
def dvol_forecast(spark, d):
    v = t.rv(spark, d)
    return models.dvol(v, t.index(v), _wide_cells(v, [(1, 1), (5, 5)]), targets={5: "sum"})


@query()
def garch_forecast(spark, d):
    x, v = t.returns(spark, d), t.rv(spark, d)
    return models.garch(x, _wide_cells(v, [(1, 1), (5, 5)]), rv=v, targets={5: "sum"})


@query()
def gjr_forecast(spark, d):
    x, v = t.returns(spark, d), t.rv(spark, d)
    return models.garch(x, _wide_cells(v, [(1, 1)]), asymmetric=True, rv=v)


@query()
def ets_forecast(spark, d):
    p = t.log_volume(spark, d)
    return models.ets(p, _wide_cells(p, [(1, 5)]))


@query()
def theta_forecast(spark, d):
    p = t.price(spark, d)
    return models.theta(p, _wide_cells(p, [(5, 5)]))


@query()
def trend_forecast(spark, d):
    p = t.price(spark, d)
    return models.trend_reference(p, _wide_cells(p, [(5, 5)]))


@query()
def external_stub(spark, d):
    p = t.price(spark, d)
    return models.external(p, _wide_cells(p, [(1, 5)]), models.stub_backend)


@query()
def gbt_forecast(spark, d):
    p = t.log_volume(spark, d)
    return models.boosted_refits(p, _wide_cells(p, [(1, 5)]), 1, every=250)


@query("""SELECT unique_id, CASE WHEN count(*) >= 3 AND min(y) > 0 THEN round(var_samp(d), 6) ELSE 0 END AS sigma2
    FROM (SELECT *, ln(y) - lag(ln(y)) OVER (PARTITION BY unique_id ORDER BY ds) AS d FROM price) GROUP BY 1""")
def log_change_variance(spark, d):
    return panel.log_change_variance(t.price(spark, d)).withColumn("sigma2", F.round("sigma2", 6))


@query("""SELECT unique_id, k, round(list_sort(list(y))[k], 6) AS value FROM price JOIN (SELECT unnest([1, 5, 100000]) AS k) ON true GROUP BY 1, 2""")
def order_statistics(spark, d):
    lists = t.price(spark, d).groupBy("unique_id").agg(F.collect_list("y").alias("ys"))
    asked = lists.withColumn("k", F.explode(F.array(F.lit(1), F.lit(5), F.lit(100000))))
    return asked.select("unique_id", "k", F.round(kth("ys", F.col("k")), 6).alias("value"))


@query("""SELECT 'RV_' || unique_id AS unique_id, CASE WHEN unique_id = 'N225_GK' THEN 'N225' ELSE unique_id || '-USD' END AS return_id, count(*) AS n
    FROM (SELECT CASE WHEN unique_id = 'AF' THEN 'N225_GK' ELSE unique_id END AS unique_id FROM rv) GROUP BY 1, 2""")
def rv_return_ids(spark, d):
    named = t.rv(spark, d).select(F.concat(F.lit("RV_"), F.when(F.col("unique_id") == "AF", "N225_GK").otherwise(F.col("unique_id"))).alias("unique_id"))
    return named.groupBy("unique_id", return_id("unique_id").alias("return_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT unique_id, h, ds_target, 'missing' AS kind FROM vcells WHERE unique_id = 'NO' UNION SELECT unique_id, 2, ds_target, 'extra' FROM vcells WHERE unique_id = 'AF'""")
def label_mismatch(spark, d):
    cells = windows.origin_schedule(t.log_volume(spark, d), t.START, t.END, [(1, 5)])
    made = cells.where("unique_id <> 'NO'").unionByName(cells.where("unique_id = 'AF'").withColumn("h", F.lit(2)))
    return evaluate.label_mismatch(cells, made)


@query("""SELECT model, unique_id, round(avg(abs(loss)) / nullif(avg(abs(bench_loss)), 0), 5) AS rel_mae, count(*) AS n FROM vpairs GROUP BY 1, 2""")
def relative_mae(spark, d):
    pairs = evaluate.paired_losses(t.volume_rows(spark, d), "SeasonalNaive7")
    return evaluate.relative_mae(pairs, ["model", "unique_id"]).withColumn("rel_mae", F.round("rel_mae", 5))


@query("""SELECT task, h, model, reason, count(*) AS n FROM rrows WHERE evaluation_fail GROUP BY 1, 2, 3, 4""")
def fail_reasons(spark, d):
    return evaluate.reason_counts(t.rv_rows(spark, d)).select("task", "h", "model", F.explode("reasons").alias("reason", "n"))


@query(f"""SELECT unique_id, origin, {", ".join(f"round(q[{i + 1}], 6) AS {c}" for i, c in enumerate(Q_COLUMNS))} FROM rw_vol""")
def levels_deciles(spark, d):
    p = t.log_volume(spark, d)
    f = models.random_walk(p, windows.origin_schedule(p, t.START, t.END, [(1, 5)]), [1])
    ends = {f"m-{side}-{x}": F.col(c) for side, levels in (("lo", ((80, "q10"), (60, "q20"), (40, "q30"), (20, "q40"))), ("hi", ((20, "q60"), (40, "q70"), (60, "q80"), (80, "q90")))) for x, c in levels}
    wide = f.select("unique_id", "origin", F.col("q50").alias("m"), *[x.alias(n) for n, x in ends.items()])
    return wide.select("unique_id", "origin", *[F.round(q, 6).alias(c) for q, c in zip(spread_deciles(levels_to_deciles("m")), Q_COLUMNS)])


@query(f"""SELECT task, model, unique_id, origin, h, fail, fail_reason, {", ".join(f"CASE WHEN NOT fail THEN round(q[{i + 1}], 6) END AS {c}" for i, c in enumerate(Q_COLUMNS))} FROM (
    SELECT task, model, unique_id, origin, h, q, fail OR yhat IS NULL AS fail, CASE WHEN fail THEN fail_reason WHEN yhat IS NULL THEN 'missing_forecast' END AS fail_reason
    FROM (SELECT * FROM vfacts UNION ALL SELECT * FROM rfacts))""")
def validated_forecasts(spark, d):
    both = t.volume_facts(spark, d).unionByName(t.rv_facts(spark, d))
    return models.validated(both, F.col("task") == "rv").select("task", "model", "unique_id", "origin", "h", "fail", "fail_reason", *rq())


# Evaluation


@query("""SELECT task, model, unique_id, origin, h, round(actual, 7) AS actual, evaluation_fail, reason AS evaluation_fail_reason, round(loss, 5) AS loss FROM rrows""")
def joined_actuals(spark, d):
    return t.rv_rows(spark, d).select("task", "model", "unique_id", "origin", "h", r("actual", 7), "evaluation_fail", "evaluation_fail_reason", r("loss", 5))


@query(f"""SELECT c.unique_id, c.origin, c.h, c.ds_target, round(a.s, 7) AS actual FROM rcells5 c LEFT JOIN (
    SELECT unique_id, ds, CASE WHEN count(y) OVER w = 5 THEN sum(y) OVER w END AS s FROM rv WINDOW w AS ({P} ROWS 4 PRECEDING)) a
    ON c.unique_id = a.unique_id AND c.ds_target = a.ds WHERE c.h = 5""")
def block_actuals(spark, d):
    v = t.rv(spark, d)
    return evaluate.actuals(windows.origin_schedule(v, t.START, t.END, [(5, 5)]), v, block=True).withColumn("actual", F.round("actual", 7))


_ok = "(actual IS NOT NULL AND yhat IS NOT NULL)"
_mh = ["task", "model", "h"]


@query(f"""SELECT task, model, h, round(avg(CASE WHEN {_ok} THEN abs(yhat - actual) END), 6) AS mae, round(avg(CASE WHEN {_ok} THEN power(yhat - actual, 2) END), 6) AS mse,
    round(sqrt(avg(CASE WHEN {_ok} THEN power(yhat - actual, 2) END)), 6) AS rmse, count(*) FILTER ({_ok}) AS n_used, count(*) FILTER (NOT {_ok}) AS n_dropped FROM vrows GROUP BY 1, 2, 3""")
def metric_mae_mse_rmse(spark, d):
    return evaluate.point_metrics(t.volume_rows(spark, d), _mh).select(*_mh, r("mae"), r("mse"), r("rmse"), "n_used", "n_dropped")


@query("""SELECT task, model, h, round(avg(CASE WHEN actual > 0 AND yhat > 0 THEN actual / yhat - ln(actual / yhat) - 1 END), 5) AS qlike,
    count(*) FILTER (coalesce(actual > 0 AND yhat > 0, false)) AS n_used, count(*) FILTER (NOT coalesce(actual > 0 AND yhat > 0, false)) AS n_dropped FROM rrows GROUP BY 1, 2, 3""")
def metric_qlike(spark, d):
    return evaluate.qlike_metric(t.rv_rows(spark, d), _mh).withColumn("qlike", F.round("qlike", 5))


@query("""SELECT task, model, h, round(avg(greatest(0.1 * (actual - q[1]), -0.9 * (actual - q[1]))), 6) AS pinball, count(actual - q[1]) AS n_used,
    count(*) - count(actual - q[1]) AS n_dropped FROM vrows GROUP BY 1, 2, 3""")
def metric_pinball(spark, d):
    return evaluate.pinball_metric(t.volume_rows(spark, d), _mh, "q10", 0.1).withColumn("pinball", F.round("pinball", 6))


_pb = " + ".join(f"avg(CASE WHEN ok THEN greatest({p} * (actual - q[{i}]), ({p} - 1) * (actual - q[{i}])) END)" for i, p in enumerate((0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), 1))


@query(f"""SELECT task, model, h, round(CAST(2.0 / 9 AS DOUBLE) * ({_pb}) / nullif(avg(CASE WHEN ok THEN abs(actual) END), 0), 6) AS wql, count(*) FILTER (ok) AS n_used,
    count(*) FILTER (NOT ok) AS n_dropped FROM (SELECT *, actual IS NOT NULL AND q IS NOT NULL AND len(list_filter(q, lambda x: x IS NOT NULL)) = 9 AS ok FROM vrows) GROUP BY 1, 2, 3""")
def metric_wql(spark, d):
    return evaluate.wql(t.volume_rows(spark, d), _mh).withColumn("wql", F.round("wql", 6))


_hit = "CASE WHEN actual IS NOT NULL AND q[1] IS NOT NULL AND q[9] IS NOT NULL THEN CAST(actual BETWEEN q[1] AND q[9] AS DOUBLE) END"


@query(f"SELECT task, model, h, round(avg({_hit}), 6) AS coverage, count({_hit}) AS n_used, count(*) - count({_hit}) AS n_dropped FROM allrows GROUP BY 1, 2, 3")
def coverage80(spark, d):
    rows = t.volume_rows(spark, d).unionByName(t.rv_rows(spark, d))
    return evaluate.coverage(rows, _mh).withColumn("coverage", F.round("coverage", 6))


@query(f"""SELECT task, model, h, CASE WHEN vol_proxy <= c[1] THEN 'low' WHEN vol_proxy <= c[2] THEN 'middle' ELSE 'high' END AS tercile,
    round(avg(hit), 6) AS coverage, count(*) AS n_used
    FROM (SELECT *, quantile_cont(vol_proxy, [CAST(1.0 / 3 AS DOUBLE), CAST(2.0 / 3 AS DOUBLE)]) OVER (PARTITION BY task, model, h) AS c
          FROM (SELECT *, {_hit} AS hit FROM vrows) WHERE hit IS NOT NULL AND vol_proxy IS NOT NULL) GROUP BY 1, 2, 3, 4""")
def coverage_tercile(spark, d):
    return evaluate.coverage_by_tercile(t.volume_rows(spark, d), _mh).withColumn("coverage", F.round("coverage", 6))


_curve = " UNION ALL ".join(f"SELECT task, model, h, {n} AS nominal, q[{a}] AS lo, q[{b}] AS hi, actual FROM vrows" for n, a, b in ((0.8, 1, 9), (0.6, 2, 8), (0.4, 3, 7), (0.2, 4, 6)))


@query(f"""SELECT task, model, h, CAST(nominal AS DOUBLE) AS nominal, round(avg(CAST(actual BETWEEN lo AND hi AS DOUBLE)), 6) AS observed, count(*) AS n_used
    FROM ({_curve}) WHERE actual IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL GROUP BY 1, 2, 3, 4""")
def calibration_curve(spark, d):
    return evaluate.calibration_curve(t.volume_rows(spark, d), _mh).withColumn("observed", F.round("observed", 6))


@query("SELECT task, h, model, unique_id, origin, round(loss, 6) AS loss, round(bench_loss, 6) AS bench_loss FROM vpairs")
def paired_losses(spark, d):
    return evaluate.paired_losses(t.volume_rows(spark, d), "SeasonalNaive7").select("task", "h", "model", "unique_id", "origin", r("loss"), r("bench_loss"))


@query("SELECT task, h, model, unique_id, round(ratio, 5) AS ratio, round(dbar, 5) AS dbar, n FROM vratios UNION ALL SELECT task, h, model, unique_id, round(ratio, 5), round(dbar, 5), n FROM rratios")
def series_ratios(spark, d):
    v = evaluate.series_ratios(evaluate.paired_losses(t.volume_rows(spark, d), "SeasonalNaive7"))
    w = evaluate.series_ratios(evaluate.paired_losses(t.rv_rows(spark, d), "EWMA"))
    return v.unionByName(w).select("task", "h", "model", "unique_id", r("ratio", 5), r("dbar", 5), "n")


@query("""SELECT f.task, f.h, f.model, n_fail, round(fail_rate, 6) AS fail_rate, round(median_ratio, 5) AS median_ratio, round(mean_ratio, 5) AS mean_ratio,
        round(win_rate, 6) AS win_rate, n_series, n_used, coalesce(reasons, '') AS reasons, coalesce(median_ratio > 5, false) OR coalesce(fail_rate > 0.4, false) AS broken
    FROM (SELECT task, h, model, count(*) FILTER (evaluation_fail) AS n_fail, avg(CAST(evaluation_fail AS DOUBLE)) AS fail_rate FROM rrows GROUP BY 1, 2, 3) f
    LEFT JOIN (SELECT task, h, model, quantile_cont(ratio, 0.5) AS median_ratio, avg(ratio) AS mean_ratio, avg(CAST(ratio < 1 AS DOUBLE)) AS win_rate, count(ratio) AS n_series,
                      sum(n)::BIGINT AS n_used FROM rratios GROUP BY 1, 2, 3) b ON f.task = b.task AND f.h = b.h AND f.model = b.model
    LEFT JOIN (SELECT task, h, model, string_agg(reason || '=' || n, ';' ORDER BY reason || '=' || n) AS reasons
               FROM (SELECT task, h, model, reason, count(*) AS n FROM rrows WHERE evaluation_fail GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) x
    ON f.task = x.task AND f.h = x.h AND f.model = x.model""")
def leaderboard(spark, d):
    b = evaluate.leaderboard(t.rv_rows(spark, d), "EWMA")
    return b.select("task", "h", "model", "n_fail", r("fail_rate"), r("median_ratio", 5), r("mean_ratio", 5), r("win_rate"), "n_series", "n_used", "reasons", "broken")


@query("""SELECT task, h, model, round(sum(s), 6) AS runtime_total, round(avg(s), 6) AS runtime_mean
    FROM (SELECT task, h, model, origin, max((h + day(origin)) / 10.0::DOUBLE) AS s FROM vrows GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def runtime(spark, d):
    rows = t.volume_rows(spark, d).withColumn("runtime_s", (F.col("h") + F.day("origin")) / 10.0)
    return evaluate.runtime(rows).select("task", "h", "model", r("runtime_total"), r("runtime_mean"))


@query("""SELECT task, h, half, model, round(avg(ratio), 5) AS mean_ratio, count(ratio) AS n_series FROM (
    SELECT p.task, p.h, half, model, unique_id, avg(loss) / nullif(avg(bench_loss), 0) AS ratio FROM vpairs p JOIN (
        SELECT task, h, origin, CASE WHEN row_number() OVER (PARTITION BY task, h ORDER BY origin) <= count(*) OVER (PARTITION BY task, h) // 2 THEN 'first' ELSE 'second' END AS half
        FROM (SELECT DISTINCT task, h, origin FROM vpairs)) o ON p.task = o.task AND p.h = o.h AND p.origin = o.origin GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4""")
def half_split(spark, d):
    return evaluate.half_split(t.volume_rows(spark, d), "SeasonalNaive7").withColumn("mean_ratio", F.round("mean_ratio", 5))


@query("""SELECT task, h, grp, model, round(quantile_cont(ratio, 0.5), 5) AS median_ratio, count(ratio) AS n_series
    FROM (SELECT *, substr(unique_id, 1, 1) AS grp FROM vratios UNION ALL SELECT *, 'all' FROM vratios) GROUP BY 1, 2, 3, 4""")
def group_breakdown(spark, d):
    out = evaluate.group_breakdown(t.volume_rows(spark, d), "SeasonalNaive7", F.substring("unique_id", 1, 1))
    return out.withColumn("median_ratio", F.round("median_ratio", 5))


@query("SELECT task, h, model, unique_id, round(ratio, 5) AS ratio, round(dbar, 5) AS dbar, n FROM vratios WHERE unique_id IN ('AF', 'RF')")
def special_series(spark, d):
    rows = t.volume_rows(spark, d).where(F.col("unique_id").isin("AF", "RF"))
    return evaluate.series_ratios(evaluate.paired_losses(rows, "SeasonalNaive7")).select("task", "h", "model", "unique_id", r("ratio", 5), r("dbar", 5), "n")


@query("SELECT task, h, model, origin, round(avg(loss - bench_loss), 6) AS dbar, count(*) AS n FROM vpairs GROUP BY 1, 2, 3, 4")
def loss_diff_by_origin(spark, d):
    return evaluate.loss_difference(t.volume_rows(spark, d), "SeasonalNaive7").withColumn("dbar", F.round("dbar", 6))


@query("""SELECT m.model, coalesce(have, 0) AS have, need, coalesce(have, 0) = need AS covered FROM (SELECT DISTINCT model FROM vrows) m
    LEFT JOIN (SELECT model, count(DISTINCT unique_id) AS have FROM vrows WHERE NOT evaluation_fail GROUP BY 1) g ON m.model = g.model
    CROSS JOIN (SELECT count(DISTINCT unique_id) AS need FROM lvol)""")
def mcs_gate(spark, d):
    return evaluate.mcs_gate(t.volume_rows(spark, d), t.log_volume(spark, d))


MODELS = ["RW", "SeasonalMedian4", "SeasonalNaive7"]


@query(f"""SELECT * FROM (SELECT unique_id, origin, {", ".join(f"round(max(CASE WHEN model = '{m}' THEN loss END), 6) AS {m}" for m in MODELS)}
    FROM vrows WHERE NOT evaluation_fail GROUP BY 1, 2) WHERE {" AND ".join(f"{m} IS NOT NULL" for m in MODELS)}""")
def mcs_matrix(spark, d):
    return evaluate.mcs_matrix(t.volume_rows(spark, d), MODELS).select("unique_id", "origin", *[r(m) for m in MODELS])


@query()
def mcs_result(spark, d):
    return inference.mcs(evaluate.mcs_matrix(t.volume_rows(spark, d), MODELS), MODELS)


# Tests


_ac = ", ".join(f"sum(c * c{k}) AS g{k}" for k in range(1, 13))
_lg = ", ".join(f"lag(c, {k}) OVER (PARTITION BY model, unique_id ORDER BY origin) AS c{k}" for k in range(1, 13))
_lv = " + ".join(f"CASE WHEN lag >= {k} THEN 2 * (1 - {k} / (lag + 1.0::DOUBLE)) * coalesce(g{k}, 0) / n ELSE 0 END" for k in range(1, 13))


@query(f"""SELECT model, unique_id, n, lag, round(dbar, 6) AS dbar,
        round(CASE WHEN most = 0 THEN 0 WHEN v > 0 THEN sqrt((n + 1 - 2) / n::DOUBLE) * dbar / sqrt(v / n) END, 4) AS statistic
    FROM (SELECT *, g0 / n + {_lv} AS v FROM (SELECT *, least(CAST(ceil(4 * power(n / 100.0, 2.0 / 9)) - 1 AS INT), n - 1)::INT AS lag FROM (
        SELECT model, unique_id, count(*) AS n, avg(d) AS dbar, max(abs(d)) AS most, sum(c * c) AS g0, {_ac} FROM (
            SELECT *, {_lg} FROM (SELECT model, unique_id, origin, loss - bench_loss AS d, loss - bench_loss - avg(loss - bench_loss) OVER (PARTITION BY model, unique_id) AS c
                                  FROM vpairs WHERE model <> 'SeasonalNaive7')) GROUP BY 1, 2)))""")
def dm_stat(spark, d):
    pairs = evaluate.paired_losses(t.volume_rows(spark, d), "SeasonalNaive7").where("model <> 'SeasonalNaive7'")
    return inference.dm_statistic(pairs, ["model", "unique_id"], 1).select("model", "unique_id", "n", "lag", r("dbar"), r("statistic", 4))


@query("""SELECT model, n, round(hit, 6) AS hit_rate, round(e, 6) AS expected, round(CASE WHEN v > 0 THEN (hit - e) / sqrt(v) END, 5) AS statistic FROM (
    SELECT *, e * (1 - e) / n - (power(2 * py - 1, 2) * px * (1 - px) / n + power(2 * px - 1, 2) * py * (1 - py) / n + 4 * px * py * (1 - px) * (1 - py) / (n * n)) AS v
    FROM (SELECT *, py * px + (1 - py) * (1 - px) AS e FROM (
        SELECT model, count(*)::DOUBLE AS nd, count(*) AS n, avg(CAST(x = y AS DOUBLE)) AS hit, avg(y) AS py, avg(x) AS px
        FROM (SELECT model, CAST(actual > origin_actual AS DOUBLE) AS y, CAST(yhat > origin_actual AS DOUBLE) AS x FROM vrows WHERE model <> 'RW')
        WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)))""")
def pt_stat(spark, d):
    rows = t.volume_rows(spark, d).where("model <> 'RW'")
    s = inference.pt_statistic(rows, ["model"], F.col("actual") - F.col("origin_actual"), F.col("yhat") - F.col("origin_actual"))
    return s.select("model", "n", r("hit_rate"), r("expected"), r("statistic", 5))


@query("""SELECT task, model, count(*) FILTER (dbar > 0) AS n_positive, count(*) FILTER (dbar < 0) AS n_negative, count(*) FILTER (dbar = 0) AS n_zero FROM vratios GROUP BY 1, 2""")
def sign_counts(spark, d):
    return inference.sign_counts(evaluate.series_ratios(evaluate.paired_losses(t.volume_rows(spark, d), "SeasonalNaive7")), ["task", "model"], "dbar")


def _xl(x: str, p: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln({p}) END"


CTE["viol"] = "SELECT model, unique_id, origin, CAST(actual < q[1] AS INT) AS v FROM vrows WHERE actual IS NOT NULL AND q[1] IS NOT NULL"
_uc = f"greatest(0, -2 * ({_xl('k', '0.1')} + {_xl('(n - k)', '0.9')} - {_xl('k', '(k / n::DOUBLE)')} - {_xl('(n - k)', '(1 - k / n::DOUBLE)')}))"


@query(f"SELECT model, unique_id, k AS n_viol, n, round({_uc}, 5) AS lr_uc FROM (SELECT model, unique_id, sum(v)::BIGINT AS k, count(*) AS n FROM viol GROUP BY 1, 2)")
def kupiec_lr(spark, d):
    return inference.kupiec(t.volume_rows(spark, d), ["model", "unique_id"], F.col("actual") < F.col("q10"), 0.1).withColumn("lr_uc", F.round("lr_uc", 5))


def _ll(k: str, m: str) -> str:
    return f"({_xl(k, f'({k} / nullif({m}, 0)::DOUBLE)')} + {_xl(f'({m} - {k})', f'(1 - {k} / nullif({m}, 0)::DOUBLE)')})"


@query(f"""SELECT model, unique_id, n, k AS n_viol, n00, n01, n10, n11, round(CASE WHEN good THEN ind END, 5) AS lr_ind, round(CASE WHEN good THEN ind + {_uc} END, 5) AS lr_cc FROM (
    SELECT *, greatest(0, -2 * ({_ll("(n01 + n11)", "(n - 1)")} - {_ll("n01", "(n00 + n01)")} - {_ll("n11", "(n10 + n11)")})) AS ind,
           n >= 2 AND k NOT IN (0, n) AND n00 + n01 > 0 AND n10 + n11 > 0 AS good FROM (
        SELECT model, unique_id, count(*) AS n, sum(v)::BIGINT AS k, count(*) FILTER (u = 0 AND v = 0) AS n00, count(*) FILTER (u = 0 AND v = 1) AS n01,
               count(*) FILTER (u = 1 AND v = 0) AS n10, count(*) FILTER (u = 1 AND v = 1) AS n11
        FROM (SELECT *, lag(v) OVER (PARTITION BY model, unique_id ORDER BY origin) AS u FROM viol) GROUP BY 1, 2))""")
def christoffersen_lr(spark, d):
    c = inference.christoffersen(t.volume_rows(spark, d), ["model", "unique_id"], F.col("actual") < F.col("q10"), 0.1)
    return c.drop("reason").withColumns({"lr_ind": F.round("lr_ind", 5), "lr_cc": F.round("lr_cc", 5)})


_pv = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 0.5)]


@query(f"""SELECT id, p, round(CASE WHEN p IS NOT NULL THEN least(1, max(s) OVER (ORDER BY p NULLS LAST, id ROWS UNBOUNDED PRECEDING)) END, 9) AS holm
    FROM (SELECT *, (count(p) OVER () - row_number() OVER (ORDER BY p NULLS LAST, id) + 1) * p AS s
          FROM (VALUES {", ".join(f"('{i}', {'NULL' if p is None else p}::DOUBLE)" for i, p in _pv)}) v(id, p))""")
def holm_adjust(spark, d):
    df = spark.createDataFrame(_pv, "id string, p double").withColumn("f", F.lit(1))
    return inference.holm(df, ["f"], "p", "id").select("id", "p", r("holm", 9))


@query()
def mbb_mean(spark, d):
    pairs = evaluate.paired_losses(t.volume_rows(spark, d), "SeasonalNaive7").withColumn("diff", F.col("loss") - F.col("bench_loss"))
    return inference.mbb_mean(pairs, ["model"], "diff", ["origin", "unique_id"], 5)


@query()
def tost_rel_mae(spark, d):
    return inference.tost_rel_mae(evaluate.paired_losses(t.volume_rows(spark, d), "SeasonalNaive7"), ["model"])


@query()
def primary_test(spark, d):
    return inference.primary_test(evaluate.series_ratios(evaluate.paired_losses(t.volume_rows(spark, d), "SeasonalNaive7")), ["model"])


@query()
def mde_empirical(spark, d):
    pairs = evaluate.paired_losses(t.volume_rows(spark, d), "SeasonalNaive7").withColumn("diff", F.col("loss") - F.col("bench_loss"))
    return inference.mde_empirical(pairs, ["model", "unique_id"], "diff", ["origin"], 1)


_plan = [("price", 1, 5), ("price", 5, 5), ("price", 20, 5), ("rv", 1, 1), ("rv", 5, 5), ("rv", 22, 22), ("volume", 1, 5), ("volume", 5, 5)]


@query(f"""SELECT task, h, step, (546 - h) // step + 1 AS n_origins, round(1 + 2 * coalesce(list_sum(list_transform(range(1, CAST(ceil(h / step::DOUBLE) AS INT)),
    lambda k: greatest(0, h - k * step) / h::DOUBLE)), 0), 9) AS design_effect FROM (VALUES {", ".join(f"('{a}', {h}, {s})" for a, h, s in _plan)}) v(task, h, step)""")
def mde_analytic(spark, d):
    # The window has 546 calendar days from 2000-01-01 to 2001-06-29.
    rows = [(a, h, s, (546 - h) // s + 1, round(overlap_design_effect(h, s), 9)) for a, h, s in _plan]
    return spark.createDataFrame(rows, "task string, h int, step int, n_origins int, design_effect double")


@query()
def mde_table(spark, d):
    rows = [(a, h, s, mde((546 - h) // s + 1, overlap_design_effect(h, s))) for a, h, s in _plan]
    return spark.createDataFrame(rows, "task string, h int, step int, mde_sd double")


# Audits and the store


CTE["hours"] = "SELECT event_type AS unique_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS epoch, count(*) AS n FROM events GROUP BY 1, 2"


@query("""SELECT unique_id, count(*) AS n_points, sum(n - 1)::BIGINT AS n_repeated, count(*) FILTER (epoch % 3600 <> 0) AS n_off_grid,
    (max(epoch) - min(epoch)) // 3600 + 1 AS n_expected, (max(epoch) - min(epoch)) // 3600 + 1 - count(*) AS n_missing, false AS passed FROM hours GROUP BY 1""")
def audit_grid(spark, d):
    e = t.table(spark, d, "events").select(F.col("event_type").alias("unique_id"), F.unix_timestamp(F.date_trunc("hour", "ts")).alias("epoch"))
    return audit.audit_grid(e, "unique_id", "epoch", 3600)


@query("""SELECT 'ohlc' AS name, count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR low <= 0) = 0 AS passed,
    count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR low <= 0) AS violation_count, count(*) AS n_rows FROM ohlc""")
def audit_ohlc(spark, d):
    return audit.audit_ohlc(t.ohlc(spark, d))


@query(f"""SELECT count(DISTINCT CASE WHEN f <> DATE '1995-01-01' THEN unique_id END) AS late_series, count(*) FILTER (p >= ds) AS not_increasing,
    count(*) FILTER (isodow(ds) = 7 OR (isodow(ds) = 6 AND year(ds) >= 1990)) AS weekend_rows, count(*) AS n_rows
    FROM (SELECT *, lag(ds) OVER ({P}) AS p, min(ds) OVER (PARTITION BY unique_id) AS f FROM price)""")
def audit_dates(spark, d):
    return audit.audit_dates(t.price(spark, d), "1995-01-01")


@query("SELECT unique_id, count(*) FILTER (y = 0) AS n_zero, round(avg(CAST(y IS NULL AS DOUBLE)), 6) AS null_rate FROM price GROUP BY 1")
def audit_zero_null(spark, d):
    return audit.audit_zero_null(t.price(spark, d)).withColumn("null_rate", F.round("null_rate", 6))


@query("""SELECT unique_id, count(*) AS n_rows, round(avg(CAST(y IS NULL AS DOUBLE)), 6) AS missing_rate, count(*) FILTER (y <= 0) AS n_nonpositive,
    avg(CAST(y IS NULL AS DOUBLE)) <= 0.05 AND count(*) FILTER (y <= 0) = 0 AS passed FROM rv GROUP BY 1""")
def audit_rv(spark, d):
    return audit.audit_rv(panel.gk_daily(t.ohlc(spark, d))).withColumn("missing_rate", F.round("missing_rate", 6))


@query("SELECT unique_id, least(count(*), 20) AS n_sampled FROM price GROUP BY 1")
def sample_rows(spark, d):
    return audit.sample_rows(t.price(spark, d), 20, 7).groupBy("unique_id").agg(F.count(F.lit(1)).alias("n_sampled"))


@query("""SELECT model, expected, actual, expected = actual AS match FROM (SELECT model, count(*) AS actual FROM vfacts GROUP BY 1)
    JOIN (SELECT count(*) AS expected FROM vcells) ON true""")
def manifest_recon(spark, d):
    n = windows.origin_schedule(t.log_volume(spark, d), t.START, t.END, [(1, 5)]).agg(F.count(F.lit(1)).alias("expected"))
    models_ = spark.createDataFrame([(m,) for m in MODELS], "model string").crossJoin(n)
    return store.manifest(models_, t.volume_facts(spark, d))


@query("SELECT DISTINCT origin FROM vcells WHERE NOT (origin < DATE '2000-09-01' AND NOT (unique_id = 'AF' AND day(origin) = 5))")
def resume_pending(spark, d):
    cells = windows.origin_schedule(t.log_volume(spark, d), t.START, t.END, [(1, 5)])
    done = cells.where("origin < '2000-09-01' AND NOT (unique_id = 'AF' AND day(origin) = 5)")
    return store.pending(cells, done)


@query("SELECT model, unique_id, 2 AS copies, count(*) AS n_keys FROM vfacts WHERE unique_id = 'NO' GROUP BY 1, 2")
def key_collisions(spark, d):
    facts = t.volume_facts(spark, d)
    twice = facts.unionByName(facts.where("unique_id = 'NO'"))
    return store.key_collisions(twice).groupBy("model", "unique_id", F.col("count").cast("int").alias("copies")).agg(F.count(F.lit(1)).alias("n_keys"))


@query("SELECT unique_id, min(ds) AS first_ds, max(ds) AS last_ds, count(*) AS n FROM price GROUP BY 1")
def panel_fingerprint(spark, d):
    return store.panel_fingerprint(t.price(spark, d)).drop("sha256")


# Streams, run to the end of what is there


@query("SELECT unique_id, ts, close, n FROM candles")
def stream_tumbling_candles(spark, d):
    rows = streams.tumbling_candles(streams.event_stream(spark, d))
    return streams.run_to_end(rows, streams.folder(spark, "candles"), ["unique_id", "ts"])


@query(RV_DAYS)
def stream_tumbling_rv(spark, d):
    return panel.realized_variance(stream_tumbling_candles(spark, d), 24).withColumn("rv", F.round("rv", 6))


@query(f"""SELECT unique_id, n, {", ".join(f"round(q[{i + 1}], 6) AS {c}" for i, c in enumerate(Q_COLUMNS))} FROM (
    SELECT unique_id, count(*) AS n, quantile_cont(r, {QL}) FILTER (k <= {streams.HELD}) AS q FROM (
        SELECT event_type AS unique_id, r, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM (
            SELECT *, value / lag(value) OVER e AS r, value > 0 AND lag(value) OVER e > 0 AS ok FROM events WHERE value IS NOT NULL WINDOW e AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE ok) GROUP BY 1)""")
def stream_ratio_state(spark, d):
    rows = streams.ratio_state(streams.event_stream(spark, d))
    return streams.run_to_end(rows, streams.folder(spark, "ratios"), ["unique_id"]).select("unique_id", "n", *rq())


@query("""SELECT unique_id, n, round(power(0.94, n) * (seed + 0.06 * s), 6) AS sigma2 FROM (
    SELECT event_type AS unique_id, count(*) AS n, avg(value * value) FILTER (k <= 20) AS seed, sum(value * value * power(0.94, -k)) AS s
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL) GROUP BY 1)""")
def stream_ewma_state(spark, d):
    rows = streams.ewma_state(streams.event_stream(spark, d))
    return streams.run_to_end(rows, streams.folder(spark, "ewma"), ["unique_id"]).select("unique_id", "n", r("sigma2"))
