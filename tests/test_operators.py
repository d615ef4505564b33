"""Hand-computed values, parsers on byte fixtures and leakage tests."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns, special
from tidemark.functions.columns import garman_klass, overlap_design_effect, pinball, qlike
from tidemark.operators import audit, evaluate, inference, models, panel, windows
from tidemark.plans import commands
from tidemark.plans.config import load_task
from tidemark.sources import readers, store

DAY = dt.date(2025, 1, 1)


def series(spark, values, uid="x", start=DAY, weekdays=False):
    rows, day = [], start
    for v in values:
        while weekdays and day.weekday() > 4:
            day += dt.timedelta(1)
        rows.append((uid, day, None if v is None else float(v)))
        day += dt.timedelta(1)
    return spark.createDataFrame(rows, "unique_id string, ds date, y double")


def one(df):
    return df.collect()[0]


def test_scalar_losses(spark):
    df = spark.createDataFrame([(0.1, 1.0, 100.0, 110.0, 95.0, 105.0)], "y double, f double, o double, h double, l double, c double")
    r = one(df.select(qlike("y", "f"), garman_klass("o", "h", "l", "c"), pinball(F.lit(10.0), F.lit(8.0), 0.9), qlike(F.lit(-1.0), F.lit(1.0))))
    assert r[0] == pytest.approx(1.402585, abs=1e-6)
    assert r[1] == pytest.approx(0.00982672327557351)
    assert r[2] == pytest.approx(1.8)
    assert r[3] is None


def test_block_sums(spark):
    ends = lambda n, h, a: [r.y for r in panel.block_sums(series(spark, range(1, n + 1)), h, a).orderBy("ds").collect()]
    assert ends(7, 3, "start") == [6, 15]
    assert ends(8, 3, "end") == [12, 21]
    assert ends(2, 3, "end") == []
    assert [r.y for r in panel.block_sums(series(spark, [1, None, 3]), 3, "end").collect()] == [None]


def candles(spark, gaps=(), days=1, skip=()):
    start = dt.datetime(2025, 1, 1)
    rows = [("r", start + dt.timedelta(minutes=5 * i, days=d), math.exp(0.001 * i) * (100 if d else 1)) for d in range(days) if d not in skip for i in range(288) if i not in gaps]
    return spark.createDataFrame(rows, "unique_id string, ts timestamp_ntz, close double")


def test_realized_variance(spark):
    got = panel.realized_variance(candles(spark, days=2), 288).orderBy("ds").collect()
    assert [(round(r.rv, 9), r.m_intervals, r.reason) for r in got] == [(0.000287, 287, None)] * 2
    hole = one(panel.realized_variance(candles(spark, gaps={100}), 288))
    assert (hole.rv, hole.m_intervals, hole.reason) == (None, 286, "missing_intervals")
    skipped = panel.realized_variance(candles(spark, days=3, skip={1}), 288).orderBy("ds").collect()
    assert [(r.rv is None, r.m_intervals) for r in skipped] == [(False, 287), (True, 0), (False, 287)]


def test_schedule_on_native_calendar(spark):
    p = series(spark, range(12), weekdays=True)
    days = [r.ds for r in p.orderBy("ds").collect()]
    got = windows.origin_schedule(p, "2025-01-01", "2025-12-31", [(5, 5)]).orderBy("origin").collect()
    assert [(r.origin, r.ds_target) for r in got] == [(days[0], days[5]), (days[5], days[10])]


def test_naive_models(spark):
    p = series(spark, range(35))
    cells = p.select("unique_id", F.col("ds").alias("origin"), F.lit(1).alias("h"), F.date_add("ds", 1).alias("ds_target")).where("origin = '2025-02-04'")
    walk = one(models.random_walk(p, cells, [1]))
    assert (walk.yhat, walk.q10, walk.median) == (34, 35, 34)
    assert one(models.seasonal(p, cells, 1)).yhat == 28
    assert one(models.seasonal(p, cells, 4)).yhat == np.median([7, 14, 21, 28])


def rv_panel(spark, n=150, seed=5):
    rng = np.random.default_rng(seed)
    rv = series(spark, rng.lognormal(-8, 0.3, n), "RV_BTC")
    ret = series(spark, rng.normal(0, 0.02, n), "RV_BTC").withColumnRenamed("y", "ret")
    return rv, ret


@pytest.mark.parametrize("model", ["prev", "ewma", "har", "garch", "walk", "ets", "theta", "trend", "external", "index"])
def test_the_future_changes_no_forecast(spark, model):
    rv, ret = rv_panel(spark)
    cells = windows.origin_schedule(rv, "2025-04-01", "2025-05-28", [(1, 10)])
    more = series(spark, [9.0], "RV_BTC", dt.date(2030, 1, 1))

    def made(v, x):
        out = {
            "prev": lambda: models.naive_prev(v, cells, [1]),
            "ewma": lambda: models.ewma(v, x, cells),
            "har": lambda: models.har(v, cells),
            "garch": lambda: models.garch(x, cells),
            "walk": lambda: models.random_walk(v, cells, [1], 60),
            "ets": lambda: models.ets(v, cells),
            "theta": lambda: models.theta(v, cells),
            "trend": lambda: models.trend_reference(v, cells),
            "external": lambda: models.external(v, cells, models.stub_backend),
            "index": lambda: models.index_regression(v, v.where("dayofmonth(ds) % 3 = 0").withColumnRenamed("y", "x")).where("origin < '2025-05-28'"),
        }[model]()
        return sorted(out.collect(), key=lambda r: (r.unique_id, r.origin))

    before, after = made(rv, ret), made(rv.unionByName(more), ret.unionByName(more.withColumnRenamed("y", "ret")))
    assert before and before == after
    if model in ("prev", "ewma", "har"):
        assert all(r.yhat > 0 and not r.fail for r in before)
    if model == "har":
        assert all(r.yhat > r.median for r in before)


def test_garch_recovers_persistence():
    rng = np.random.default_rng(8)
    s, r = 1.25e-4, []
    for z in rng.normal(size=1200):
        r.append(math.sqrt(s) * z)
        s = 5e-6 + 0.08 * r[-1] ** 2 + 0.88 * s
    w, a, g, b = models.garch_fit(100 * np.array(r), False)
    assert abs(a + b - 0.96) < 0.15 and g == 0


def test_validated_forecasts(spark):
    q = ", ".join(f"{c} double" for c in models.Q_COLUMNS)
    up, down = list(map(float, range(1, 10))), list(map(float, range(9, 0, -1)))
    rows = [("a", 1.0, 1.0, *up, False, None), ("b", 1.0, 1.0, *down, False, None), ("c", -1.0, 1.0, *up, False, None), ("d", math.nan, 1.0, *up, None, None), ("e", 1.0, 1.0, *up, True, "x")]
    df = spark.createDataFrame(rows, f"id string, yhat double, median double, {q}, fail boolean, fail_reason string")
    got = {r.id: (r.fail, r.fail_reason, r.q10, r.yhat) for r in models.validated(df, F.lit(True)).collect()}
    assert got == {
        "a": (False, None, 1.0, 1.0),
        "b": (False, None, None, 1.0),
        "c": (True, "nonpositive_forecast", None, None),
        "d": (True, "missing_forecast", None, None),
        "e": (True, "x", None, None),
    }


def test_asof_join(spark):
    left = series(spark, [1, 2, 3, 4])
    right = series(spark, [10], start=DAY + dt.timedelta(1)).withColumnRenamed("y", "x")
    assert [r.x for r in panel.asof_join(left, right).orderBy("ds").collect()] == [None, 10, 10, 10]


def test_statistics(spark):
    assert special.sign_pvalue(3, 1) == pytest.approx(0.625)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.t_sf(2.228139, 10) == pytest.approx(0.025, abs=1e-6)
    assert special.mde(19) == pytest.approx(0.68, abs=0.01)
    assert overlap_design_effect(22, 5) == pytest.approx(4.4545, abs=1e-4)
    from tidemark.functions.columns import hln_factor, kupiec_lr, newey_west_lag

    r = one(spark.range(1).select(newey_west_lag(F.lit(100)), hln_factor(F.lit(21.0), 20), kupiec_lr(F.lit(25), F.lit(250), 0.1)))
    assert (r[0], round(r[1], 4), round(r[2], 9)) == (3, 0.0673, 0)
    p = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.03), (1, "c", 0.04)], "f int, id string, p double")
    assert [round(x.holm, 6) for x in inference.holm(p, ["f"], "p", "id").orderBy("id").collect()] == [0.03, 0.06, 0.06]


def test_diebold_mariano_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(1, 1, 80) ** 2, rng.normal(0.5, 1, 80) ** 2
    rows = [("m", DAY + dt.timedelta(i), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    got = one(inference.dm_test(spark.createDataFrame(rows, "model string, origin date, loss double, bench_loss double"), ["model"], 1))
    d = a - b
    c, n, lag = d - d.mean(), 80, 3
    v = c @ c / n + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lag + 1))
    assert got.lag == lag and got.statistic == pytest.approx(math.sqrt((n - 1) / n) * d.mean() / math.sqrt(v / n))
    assert got.pvalue == pytest.approx(2 * special.t_sf(abs(got.statistic), n - 1))


def test_model_confidence_set():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(250, 1)) ** 2
    losses = np.hstack([base, base + 0.05 * rng.normal(size=(250, 1)), base + 1 + 0.1 * rng.normal(size=(250, 1))])
    p = inference.model_confidence_set(losses, ["good", "same", "bad"])
    assert p["good"] > 0.1 and p["bad"] <= 0.1


def test_failure_reasons(spark):
    facts = [("rv", "M", "x", DAY, 1, DAY + dt.timedelta(k), v, f, r) for k, v, f, r in ((1, 2.0, False, None), (2, -1.0, False, None), (3, 1.0, True, "fit_error"), (4, None, False, None), (9, 1.0, False, None))]
    df = spark.createDataFrame(facts, "task string, model string, unique_id string, origin date, h int, ds_target date, yhat double, fail boolean, fail_reason string")
    rows = evaluate.evaluated(df, series(spark, [1, 1, 1, 1, 1]), rv=True).orderBy("ds_target").collect()
    assert [r.evaluation_fail_reason for r in rows] == ["", "nonpositive_forecast", "fit_error", "missing_forecast", "missing_actual"]


def test_era_dates(spark):
    texts = ["S64.1.7", "H1.1.8", "R8.7.31", "S49.9.24", "M45.7.29", "S64.1.8", "R0.5.1", "X1.1.1", "H31.5.1", "R8.2.30"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(readers.era_date(F.col("t"))).collect()]
    assert [str(x) for x in got[:5]] == ["1989-01-07", "1989-01-08", "2026-07-31", "1974-09-24", "1912-07-29"]
    assert got[5:] == [None] * 5


def test_csv_readers(spark, tmp_path):
    (tmp_path / "fx.csv").write_text("﻿Date, USD,JPY\n2025-01-01,1.0,180\n2025-01-02,-,181\nbad,1,1\n2025-01-02,N/A,182\n", encoding="utf-8")
    fx = {(r.unique_id, str(r.ds)): r.y for r in readers.read_fx_csv(spark, str(tmp_path / "fx.csv")).collect()}
    assert fx == {("EURUSD", "2025-01-01"): 1.0, ("EURJPY", "2025-01-01"): 180.0, ("EURJPY", "2025-01-02"): 182.0}
    (tmp_path / "h.csv").write_bytes("国債金利\n基準日,2年,20年\nS49.9.24,8.0,-\nR8.7.31,0.2,1.0\n".encode("cp932"))
    (tmp_path / "c.csv").write_bytes("基準日,2年,20年\nR8.7.31,0.3,1.1\n".encode("cp932"))
    bonds = {(r.unique_id, str(r.ds)): r.y for r in readers.read_bonds(spark, str(tmp_path / "h.csv"), str(tmp_path / "c.csv")).collect()}
    assert bonds == {("JGB_2Y", "1974-09-24"): 8.0, ("JGB_2Y", "2026-07-31"): 0.3, ("JGB_20Y", "2026-07-31"): 1.1}
    (tmp_path / "i.csv").write_bytes('データ日付,終値,始値,高値,安値\n"2025/01/06","42,100.5","42,000.0","42,200.0","41,900.0"\n本資料は\n'.encode("cp932"))
    r = one(readers.read_index_csv(spark, str(tmp_path / "i.csv")))
    assert (str(r.ds), r.close, r.open, r.low) == ("2025-01-06", 42100.5, 42000.0, 41900.0)


def test_candles_and_paging(spark):
    page = lambda x: spark.createDataFrame([(x,)], "payload string")
    got = readers.parse_candles(page("[[300,1,2,1,2,5],[0,1,2,1,2,5],[300,1,2,1,2,5]]")).orderBy("epoch").collect()
    assert [r.epoch for r in got] == [0, 300]
    with pytest.raises(Exception, match="conflicting"):
        readers.parse_candles(page("[[300,1,2,1,2,5],[300,1,2,1,3,5]]")).collect()
    pages = {10: ([3, 4], 5), 5: ([1, 2], None)}
    assert readers.continued(lambda end: pages[end], 10) == [3, 4, 1, 2]
    with pytest.raises(ValueError):
        readers.continued(lambda end: ([], end), 10)
    spark.dataSource.register(readers.paged_source("pages_test", lambda a, b: [(e, 1.0) for e in range(a, b, 60)], "epoch long, close double", 0, 60 * 700, 60))
    df = spark.read.format("pages_test").load()
    assert df.count() == 700 and df.rdd.getNumPartitions() == 3


def test_audits(spark):
    e = spark.createDataFrame([("k", 0), ("k", 300), ("k", 900), ("k", 900)], "id string, epoch long")
    r = one(audit.audit_grid(e, "id", "epoch", 300))
    assert (r.n_missing, r.n_repeated, r.passed) == (1, 1, False)
    bad = spark.createDataFrame([(1.0, 0.5, 0.4, 0.8), (1.0, 2.0, 0.5, 1.5)], "open double, high double, low double, close double")
    assert one(audit.audit_ohlc(bad)).violation_count == 1
    pages = spark.createDataFrame([(1, 0, 1.0), (1, 300, 2.0), (2, 300, 2.0), (2, 600, 3.0)], "page int, epoch long, close double")
    assert tuple(one(audit.page_overlaps(pages))) == (1, 0)


def test_store_run_resume_and_report(spark, tmp_path):
    rng = np.random.default_rng(3)
    p = series(spark, np.cumsum(rng.normal(size=120)) + 50, "A").unionByName(series(spark, np.cumsum(rng.normal(size=120)) + 70, "B"))
    task = load_task({"task": "price", "series": ["A", "B"], "horizons": [{"h": 1, "step": 5}, {"h": 5, "step": 5}], "windows": {"main": ["2025-02-01", "2025-04-20"]}, "primary_benchmark": "RW"})
    base = str(tmp_path / "store")
    dry = commands.run(spark, task, "main", p, base, ["RW", "AutoTheta"], dry=True)
    done = commands.run(spark, task, "main", p, base, ["rw", "AutoTheta"])
    assert {m: x["expected"] for m, x in done["models"].items()} == dry["expected"] and all(x["match"] for x in done["models"].values())
    facts = store.ForecastStore(spark, base)
    whole = sorted(map(tuple, facts.read().select("model", "unique_id", "origin", "h", "yhat").collect()))
    chunk = facts.read().where("origin < '2025-02-15'").drop("origin_month").checkpoint()
    facts.write(chunk)
    assert sorted(map(tuple, facts.read(check=True).select("model", "unique_id", "origin", "h", "yhat").collect())) == whole
    again = commands.run(spark, task, "main", p, base, ["RW", "AutoTheta"])
    assert again == done
    tables = commands.report(facts.read(), p, task, str(tmp_path / "out"))
    bench = [r for r in tables["leaderboard"] if r["model"] == "RW"]
    assert bench and all(r["median_ratio"] == 1 and not r["broken"] for r in bench) and (tmp_path / "out/summary.md").exists()
    twice = facts.read().unionByName(facts.read().limit(1))
    assert store.key_collisions(twice).count() == 1


def walk(spark, seed, n, uid, start=100.0, scale=1.0):
    rng = np.random.default_rng(seed)
    return series(spark, start + scale * np.cumsum(rng.normal(size=n)), uid)


def test_sums_are_regressed_in_blocks_before_the_origin(spark):
    rng = np.random.default_rng(5)
    v = np.exp(rng.normal(size=140))
    rv = series(spark, v, "A")
    days = [r.ds for r in rv.orderBy("ds").collect()]
    h, k, n = 3, 131, 100
    cells = spark.createDataFrame([("A", days[k - 1], h, days[k - 1 + h])], "unique_id string, origin date, h int, ds_target date")
    for goal in ("sum", "direct"):
        got = one(models.har(rv, cells, n=n, targets=goal))
        w = v[k - n : k]
        feature = lambda i: np.log([w[i], w[i - 4 : i + 1].mean(), w[i - 21 : i + 1].mean()])
        if goal == "sum":
            at = [(i - 1, w[i : i + h].sum()) for i in range(n % h, n, h) if i - 1 >= 21]
        else:
            at = [(i - h, w[i]) for i in range(h, n) if i - h >= 21]
        x, y = np.array([[1, *feature(i)] for i, _ in at]), np.log([t for _, t in at])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        e, mu = y - x @ beta, float(np.array([1, *feature(n - 1)]) @ beta)
        assert got.median == pytest.approx(math.exp(mu)) and got.yhat == pytest.approx(math.exp(mu + np.mean(e**2) / 2))
        assert got.q90 == pytest.approx(math.exp(mu + np.quantile(e, 0.9)))


def test_dvol_skips_an_index_of_zero_and_says_where_none_is(spark):
    rng = np.random.default_rng(6)
    v, x = np.exp(rng.normal(size=60)), np.exp(rng.normal(size=60)) * 50
    x[10] = 0.0
    rv = series(spark, v, "A").unionByName(series(spark, v, "B"))
    days = [r.ds for r in rv.where("unique_id = 'A'").orderBy("ds").collect()]
    index = spark.createDataFrame([("A", d, float(i) if k % 7 else None) for k, (d, i) in enumerate(zip(days, x))], "unique_id string, ds date, x double")
    cells = spark.createDataFrame([(u, days[50], 1, days[51]) for u in "AB"], "unique_id string, origin date, h int, ds_target date")
    got = {r.unique_id: r for r in models.dvol(rv, index, cells).collect()}
    assert got["B"].fail_reason == "missing_dvol_history"
    state, last = [], None
    for k, i in enumerate(x):
        last = i if k % 7 else last
        state.append(None if not last else 2 * math.log(last / 100) - math.log(365))
    at = [(state[k - 1], math.log(v[k])) for k in range(1, 51) if state[k - 1] is not None]
    b, a = np.polyfit(*zip(*at), 1)
    assert got["A"].median == pytest.approx(math.exp(a + b * state[50]))


def test_garch_targets_and_ratios(spark):
    rng = np.random.default_rng(7)
    r = 0.01 * rng.normal(size=300)
    rv = series(spark, r * r * rng.uniform(0.5, 2, 300) + 1e-9, "RV_BTC")
    returns = series(spark, r, "RV_BTC").withColumnRenamed("y", "ret")
    days = [x.ds for x in rv.orderBy("ds").collect()]
    cells = spark.createDataFrame([("RV_BTC", days[290], h, days[290 + h]) for h in (1, 3)], "unique_id string, origin date, h int, ds_target date")
    one_, three = sorted(models.garch(returns, cells, rv=rv, targets={3: "sum"}).collect(), key=lambda x: x.h)
    direct = next(x for x in models.garch(returns, cells, rv=rv).collect() if x.h == 3)
    known = (100 * r[:291]) ** 2
    w, a, _, b = p = models.garch_fit(100 * r[:291], False)
    s = [float(np.mean(known))]
    for x in known:
        s.append(w + a * x + b * s[-1])
    ahead = [s[-1]]
    for _ in range(2):
        ahead.append(w + (a + b) * ahead[-1])
    assert np.allclose(models.garch_filter(known, 0 * known, p), s)
    assert one_.yhat == pytest.approx(ahead[0] / 1e4) and direct.yhat == pytest.approx(ahead[2] / 1e4) and three.yhat == pytest.approx(sum(ahead) / 1e4)
    real = np.array([x.y for x in rv.orderBy("ds").collect()])[:291]
    ratios = real / (np.array(s[:-1]) / 1e4)
    assert one_.q10 == pytest.approx(ahead[0] / 1e4 * np.quantile(ratios, 0.1))
    blocks = [real[i : i + 3].sum() / (3 * s[i - 1] / 1e4) for i in range(291 % 3, 291, 3) if i]
    assert three.q90 == pytest.approx(three.yhat * np.quantile(blocks, 0.9))


def test_run_and_report_of_variances(spark, tmp_path):
    rng = np.random.default_rng(8)
    uids = ["RV_BTC", "RV_ETH", "RV_N225_GK"]
    r = {u: 0.01 * rng.normal(size=220) for u in uids}
    rv = None
    for u in uids:
        part = series(spark, r[u] ** 2 * rng.uniform(0.5, 2, 220) + 1e-8, u)
        rv = part if rv is None else rv.unionByName(part)
    asset = {"RV_BTC": "BTC-USD", "RV_ETH": "ETH-USD", "RV_N225_GK": "N225"}
    returns = None
    for u in uids:
        part = series(spark, r[u], asset[u]).withColumnRenamed("y", "ret")
        returns = part if returns is None else returns.unionByName(part)
    index = rv.where("unique_id = 'RV_BTC'").select(F.lit("DVOL_BTC").alias("unique_id"), "ds", (100 * F.sqrt(365 * F.col("y"))).alias("x"))
    days = [str(x.ds) for x in rv.where("unique_id = 'RV_BTC'").orderBy("ds").collect()]
    task = load_task({"task": "rv", "series": uids, "horizons": [{"h": 1, "step": 4}, {"h": 3, "step": 8, "target": "sum"}], "windows": {"main": [days[180], days[210]]}, "primary_benchmark": "EWMA", "estimation_windows": {"rv_crypto": 150}})
    base = str(tmp_path / "store")
    with pytest.raises(ValueError, match="DVOL needs an index"):
        commands.run(spark, task, "main", rv, base, returns=returns)
    names = ["NaivePrev", "EWMA", "GARCH", "GJR-GARCH", "HAR-RV", "DVOL"]
    done = commands.run(spark, task, "main", rv, base, names, returns, index)
    assert all(x["match"] for x in done["models"].values())
    n = done["models"]["EWMA"]["expected"]
    assert done["models"]["GJR-GARCH"]["expected"] * 3 == n and done["models"]["DVOL"]["expected"] * 3 == 2 * n
    assert commands.resolve_run(base, "rv", "main") == done["run_id"] == commands.resolve_run(f"file://{base}", "rv", "main")
    with pytest.raises(ValueError, match="other rows"):
        commands.write_manifest(base, done["run_id"], {"EWMA": 1})
    assert json.loads((tmp_path / f"store/_runs/config_{done['run_id']}.json").read_text())["models"]["DVOL"]["refit_every"] == 5
    facts = store.ForecastStore(spark, base).read()
    reasons = {(x.unique_id, x.fail_reason) for x in facts.where("model = 'DVOL'").collect()}
    assert reasons == {("RV_BTC", None), ("RV_ETH", "missing_dvol_history")}
    tables = commands.report(facts, rv, task, f"file://{tmp_path}/out", commands.expected_rows(base, done["run_id"]))
    assert {x["model"] for x in tables["leaderboard"]} == set(names) and all(x["match"] for x in tables["manifest"])
    assert tables["kupiec"] and tables["calibration_curve"] and tables["tost"] and tables["groups"] and tables["directions"]
    assert {x["h"] for x in tables["mcs"]} <= {1, 3} and (tmp_path / "out/summary.md").exists()


def test_small_expressions(spark):
    row = one(spark.createDataFrame([([3.0, None, 1.0, 2.0],)], "xs array<double>").select(columns.kth("xs", 2).alias("a"), columns.kth("xs", 9).alias("b")))
    assert (row.a, row.b) == (2.0, None)
    assert columns.value_column(["ds", "rv"]) == "rv" and columns.quantile_column(["q10", "0.9"], 0.9) == "0.9" and columns.quantile_column(["median"], 0.5) == "median"
    with pytest.raises(ValueError):
        columns.value_column(["ds"])
    got = {r.u: r.i for r in spark.createDataFrame([("RV_BTC",), ("RV_N225_GK",), ("N225",)], "u string").select("u", columns.return_id("u").alias("i")).collect()}
    assert got == {"RV_BTC": "BTC-USD", "RV_N225_GK": "N225", "N225": "N225"}
    p = series(spark, range(1, 11), "EURUSD").unionByName(series(spark, range(1, 11), "VOL_BTC"))
    kept = panel.estimation_windows(p, {"fx": 4}).groupBy("unique_id").count().collect()
    assert {r.unique_id: r["count"] for r in kept} == {"EURUSD": 4, "VOL_BTC": 10}
    assert panel.estimation_windows(p, {"fx": 4}, expanding=True).count() == 20
    assert models.reference_models(["RW", "Trend"]) == ["Trend"]


def test_coverage_notes(spark):
    board = spark.createDataFrame([("price", 1, "A", 3), ("price", 1, "B", 5), ("price", 5, "A", 5), ("price", 5, "B", 5)], "task string, h int, model string, n_series long")
    why = spark.createDataFrame([("price", 1, "A", {"invalid_context": 7}), ("price", 5, "A", {"invalid_context": 2})], "task string, h int, model string, reasons map<string,long>")
    r = one(evaluate.coverage_notes(board, why, "A"))
    assert (r.h, r.n_series, r.most_series, r.n_failures) == (1, 3, 5, 7)


def test_long_groups_get_more_lags(spark):
    rng = np.random.default_rng(9)
    d = rng.normal(size=3000)
    rows = spark.createDataFrame([("g", k, float(x), 0.0) for k, x in enumerate(d)], "k string, origin int, loss double, bench_loss double")
    got = one(inference.dm_statistic(rows, ["k"], 1))
    c = d - d.mean()
    lag = math.ceil(4 * 30 ** (2 / 9)) - 1
    v = (c @ c + 2 * sum((1 - j / (lag + 1)) * (c[j:] @ c[:-j]) for j in range(1, lag + 1))) / 3000
    assert got.lag == lag and got.statistic == pytest.approx(math.sqrt(2999 / 3000) * d.mean() / math.sqrt(v / 3000))
    with pytest.raises(Exception, match="more lags"):
        inference.dm_statistic(rows, ["k"], 1, max_lag=2).collect()


def test_build(spark, tmp_path):
    raw = tmp_path / "raw"
    for folder in ("daily", "intraday"):
        (raw / folder).mkdir(parents=True)
    (raw / "fx.csv").write_text("Date,USD\n2025-01-01,1.0\n2025-01-02,1.1\n")
    t0 = 1735689600
    day = [(t0 + 86400 * k, 1.0, 2.0, 1.5, 1.6, 12.0 + k) for k in range(2)]
    cols = "epoch long, low double, high double, open double, close double, volume double"
    spark.createDataFrame(day, cols).toPandas().to_parquet(raw / "daily/BTC-USD_86400.parquet")
    spark.createDataFrame([(t0 + 300 * i, 1.0, 2.0, 1.0, math.exp(0.001 * i), 1.0) for i in range(288)], cols).toPandas().to_parquet(raw / "intraday/BTC-USD_300.parquet")
    made = commands.build(spark, str(raw), str(tmp_path / "out"))
    got = {r.unique_id: r.n_obs for r in made["meta"].collect()}
    assert got == {"EURUSD": 2, "BTC-USD": 2, "VOL_BTC": 2, "RV_BTC": 1}
    assert [r.y for r in made["series"].where("unique_id = 'VOL_BTC'").orderBy("ds").collect()] == [12, 13]
    assert all(a["passed"] for a in commands.audits(made["series"], made["rv"], str(tmp_path / "audit")))


def test_cli(tmp_path):
    from tidemark.cli import main

    (tmp_path / "t.yaml").write_text("task: rv\nseries: [a]\nhorizons: [{h: 5, step: 5}]\nwindows: {main: ['2025-01-01', '2025-04-10']}\nprimary_benchmark: EWMA\n")
    assert main(["mde", "--task", str(tmp_path / "t.yaml"), "--window", "main", "--out", str(tmp_path)]) == 0
    assert (tmp_path / "mde.md").exists()
    with pytest.raises(SystemExit) as e:
        main(["run"])
    assert e.value.code == 2
    with pytest.raises(ValueError, match="primary_benchmark"):
        load_task({"task": "rv", "series": [], "horizons": [], "windows": {}})
