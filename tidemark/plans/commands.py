"""Composite commands: build panels, run a task, audit, report, effects."""

from __future__ import annotations

import datetime
import functools
import json
import math
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import adapter_group, is_special, overlap_design_effect, report_group, return_id
from ..functions.special import mde
from ..operators import audit, evaluate, inference, models, panel, windows
from ..sources import readers, store
from ..ship import ship
from .config import Task


def _have(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found) and len(found) > 0


def resolve_bonds(spark: SparkSession, raw: str) -> DataFrame | None:
    """Bonds from whichever of the two files is there, else from
    ``bonds.parquet`` (long), else nothing."""
    old, new = (f"{raw}/bonds_{x}.csv" for x in ("history", "current"))
    have = [p for p in (old, new) if _have(spark, p)]
    if len(have) == 2:
        return readers.read_bonds(spark, old, new)
    if have:
        return readers.read_bond_csv(spark, have[0])
    return spark.read.parquet(f"{raw}/bonds.parquet") if _have(spark, f"{raw}/bonds.parquet") else None


def resolve_index(spark: SparkSession, raw: str) -> DataFrame | None:
    """Index rows from ``index.parquet``, else from ``index.csv``."""
    if _have(spark, f"{raw}/index.parquet"):
        return spark.read.parquet(f"{raw}/index.parquet")
    return readers.read_index_csv(spark, f"{raw}/index.csv") if _have(spark, f"{raw}/index.csv") else None


def daily_returns(spark: SparkSession, raw: str) -> DataFrame:
    """Open-to-close log returns of the daily candles, by the file's product,
    and of the index."""
    parts = []
    if _have(spark, f"{raw}/daily/*.parquet"):
        product = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(_\d+)?\.parquet", 1)
        candles = spark.read.parquet(f"{raw}/daily/*.parquet").select(product.alias("unique_id"), F.to_date(F.timestamp_seconds("epoch")).alias("ds"), "open", "close")
        parts.append(panel.open_close_returns(candles))
    index = resolve_index(spark, raw)
    if index is not None:
        parts.append(panel.open_close_returns(index.withColumn("unique_id", F.lit("N225"))))
    if not parts:
        return spark.createDataFrame([], "unique_id string, ds date, ret double")
    return functools.reduce(lambda a, b: a.unionByName(b.select(*a.columns)), parts)


def build(spark: SparkSession, raw: str, out: str) -> dict[str, DataFrame]:
    """Raw files to three tables ``series``, ``rv`` and ``meta``; sources that
    aren't there are left out.

    Layout: ``fx.csv``, ``bonds_history.csv``, ``bonds_current.csv``,
    ``index.csv``, ``daily/<product>.parquet`` and ``intraday/<product>.parquet``
    with candles.
    """
    series, rvs = [], []
    if _have(spark, f"{raw}/fx.csv"):
        series.append(readers.read_fx_csv(spark, f"{raw}/fx.csv"))
    bonds = resolve_bonds(spark, raw)
    if bonds is not None:
        series.append(bonds)
    rows = resolve_index(spark, raw)
    if rows is not None:
        series.append(rows.select(F.lit("N225").alias("unique_id"), "ds", F.col("close").alias("y")))
        gk = panel.gk_daily(rows.withColumn("unique_id", F.lit("RV_N225_GK")))
        rvs.append(gk.select("*", F.lit(None).cast("double").alias("m_intervals"), F.lit(None).cast("string").alias("reason")))
    product = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(_\d+)?\.parquet", 1)
    if _have(spark, f"{raw}/daily/*.parquet"):
        daily = spark.read.parquet(f"{raw}/daily").withColumn("product", product)
        last = daily.groupBy("product", F.to_date(F.timestamp_seconds("epoch")).alias("ds")).agg(F.max_by(F.struct("close", "volume"), "epoch").alias("r"))
        series.append(last.select(F.col("product").alias("unique_id"), "ds", F.col("r.close").alias("y")))
        series.append(last.select(F.concat(F.lit("VOL_"), F.split("product", "-")[0]).alias("unique_id"), "ds", F.col("r.volume").alias("y")))
    if _have(spark, f"{raw}/intraday/*.parquet"):
        five = spark.read.parquet(f"{raw}/intraday").withColumn("product", product)
        candles = five.select(F.concat(F.lit("RV_"), F.split("product", "-")[0]).alias("unique_id"), F.timestamp_seconds("epoch").alias("ts"), "close").distinct()
        rvs.append(panel.realized_variance(candles, 288))
    both = {}
    for name, parts in (("series", series), ("rv", rvs)):
        if parts:
            df = parts[0]
            for more in parts[1:]:
                df = df.unionByName(more)
            df.write.mode("overwrite").parquet(f"{out}/{name}")
            both[name] = spark.read.parquet(f"{out}/{name}")
            if not panel.broken_invariants(both[name]).isEmpty():
                raise ValueError(f"{name} has a day twice")
    long = [both["series"]] if "series" in both else []
    if "rv" in both:
        long.append(both["rv"].select("unique_id", "ds", F.col("rv").alias("y")))
    meta = long[0] if len(long) == 1 else long[0].unionByName(long[1])
    panel.series_meta(meta).write.mode("overwrite").parquet(f"{out}/meta")
    return {**both, "meta": spark.read.parquet(f"{out}/meta")}


def predictions(model: str, rows: DataFrame, cells: DataFrame, task: Task, returns: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """A model's forecasts; series by series group where their estimation
    windows differ."""
    horizons, goal, again = [x.h for x in task.horizons], task.targets, task.refit_every
    if model == "BoostedTrees":  # one model over all series
        return functools.reduce(DataFrame.unionByName, [models.boosted_refits(rows, cells, h, again) for h in horizons])
    group = adapter_group("unique_id")
    sizes = {} if task.estimation == "expanding" else dict(task.estimation_windows)
    parts = [(n, group == g) for g, n in sizes.items()] + [(None, ~group.isin(*sizes) if sizes else F.lit(True))]
    out = None
    for n, own in parts:
        mine, asked = rows.where(own), cells.where(own)
        ret = returns.where(own) if returns is not None else None
        wide = n or (10**6 if task.estimation == "expanding" else models.ESTIMATION)
        made = {
            "RW": lambda: models.random_walk(mine, asked, horizons, wide),
            "NaivePrev": lambda: models.naive_prev(mine, asked, horizons, wide),
            "SeasonalNaive7": lambda: models.seasonal(mine, asked, 1),
            "SeasonalMedian4": lambda: models.seasonal(mine, asked, 4),
            "EWMA": lambda: models.ewma(mine, ret, asked, wide, horizons, goal),
            "HAR-RV": lambda: models.har(mine, asked, n, goal, refit=again),
            "DVOL": lambda: models.dvol(mine, index, asked, n, goal, refit=again),
            "GARCH": lambda: models.garch(ret, asked, n=n or 10**6, rv=mine, targets=goal, refit=again),
            "GJR-GARCH": lambda: models.garch(ret, asked, asymmetric=True, n=n or 10**6, rv=mine, targets=goal, refit=again),
            "AutoETS": lambda: models.ets(mine, asked, refit=again),
            "AutoTheta": lambda: models.theta(mine, asked, refit=again),
            "Trend": lambda: models.trend_reference(mine, asked, refit=again),
            "External": lambda: models.external(mine, asked, models.stub_backend, task.context, refit=again),
        }[model]()
        out = made if out is None else out.unionByName(made)
    return out


def run(
    spark: SparkSession, task: Task, window: str, rows: DataFrame, base: str, names: list[str] | None = None, returns: DataFrame | None = None,
    index: DataFrame | None = None, dry: bool = False,
) -> dict:
    """Forecast every pending origin of a task's window into the store; the
    manifest, beside it, says how many rows each model should have.

    ``returns`` (``unique_id, ds, ret``) and the volatility ``index``
    (``unique_id, ds, x``) may have the names of assets; a model that needs one
    and hasn't got it raises.  A model's cells are those of the series that it
    supports.
    """
    ship(spark)
    names = models.resolve_models(task.task, names or list(task.models) or None)
    if task.series:
        rows = rows.where(F.col("unique_id").isin(list(task.series)))
    if task.transform == "log1p":
        rows = rows.withColumn("y", F.log1p("y"))
    ids = rows.select("unique_id").distinct()
    if returns is not None:
        by = ids.select("unique_id", return_id("unique_id").alias("_asset"))
        own = returns.join(ids, "unique_id", "left_semi")
        other = returns.withColumnRenamed("unique_id", "_asset").join(by.where("unique_id <> _asset"), "_asset").select(*returns.columns)
        returns = own.unionByName(other.join(own.select("unique_id").distinct(), "unique_id", "left_anti"))
    if index is not None:
        index = index.withColumn("unique_id", F.regexp_replace("unique_id", "^DVOL_", "RV_"))
    for name, needed in (("EWMA", returns), ("GARCH", returns), ("GJR-GARCH", returns), ("DVOL", index)):
        if name in names and needed is None:
            raise ValueError(f"{name} needs {'an index' if name == 'DVOL' else 'returns'}; name the models to run without it")
    cells = windows.origin_schedule(rows, *task.windows[window], [(x.h, x.step) for x in task.horizons])
    run_id = f"{task.task}-{window}-{store.fingerprint([task, names])}"
    own_cells = {m: cells.where(models.supports(m)) for m in names}
    expected = {m: c.count() for m, c in own_cells.items()}
    if dry:
        return {"run_id": run_id, "expected": expected}
    write_manifest(base, run_id, expected, task=task.task, window=window)
    _write(f"{base}/_runs/config_{run_id}.json", json.dumps({"run_id": run_id, "models": {m: {"reference": bool(models.reference_models([m])), "estimation": task.estimation, "refit_every": task.refit_every} for m in names}}, indent=1))
    facts = store.ForecastStore(spark, base)
    for name in names:
        todo = own_cells[name]
        if facts.exists():
            done = facts.read().where((F.col("run_id") == run_id) & (F.col("model") == name))
            todo = todo.join(store.pending(todo, done), "origin", "left_semi")
        made = predictions(name, rows, todo, task, returns, index).checkpoint()
        if not evaluate.label_mismatch(todo, made).isEmpty():
            raise ValueError(f"{name} has other labels than its schedule")
        made = made.select(F.lit(task.task).alias("task"), F.lit(run_id).alias("run_id"), F.lit(name).alias("model"), "*")
        facts.write(made)
    counts = spark.createDataFrame(list(expected.items()), "model string, expected long")
    checked = store.manifest(counts, facts.read(check=True).where(F.col("run_id") == run_id)).collect()
    return {"run_id": run_id, "models": {r.model: {"expected": r.expected, "actual": r.actual, "match": r.match} for r in checked}}


def write_manifest(base: str, run_id: str, expected: dict[str, int], **more) -> str:
    """Expected rows of a run, once: a run that resumes must expect the same."""
    path = f"{base}/_runs/manifest_{run_id}.json"
    old = _read(path)
    if old is not None:
        if json.loads(old)["expected_rows"] != expected:
            raise ValueError("the run that resumes expects other rows")
        return path
    now = datetime.datetime.now(datetime.timezone.utc).isoformat()
    _write(path, json.dumps({"run_id": run_id, "expected_rows": expected, "created_at": now, **more}, indent=1))
    return path


def expected_rows(base: str, run_id: str) -> dict[str, int] | None:
    text = _read(f"{base}/_runs/manifest_{run_id}.json")
    return json.loads(text)["expected_rows"] if text else None


def resolve_run(base: str, task: str, window: str, run_id: str | None = None) -> str:
    """A run that was asked for, if it is of that task and window; else the one
    whose manifest is newest."""
    found = []
    for text in _texts(f"{base}/_runs", "manifest_"):
        try:
            m = json.loads(text)
        except json.JSONDecodeError:
            continue
        if run_id is not None and m.get("run_id") == run_id and (m.get("task"), m.get("window")) != (task, window):
            raise ValueError(f"{run_id} is a run of {m.get('task')}, {m.get('window')}")
        if (m.get("task"), m.get("window")) == (task, window):
            found.append((m.get("created_at", ""), m["run_id"]))
    if run_id is not None:
        return run_id
    if not found:
        raise FileNotFoundError(f"no run of {task}, {window}")
    return max(found)[1]


def clean(x):
    """JSON values: NaN and infinities become null."""
    if isinstance(x, dict):
        return {str(k): clean(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [clean(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if isinstance(x, (int, float, str, bool, type(None))) else str(x)


def _fs(path: str):
    spark = SparkSession.getActiveSession()
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, spark._jvm


def _write(path: str | Path, text: str) -> None:
    """A small file, there only once it is whole."""
    if ":" in str(path):
        fs, p, jvm = _fs(str(path))
        part = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        fs.delete(p, False)
        fs.rename(part, p)
        return
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(path.suffix + ".tmp")
    with part.open("w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    part.replace(path)


def _read(path: str) -> str | None:
    if ":" in path:
        fs, p, jvm = _fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text
    return Path(path).read_text() if Path(path).exists() else None


def _texts(folder: str, start: str) -> list[str]:
    if ":" in folder:
        fs, p, _ = _fs(folder)
        names = [f.getPath().toString() for f in fs.listStatus(p)] if fs.exists(p) else []
    else:
        names = [str(f) for f in Path(folder).iterdir()] if Path(folder).exists() else []
    return [_read(n) or "" for n in sorted(names) if n.rsplit("/", 1)[-1].startswith(start) and n.endswith(".json")]


def _table(rows: list[dict]) -> str:
    if not rows:
        return "(none)\n"
    fmt = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    names = list(rows[0])
    body = ["| " + " | ".join(fmt(r[n]) for n in names) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *body]) + "\n"


def report(facts: DataFrame, rows: DataFrame, task: Task, out: str | None = None, expected: dict[str, int] | None = None) -> dict[str, list[dict]]:
    """All tables of a run, as small lists; written as JSON and Markdown.

    Reference models have boards of their own; special series are left out of
    the main ones and listed apart.
    """
    rv = task.task == "rv"
    block = any(x.target == "sum" for x in task.horizons)
    every = evaluate.evaluated(facts, rows, rv, block).checkpoint()
    names = sorted(r.model for r in every.select("model").distinct().collect())
    aside = models.reference_models(names)
    bench, keys, by = task.primary_benchmark, ["task", "h"], ["task", "h", "model"]
    if bench in aside:
        raise ValueError("the benchmark can't be a reference model")
    ev = every.where(~is_special("unique_id") & ~F.col("model").isin(aside) if aside else ~is_special("unique_id"))
    pairs = evaluate.paired_losses(ev, bench).checkpoint()
    others = pairs.where(F.col("model") != bench)
    primary = inference.primary_test(evaluate.series_ratios(others), by)
    group = report_group("unique_id")
    classed = others.withColumn("grp", group)
    board = evaluate.leaderboard(ev, bench)
    reasons = evaluate.reason_counts(ev)
    low, step = F.col("actual") < F.col("q10"), {x.h: x.step for x in task.horizons}
    main = [n for n in names if n not in aside]
    rates = classed.where(F.col("grp") == "rates")
    moves = ev.where(~F.col("evaluation_fail")).withColumn("grp", group)
    parts = {
        "leaderboard": board.orderBy("h", "model"),
        "fail_reasons": reasons.select(*by, F.map_entries("reasons").cast("string").alias("reasons")).orderBy("h", "model"),
        "coverage_notes": functools.reduce(DataFrame.unionByName, [evaluate.coverage_notes(board, reasons, m) for m in main]),
        "primary": inference.holm(primary, ["task", "model"], "sign_p", "h").orderBy("h", "model"),
        "coverage": evaluate.coverage(ev, by).orderBy("h", "model"),
        "coverage_by_tercile": evaluate.coverage_by_tercile(ev, by).orderBy("h", "model", "tercile"),
        "calibration_curve": evaluate.calibration_curve(ev, by).orderBy("h", "model", "nominal"),
        "wql": evaluate.wql(ev, by).orderBy("h", "model"),
        "halves": evaluate.half_split(ev, bench).orderBy("h", "half", "model"),
        "groups": evaluate.group_breakdown(ev, bench, group).orderBy("h", "grp", "model"),
        "special_series": evaluate.series_ratios(evaluate.paired_losses(every.where(is_special("unique_id")), bench)).orderBy("h", "model", "unique_id"),
        "loss_differences": evaluate.loss_difference(ev, bench).where(F.col("model") != bench).orderBy("h", "model", "origin"),
        "kupiec": inference.kupiec(ev, [*by, "unique_id"], low, 0.1).orderBy("h", "model", "unique_id"),
        "christoffersen": inference.christoffersen_test(ev, [*by, "unique_id"], low, 0.1).orderBy("h", "model", "unique_id"),
        "tost": inference.tost_rel_mae(classed.where(F.col("grp") != "rates"), [*by, "grp"]).orderBy("h", "model", "grp"),
        "directions": inference.pt_test(moves, [*by, "grp"], F.col("actual") - F.col("origin_actual"), F.col("yhat") - F.col("origin_actual")).orderBy("h", "model", "grp"),
    }
    if aside:
        shown = every.where(F.col("model").isin([*aside, bench]))
        parts["reference"] = evaluate.leaderboard(shown, bench).orderBy("h", "model")
    if "runtime_s" in facts.columns:
        parts["runtime"] = evaluate.runtime(ev).orderBy("h", "model")
    if expected:
        counts = facts.sparkSession.createDataFrame(list(expected.items()), "model string, expected long")
        parts["manifest"] = store.manifest(counts, facts).orderBy("model")
    tables = {name: [clean(r.asDict()) for r in df.collect()] for name, df in parts.items()}
    # Tests whose small-sample factor and models depend on the horizon.
    tables["diebold_mariano"], tables["mcs"] = [], []
    for x in task.horizons:
        mine = rates.where(F.col("h") == x.h)
        tests = inference.dm_test(mine, [*by, "unique_id"], max(1, math.ceil(x.h / step[x.h]))).orderBy("model", "unique_id")
        tables["diebold_mariano"] += [clean(r.asDict()) for r in tests.collect()]
        at = ev.where(F.col("h") == x.h)
        full = sorted(r.model for r in evaluate.mcs_gate(at, rows).where("covered").collect())
        if len(full) > 1:
            tables["mcs"] += [{"h": x.h, **clean(r.asDict())} for r in inference.mcs(evaluate.mcs_matrix(at, full), full).collect()]
    if out:
        _write(f"{out}/summary.json", json.dumps({"schema_version": 1, **tables}, indent=1))
        _write(f"{out}/summary.md", "\n".join(f"## {n}\n\n{_table(t)}" for n, t in tables.items()))
    return tables


def audits(series: DataFrame | None, rv: DataFrame | None, out: str | None = None, ohlc: DataFrame | None = None, candles: DataFrame | None = None, pages: DataFrame | None = None, first: str | None = None) -> list[dict]:
    """One record for each audit of what is there; the caller exits with 1 on a
    violation.  ``ohlc``: daily index rows; ``candles``: ``product, epoch`` on a
    grid of five minutes; ``pages``: fetched pages with their overlaps;
    ``first``: the day on which all bonds begin."""
    found = []

    def add(name: str, violations: int, **more) -> None:
        found.append({"name": name, "passed": not violations, "violation_count": int(violations), **more})

    if series is not None:
        zero = audit.audit_zero_null(series.where(F.col("unique_id").startswith("EUR"))).agg(F.sum("n_zero").alias("v"), F.max("null_rate").alias("r")).first()
        add("fx", (zero.v or 0) + int((zero.r or 0) > 0))
        add("unique_days", panel.broken_invariants(series).count())
        bonds = series.where(F.col("unique_id").startswith("JGB_"))
        if not bonds.isEmpty():
            days = audit.audit_dates(bonds, first or str(bonds.agg(F.min("ds")).first()[0])).first()
            add("bond_days", days.late_series + days.not_increasing + days.weekend_rows, n_rows=days.n_rows)
    if rv is not None:
        add("rv", audit.audit_rv(rv).where("NOT passed").count())
    if ohlc is not None:
        bad = audit.audit_ohlc(ohlc).first()
        add("ohlc", bad.violation_count, n_rows=bad.n_rows)
    if candles is not None:
        grid = audit.audit_grid(candles, "product", "epoch", 300)
        add("grid", grid.where("NOT passed").count(), products=[clean(r.asDict()) for r in grid.orderBy(grid.columns[0]).collect()])
    if pages is not None:
        overlaps = audit.page_overlaps(pages).first()
        add("pages", overlaps[1], n_overlaps=overlaps[0])
    if out:
        _write(f"{out}/audit.json", json.dumps(found, indent=1))
        _write(f"{out}/audit.txt", "".join(f"{'ok  ' if a['passed'] else 'FAIL'} {a['name']}: {a['violation_count']}\n" for a in found))
    return found


def effects(task: Task, window: str, out: str | None = None) -> list[dict]:
    """What each horizon of a task can detect, by the calendar alone."""
    import datetime as dt

    a, b = (dt.date.fromisoformat(x) for x in task.windows[window])
    days, rows = (b - a).days + 1, []
    for x in task.horizons:
        n = max(0, (days - x.h) // x.step + 1)
        deff = overlap_design_effect(x.h, x.step)
        rows.append({"task": task.task, "h": x.h, "step": x.step, "n_origins": n, "design_effect": deff, "mde_sd": mde(n, deff) if n else None})
    if out:
        _write(f"{out}/mde.json", json.dumps(clean(rows), indent=1))
        _write(f"{out}/mde.md", _table(rows))
    return rows
