"""Streams: tumbling candles, recursive variance as keyed state, deduplication
and an idempotent sink."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A file stream over one table of a folder, with the table's schema."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(rows: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Repeats of a key within the watermark go."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def tumbling_candles(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """Hourly last value and count per event type; late rows up to ``late``
    still count."""
    hour = F.window("ts", "1 hour")
    return (
        rows.withWatermark("ts", late)
        .groupBy(hour, F.col("event_type").alias("unique_id"))
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("n"))
        .select("unique_id", F.col("window.start").cast("timestamp_ntz").alias("ts"), "close", "n")
    )


SEED, LAMBDA = 20, 0.94


def ewma_state(rows: DataFrame) -> DataFrame:
    """Per event type the recursive variance of ``value``, extended by each
    batch's rows in time order; the state is a level, a count and, until there
    are SEED rows, their squares."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, n, first = state.get if state.exists else (0.0, 0, [])
        first = list(first)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        squares = (rows["value"].dropna() ** 2).tolist()
        for x in squares:
            n += 1
            if n <= SEED:
                first.append(x)
                level = sum(first) / len(first)
                for y in first:
                    level = LAMBDA * level + (1 - LAMBDA) * y
            else:
                level = LAMBDA * level + (1 - LAMBDA) * x
        state.update((level, n, first if n < SEED else first[:SEED]))
        yield pd.DataFrame({"unique_id": [key[0]], "n": [n], "sigma2": [level]})

    return rows.groupBy("event_type").applyInPandasWithState(
        update, "unique_id string, n long, sigma2 double", "level double, n long, first array<double>", "update", GroupStateTimeout.NoTimeout
    )


#: Ratios that a key's sliding state holds.
HELD = 250


def ratio_state(rows: DataFrame, held: int = HELD) -> DataFrame:
    """Per event type the deciles of the last ``held`` ratios of consecutive
    positive values; older ratios leave the state as new ones come."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n, kept = state.get if state.exists else (None, 0, [])
        kept, rows = list(kept), pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for x in rows["value"].dropna().tolist():
            if last is not None and last > 0 and x > 0:
                kept.append(x / last)
                n += 1
            last = x
        kept = kept[-held:]
        state.update((last, n, kept))
        deciles = [float(q) for q in np.quantile(kept, [k / 10 for k in range(1, 10)])] if kept else [None] * 9
        yield pd.DataFrame([[key[0], n, *deciles]], columns=["unique_id", "n", *(f"q{10 * k}" for k in range(1, 10))])

    schema = "unique_id string, n long, " + ", ".join(f"q{10 * k} double" for k in range(1, 10))
    return rows.groupBy("event_type").applyInPandasWithState(update, schema, "last double, n long, kept array<double>", "update", GroupStateTimeout.NoTimeout)


def run_to_end(rows: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run a stream over what is there and return the last row of each key.

    Each batch overwrites its own folder, so a batch that is repeated after a
    failure leaves the same files; offsets are kept beside it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/number={number}")

    query = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    done = rows.sparkSession.read.parquet(f"{folder}/rows")
    last = done.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch").alias("r"))
    return last.select(*keys, "r.*")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which all executors
    must share; only a session in one process may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
