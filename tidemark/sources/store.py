"""The forecast store: partitioned Parquet, replaced partition by partition.

Facts lie under ``task / run_id / model / origin_month``.  Writing a chunk
replaces the origins it has within their months by dynamic partition
overwrite, so a repeated or resumed write gives the same store.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PARTITION = ["task", "run_id", "model", "origin_month"]
UNIQUE = ["task", "run_id", "model", "unique_id", "origin", "h", "ds_target"]


def fingerprint(payload: object) -> str:
    """Twelve hexadecimal digits of the SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()[:12]


def panel_fingerprint(panel: DataFrame) -> DataFrame:
    """Per series: rows, range and a SHA-256 over days and values in order."""
    rows = F.array_sort(F.collect_list(F.struct("ds", F.col("y"))))
    text = F.concat_ws(";", F.transform("r", lambda x: F.concat_ws("=", x["ds"].cast("string"), F.hex(F.encode(x["y"].cast("string"), "utf-8")))))
    g = panel.groupBy("unique_id").agg(rows.alias("r"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n"))
    return g.select("unique_id", "first_ds", "last_ds", "n", F.sha2(text, 256).alias("sha256"))


class ForecastStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def read(self, check: bool = False) -> DataFrame:
        """All facts; with ``check`` a repeated key raises."""
        facts = self.spark.read.parquet(self.base)
        if check and not key_collisions(facts).isEmpty():
            raise ValueError("the store has repeated keys")
        return facts

    def exists(self) -> bool:
        try:
            self.spark.read.parquet(self.base).schema
            return True
        except AnalysisException:
            return False

    def write(self, facts: DataFrame) -> None:
        """Upsert by origin: months that the chunk touches are rewritten from
        what they had of other origins and the chunk."""
        facts = facts.withColumn("origin_month", F.date_format("origin", "yyyy-MM"))
        if self.exists():
            # Fits run once, however often the chunk is read below.
            facts = facts.checkpoint()
            old = self.read().withColumn("origin_month", F.col("origin_month").cast("string"))
            months, mine = facts.select(*PARTITION).distinct(), facts.select(*PARTITION[:3], "origin").distinct()
            kept = old.join(months, PARTITION, "left_semi").join(mine, [*PARTITION[:3], "origin"], "left_anti")
            # The rows kept are read from the partitions that get overwritten.
            kept = kept.select(*facts.columns).checkpoint()
            facts = facts.unionByName(kept)
        facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(self.base)


def key_collisions(facts: DataFrame, keys: list[str] = UNIQUE) -> DataFrame:
    return facts.groupBy(*[k for k in keys if k in facts.columns]).count().where("count > 1")


def pending(cells: DataFrame, done: DataFrame, keys: list[str] = ["unique_id", "origin", "h"]) -> DataFrame:
    """Origins still to run: those of which any cell is missing."""
    return cells.join(done.select(*keys), keys, "left_anti").select("origin").distinct()


def manifest(expected: DataFrame, facts: DataFrame) -> DataFrame:
    """Expected and actual rows of each model, and whether they agree."""
    have = facts.groupBy("model").agg(F.count(F.lit(1)).alias("actual"))
    both = expected.join(have, "model", "full_outer")
    return both.select("model", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("match"))
