"""What the operators of this subpackage share: tables in the shared folder,
joins that survive hot keys, and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: A key counts as heavy when it holds more than this fraction of all rows, so
#: at most 1 / HEAVY_SHARE keys are heavy and a table of them may be broadcast.
HEAVY_SHARE = 1 / 1000


#: Rows of an Arrow batch where the session has Spark's own 10,000: whole texts
#: of that many rows, with what is made of them, are too much for a worker.
ARROW_ROWS = 2000


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, ``spark.checkpoint.dir``.  Only a
    session whose executors are threads of the driver may do without: it gets a
    fresh temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of up to about ``size`` bytes of text (column ``text``)."""
    sizes = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(batch.column("text")).cast(pa.float64()))))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size)))
        yield batch.slice(at, end - at)
        at = end


#: By their owner's name, what empties the caches that a worker keeps from task
#: to task.
HELD: dict[str, Callable[[], None]] = {}


def tidy(run, owner: str = ""):
    """A partition function that gives its worker's free memory back at the
    end, and at the start what other stages' functions had kept: workers live
    on, beside those of other stages."""

    def tidied(batches):
        for name in [x for x in HELD if x != owner]:
            HELD.pop(name)()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass

    return tidied


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores as long as ``df`` has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


class Scratch:
    """Parquet tables of one run of an operator, below the shared folder.

    ``keep`` cuts the lineage: later stages read files that outlive any
    executor.  ``drop`` deletes a table that nothing reads any more; what the
    returned DataFrame reads stays until ``sweep``, for whoever stores that
    result to call.  ``made`` lists all that were not swept yet.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        self.spark, self.names = spark, []
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def keep_by(self, df: DataFrame, table: str, key: str) -> DataFrame:
        """``keep``, bucketed and sorted by ``key``: joins by it shuffle and
        sort the other side only.  The catalog has the table until ``forget``."""
        n, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"scratch_{uuid.uuid4().hex}"
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", self.path(table)).format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.read.table(name)

    def forget(self) -> None:
        while self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop()}")

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(self.path(table))

    def sweep(self) -> None:
        self.forget()
        self._delete(self.root)
        Scratch.made.remove(self)


def join_per_key(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with what is known of their key, whatever the skew.

    ``right`` has one row per ``key`` and in ``size`` the number of ``left``
    rows with that key.  Keys above ``HEAVY_SHARE`` of all rows are at most
    ``1 / HEAVY_SHARE`` many, whatever the input's size; they are broadcast and
    their rows never shuffled.  All other rows meet in a shuffled join.  Both
    inputs are read twice, so they should be stored tables.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) > total * HEAVY_SHARE
    few, rest = right.where(heavy), right.where(~heavy)
    hot = left.join(F.broadcast(few), key)
    cold = left.join(F.broadcast(few.select(key)), key, "left_anti").join(rest.hint("merge"), key)
    return hot.unionByName(cold)


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of an undirected graph by alternating large and small stars.

    ``links`` has long columns ``a`` and ``b``.  Returns ``node`` and
    ``component`` (the component's smallest node) for every node that has a
    link to another; empty for no links.  Each round aggregates before it
    shuffles and joins hubs by broadcast of at most a thousand keys; nodes and
    links stay in tables.
    """

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = scratch.keep(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "cc-0",
    )
    before, turn = mark(edges), 0
    while before[0]:
        turn += 1
        both = scratch.keep(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-both")
        least = scratch.keep(
            both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "cc-least"
        )
        large = scratch.keep(
            join_per_key(both, least, "u", "n")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(),
            "cc-large",
        )
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-least2")
        joined = join_per_key(large, least, "u", "n")
        small = (
            joined.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        edges = scratch.keep(small, f"cc-{turn}")
        scratch.drop(f"cc-{turn - 1}", "cc-both", "cc-least", "cc-large", "cc-least2")
        after = mark(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
