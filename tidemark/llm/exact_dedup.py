"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the text.  A batch
is reduced to one row per digest, anti-joined with the index by sort-merge, and
appended: what is new with the row that stays, what isn't with its count.  DataFrame operations only.

Defined cases: a null text counts as empty; empty texts are equal to each
other.  Of equal texts in the batch that first brings them, the row with the
largest id stays; a null id is smaller than any other, and of rows repeated
with the same id exactly one stays.  An empty batch gives an empty result.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, Scratch, join_per_key


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes; null as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class DigestIndex:
    """A persistent table ``(digest, first, keep_id, keep_tag, copies)``,
    bucketed and sorted by ``digest``.

    Every batch appends a row for each of its digests: ``first`` where the
    digest is new, with the row that stays; ``copies`` are those of the batch.
    ``buckets`` defaults to the session's shuffle partitions; a join with the
    index and the sums over a digest's rows shuffle only the new batch.
    Without a name the table is for one use: ``forget`` takes it out of the
    catalog.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            self._write(spark.createDataFrame([], "digest binary, first boolean, keep_id long, keep_tag long, copies long"))

    def _write(self, rows: DataFrame) -> None:
        writer = (
            rows.repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
        )
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        """``digest, keep_id, copies``: a row for each digest."""
        rows = self.spark.read.table(self.name).groupBy("digest")
        return rows.agg(F.max(F.struct("first", "keep_id")).getField("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))

    def compacted(self, name: str, path: str | None = None) -> DigestIndex:
        """A new index with the rows of this one, a sorted file to each bucket
        and a row to each digest, after many batches."""
        new = DigestIndex(self.spark, name, path, self.buckets)
        new._write(self.table().select("digest", F.lit(True).alias("first"), "keep_id", F.lit(None).cast("long").alias("keep_tag"), "copies"))
        return new

    def ingest(self, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; return one row per row of it: ``id, tag, digest,
        keep_id, copies, kept``.  ``tag`` tells repeated rows apart; ``copies``
        counts the rows of all batches so far."""
        rows = scratch.keep(
            docs.select(
                F.col(id_col).cast("long").alias("id"),
                F.monotonically_increasing_id().alias("tag"),
                text_digest(F.col(text_col)).alias("digest"),
            ),
            "digests",
        )
        groups = scratch.keep(
            rows.groupBy("digest").agg(F.max(F.struct("id", "tag")).alias("top"), F.count(F.lit(1)).alias("n")), "groups"
        )
        old = groups.join(self.table().hint("merge"), "digest").select("digest", "n", F.col("keep_id"), F.lit(None).cast("long").alias("keep_tag"), (F.col("copies") + F.col("n")).alias("copies"))
        new = groups.join(self.table().hint("merge"), "digest", "left_anti").select("digest", "n", F.col("top.id").alias("keep_id"), F.col("top.tag").alias("keep_tag"), F.col("n").alias("copies"))
        labels = scratch.keep(old.unionByName(new), "labels")
        first = F.col("keep_tag").isNotNull()
        self._write(labels.select("digest", first.alias("first"), F.when(first, F.col("keep_id")).alias("keep_id"), "keep_tag", F.col("n").alias("copies")))
        return join_per_key(rows, labels, "digest", "n").select(
            "id", "tag", "digest", "keep_id", "copies", F.coalesce(F.col("tag") == F.col("keep_tag"), F.lit(False)).alias("kept")
        )


def keep_first_of_equal(docs: DataFrame, index: DigestIndex, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the index didn't have yet:
    of equal texts the row with the largest id.

    Texts of heavy groups are filtered where they are read, by a broadcast of
    at most ``1 / HEAVY_SHARE`` groups; the others are shuffled once.
    """
    marked = index.ingest(docs, scratch, id_col, text_col)
    total = scratch.spark.read.parquet(scratch.path("digests")).count()
    kept = scratch.keep(marked.where("kept").select("digest", F.col("id").alias("keep_id"), "copies"), "kept")
    few = kept.where(F.col("copies") > total * HEAVY_SHARE).select(F.col("digest").alias("heavy"), F.col("keep_id").alias("heavy_id"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("mine"))
    rows = rows.join(F.broadcast(few), F.col("mine") == F.col("heavy"), "left").where(
        F.col("heavy").isNull() | F.col("id").eqNullSafe(F.col("heavy_id"))
    )
    # Written as one expression, so that the digest alone is the join key and the
    # last step finds its rows together.
    none = F.lit(-(2**63))
    same_id = F.coalesce("id", none).bitwiseXOR(F.coalesce("keep_id", none)) == 0
    met = rows.join(kept.select("digest", "keep_id").hint("merge"), (F.col("mine") == F.col("digest")) & same_id, "left_semi")
    return met.dropDuplicates(["mine"]).select("row.*")
