"""The corpus pipeline: documents through five stages.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next stage's documents.  The classifier's fit, the search for
near duplicates and passages, and the tokens have no form in SQL, so
``ORACLE_SQL`` is None; the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, packing, quality, simhash, substring
from tidemark.llm.common import Scratch
from tidemark.llm.queries import table, tokenizer_path

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.  Null and empty texts have
    a score like any other; repeated rows share one; an empty table stays so."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the row with the largest id; a null id is
    smaller than any; of rows repeated under one id exactly one."""
    scratch = Scratch(spark, "stage-exact")
    index = exact_dedup.DigestIndex(spark, path=scratch.path("index"))
    kept = exact_dedup.keep_first_of_equal(docs, index, scratch)
    index.forget()
    return kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate groups the document with the smallest id; rows without
    an id stay; rows with one id are one document."""
    return simhash.keep_one_of_each_group(docs, Scratch(spark, "stage-near"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in the smallest id that has them; documents of
    which no word is left go, others without a passage are as they were."""
    return substring.cut_passages(docs, Scratch(spark, "stage-substring"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece; an empty text is its separator."""
    packed = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), Scratch(spark, "stage-packing"))
    return packed.withColumnRenamed("id", "doc_id").drop("tag")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Each stage's tables go once its result is stored,
    and that result once the next one is."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = list(Scratch.made)
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        for used in [x for x in Scratch.made if x not in before]:
            used.sweep()
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
