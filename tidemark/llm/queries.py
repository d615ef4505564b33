"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import chat, licenses, quality
from .bpe import round_trip
from .common import Scratch
from .embedding_graph import embedding_near_duplicates
from .exact_dedup import DigestIndex
from .packing import pack
from .simhash import simhash_classes
from .substring import near_duplicate_passages
from .warc import read_archives, write_archives


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op2"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op5")
    folder = scratch.path("archives")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder, scratch), folder)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), Scratch(spark, "op6"))
    return packed.withColumnRenamed("id", "doc_id").drop("tag")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op7")
    index = DigestIndex(spark, path=scratch.path("index"))
    marked = index.ingest(table(spark, sf_dir, "documents"), scratch)
    index.forget()
    return marked.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("copies").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_passages(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return found.withColumnRenamed("id", "doc_id").withColumnRenamed("other", "other_doc_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_rotation,
        op2_embedding_near_dedup,
        op3_quality_classifier,
        op4_bpe_round_trip,
        op5_warc,
        op6_packing,
        op7_exact_dedup,
        op8_license_scan,
        op9_substring_dedup,
        op10_simhash_near_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op1_chat_rotation": chat.ORACLE,
    "op8_license_scan": licenses.oracle(),
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
              ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(vec_id, root) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.vec_id),
        top AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
        deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT t.vec_id, coalesce(deg.n, 0) AS n_links, t.component_id, t.vec_id = t.component_id AS kept
        FROM top t LEFT JOIN deg ON deg.a = t.vec_id""",
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, b, unhex(sha1(b))::BIT::VARCHAR AS bits,
                     max(page_id) OVER (PARTITION BY b) AS last FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
                     + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT
                     + substr(bits, 5 * i + 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
        FROM d""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW w AS (PARTITION BY t)""",
}
