"""A large family must not hide lost pairs from the audit."""

import numpy as np

from tidemark.llm import common, embedding_graph


def test_lost_pairs_count_as_much_as_a_hot_family(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=32)
    hot = centre + 0.02 * rng.normal(size=(300, 32))
    one = rng.normal(size=(60, 32))
    v = np.concatenate([hot, one, one + 0.02 * rng.normal(size=(60, 32))])
    df = spark.createDataFrame([(i, [float(x) for x in e], 1) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int")
    real, overlaps = embedding_graph.search_shards, []

    def lossy(*args):
        """At the first try every pair but those of the family is lost."""
        found, kind = real(*args), len(overlaps)
        overlaps.append([a for a in args if isinstance(a, int)][0])
        if kind:
            return found
        from pyspark.sql import functions as F

        return found.where(F.col("rid").isNull() | (F.col("links") > 100))

    monkeypatch.setattr(embedding_graph, "search_shards", lossy)
    got = {r.id: r.n_links for r in embedding_graph.embedding_near_duplicates(df, common.Scratch(spark, "test")).collect()}
    assert len(overlaps) == 2 and all(got[i] == 1 for i in range(300, 420))


def test_enough():
    assert embedding_graph.enough([]) and embedding_graph.enough([(0, 0.9, 40), (8, 1.0, 40)])
    assert not embedding_graph.enough([(0, 0.8, 40), (8, 1.0, 4000)])
    assert not embedding_graph.enough([(0, 0.8, 10)])
