"""The search's memory is bounded by a few queries, and it gives the
similarities of the nodes it opens."""

import numpy as np

from tidemark.llm import embedding_graph


def test_queries_go_in_parts(monkeypatch):
    v = np.random.default_rng(41).normal(size=(300, 16))
    v[100:] = v[:200] + 0.1 * v[100:]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    edge, medoid = embedding_graph.build(v, 1)
    start = np.eye(300, dtype=bool)
    start[:, medoid] = True
    whole = embedding_graph.search(v, v, edge, start, 0.93)
    monkeypatch.setattr(embedding_graph, "QUERIES", 7)
    monkeypatch.setattr(embedding_graph, "OPENED", 64)
    assert np.array_equal(embedding_graph.search(v, v, edge, start, 0.93), whole)
    near = v @ v.T >= 0.93
    assert (near <= (whole >= 0.93 - 1e-12)).mean() > 0.99 and (whole == -9).any()
    assert np.allclose(whole[whole > -9], (v @ v.T)[whole > -9])
