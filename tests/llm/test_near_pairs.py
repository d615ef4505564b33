"""Families whose members are within reach but less similar make few pairs."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import common, simhash


def family(rng, many):
    """Texts with up to two edited words; and half as many with one of 20
    passages instead of a quarter, so with few shingles of their own."""
    base = [f"w{x}" for x in rng.integers(0, 50_000, 400)]
    passages = [[f"p{x}" for x in rng.integers(0, 50_000, 100)] for _ in range(20)]
    texts = []
    for k in range(many):
        words = list(base)
        for at in rng.integers(0, 400, 2).tolist():
            words[at] = f"m{k}x{at}"
        texts.append(words)
    for k in range(many // 2):
        at = int(rng.integers(0, 300))
        texts.append(base[:at] + passages[k % 20] + base[at + 100 :])
    return [" ".join(w) for w in texts]


def sets_of(texts):
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]


def test_pairs_that_cannot_be_similar_are_not_made(spark, monkeypatch):
    texts, verified, real = family(np.random.default_rng(33), 120), [], simhash.similar_pairs

    def counted(pairs, sets, similarity):
        verified.append(pairs.count())
        return real(pairs, sets, similarity)

    monkeypatch.setattr(simhash, "similar_pairs", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.node: r.component for r in simhash.near_duplicates(df, common.Scratch(spark, "test")).collect()}
    assert sum(verified[1:]) <= len(texts)
    sets, comp = sets_of(texts), list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert [got.get(i, i) for i in range(len(texts))] == comp


def test_parities_never_differ_more_than_the_sets(spark):
    rng = np.random.default_rng(34)
    rows = []
    for n, m, both in [(0, 0, 0), (1, 1, 1), (444, 444, 400), (500, 520, 460), (60, 70, 58), (64, 65, 64), (5000, 3000, 2900), (3, 900, 2), (0, 40, 0)]:
        h = np.unique(rng.integers(0, 2**63, n + m + 9, np.uint64))[: n + m - both]
        x, y = h[:n], h[n - both :]
        rows.append((len(np.setxor1d(x, y)), simhash.parities(x).tolist(), simhash.parities(y).tolist()))
    df = spark.createDataFrame(rows, "apart long, x array<long>, y array<long>").select("apart", simhash.differing_marks(F.col("x"), F.col("y")).alias("d"))
    got = [(r.apart, r.d) for r in df.collect()]
    assert all(d is None or (d <= apart and (apart - d) % 2 == 0) for apart, d in got)
    assert [d is None for _, d in got] == [False] * 7 + [True, False] and got[2][1] > 75 and got[3][1] > 85


def test_open_rows_need_no_rows_beside_their_pairs(spark):
    rng = np.random.default_rng(35)
    f = rng.integers(0, 2**63, (simhash.WIDE, 1)) ^ (1 << rng.integers(0, 62, (simhash.WIDE, 60)))
    rows = [(5, i, None, False, *(int(w) for w in f[:, i])) for i in range(60)]
    got = simhash.at_anchors(spark.createDataFrame(rows, simhash._SENT).coalesce(1)).collect()
    i, j, _, out = simhash.met(np.arange(60), np.zeros(60, np.int64), f.astype(np.uint64))
    assert {(r.a, r.b) for r in got} == {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} and len(got) == len({(r.a, r.b) for r in got})
    assert {x for r in got for x, o in ((r.a, r.one), (r.b, r.two)) if o} == set(out.tolist())
