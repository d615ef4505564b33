"""Links beyond the nearest rows of a bucket hold groups together as well."""

import numpy as np
import pytest

from tidemark.llm import common, simhash

MEMBERS = 40


def groups(rng, many):
    """Of each group the last text is like one member only, and within reach of
    all others: 356 of 444 shingles against 354 of 446."""
    texts = []
    for g in range(many):
        base = [f"w{x}" for x in rng.integers(0, 50_000, 404)]
        for k in range(MEMBERS + 1):
            n = 8 if k < MEMBERS else 6
            at = int(rng.integers(4, 280))
            texts.append(base[:at] + [f"g{g}m{k}x{x}" for x in range(n)] + base[at + n :])
        texts.append(base[:350] + [f"g{g}q{x}" for x in range(30)] + base[380:])
    return [" ".join(t) for t in texts]


def test_no_candidate_is_left_out(spark):
    texts = groups(np.random.default_rng(31), 8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.node: r.component for r in simhash.near_duplicates(df, common.Scratch(spark, "test")).collect()}
    assert got == {i: i // (MEMBERS + 2) * (MEMBERS + 2) for i in range(len(texts))}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 16])
def test_rows_with_further_partners_are_left_open(monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(32)
    f = rng.integers(0, 2**63, (3, 1)).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 63, (3, 60)).astype(np.uint64))
    f[:, 50:] = rng.integers(0, 2**63, (3, 10)).astype(np.uint64)
    i, j, _, out = simhash.met(np.arange(60), np.zeros(60, np.int64), f)
    sent = set(zip(i.tolist(), j.tolist())) | set(zip(j.tolist(), i.tolist()))
    a, b = np.triu_indices(60, 1)
    near = simhash.far_apart(f, a, b) <= simhash.FAR
    lost = [(x, y) for x, y in zip(a[near].tolist(), b[near].tolist()) if (x, y) not in sent]
    assert lost and {x for pair in lost for x in pair} <= set(out.tolist())
    assert bucket == 16 or not set(out.tolist()) & set(range(50, 60))
