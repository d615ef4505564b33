"""The corpus pipeline stage by stage against what it must do."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n)).capitalize() + "."
    good = [prose(150) for _ in range(80)]
    bad = [" ".join(w + "$$$" for w in prose(120).split()) for _ in range(40)]
    passage = " ".join(prose(70).split())
    near = good[0].split()
    near[75] = "changed"
    texts = good + bad + [good[5], good[5], " ".join(near), f"{prose(60)} {passage} {prose(60)}", f"{prose(60)} {passage} {prose(60)}"]
    n = len(texts)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r.text for r in df.collect()})
    assert len(set(seen[0]) & set(range(80, 120))) <= 2 and len(set(seen[0]) & set(range(80))) >= 78
    assert 121 in seen[1] and not {5, 120} & set(seen[1])
    assert 0 in seen[2] and 122 not in seen[2] and set(seen[1]) - set(seen[2]) == {122}
    assert passage in seen[3][n - 2] and passage not in seen[3][n - 1] and len(seen[3][n - 1].split()) == 120
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen[3])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def odd_rows(spark, more="", extra=()):
    rows = [(1, None), (2, ""), (3, "  "), (4, "same words here"), (4, "same words here"), (None, "same words here"), (None, None), (5, "other"), (6, "word " * 60_000)]
    return spark.createDataFrame([(i, t, None, None, None, *extra) for i, t in rows], COLUMNS + more)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = ", id long, tag long, digest string, score string, f0 long, anchor long, tokens string, key long, cut_id long, dropped long"
    df = odd_rows(spark, more, (7, 7, "d", "x", 1, 2, "t", 3, 4, 5))
    got = stage(name)(spark, df, str(tmp_path))
    rows = got.collect()
    assert stage(name)(spark, df.limit(0), str(tmp_path)).count() == 0
    if name == "packing":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None}
        return
    assert got.columns == df.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in rows)
    kept = [i for _, i in ids]
    want = {
        "quality classifier": [1, 2, 3, 4, 4, 5, 6, None, None],
        "exact dedup": [2, 3, 4, 5, 6],
        "SimHash near-dedup": [1, 4, 4, 5, 6, None, None],
    }
    if name in want:
        assert kept == want[name]
    else:
        assert {4, 5, 6} <= set(kept)


def brute_components(texts):
    """Smallest id reachable by Jaccard links of five-word shingles."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    comp = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return comp


def test_near_stage_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(22)
    texts = []
    for _ in range(25):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 6))):
            w = list(base)
            for at in rng.integers(0, 200, int(rng.integers(1, 6))):
                w[int(at)] = f"edit{int(rng.integers(0, 1000))}"
            texts.append(" ".join(w))
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    for _ in range(150):  # a family in which everyone is like most others
        w = list(base)
        for at in rng.integers(0, 300, 3):
            w[int(at)] = f"edit{int(rng.integers(0, 10000))}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    kept = {r.doc_id for r in stage("SimHash near-dedup")(spark, df, str(tmp_path)).collect()}
    comp = brute_components(texts)
    want = {i for i, c in enumerate(comp) if i == c}
    assert want <= kept and len(kept - want) <= 0.03 * (len(texts) - len(want))
