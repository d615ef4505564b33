"""The operators of the llm subpackage on small fixtures: brute force, round
trips, held-out accuracy and the edge cases of the docstrings."""

import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import bpe, chat, common, embedding_graph, exact_dedup, licenses, packing, quality, simhash, substring, warc

tokenizers_path = pytest.importorskip("public_tokenizers").path
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, score string, id long, tag long, key string, spans string"


def docs(spark, texts, ids=None):
    """Documents whose further columns bear names that the operators use."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, "s", None if t is None else len(t), "d", "x", 5, 6, "k", "p") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def scratch(spark):
    return common.Scratch(spark, "test")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


EDGES = ["", None, "   ", "one", "same text here", "same text here", "a b c", "é É <|endoftext|> x"]


# common


def test_components_against_union_find(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500, 500)] + [(900, 901 + i) for i in range(40)] + [(1000 + i, 1001 + i) for i in range(30)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long"), scratch(spark)).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), scratch(spark)).count() == 0


def test_join_per_key_with_a_heavy_key(spark):
    left = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k")
    right = left.groupBy("k").count().withColumnRenamed("count", "n")
    assert common.join_per_key(left, right, "k", "n").count() == 3000


# 1


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "<|assistant|>x"), (2, 0, "system", "alone"), (None, None, "cy", "")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or -1, r.participant) for r in got) == [(-1, "cy"), (1, "ann"), (1, "bob"), (1, "unknown")]
    ann = next(r for r in got if r.participant == "ann")
    assert ann.text.startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=unknown|>\n< |assistant| >x")
    a, b = map(int, ann.assistant_spans.split("-"))
    assert ann.text[a:b] == "hi<|end|>\n" and ann.n_turns == 4
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_rotation(rows):
    """A dialogue's turns in order, rendered by a loop."""
    out = {}
    for me in {r for _, r, _ in rows if r != "system"}:
        text, spans = "", []
        for _, role, body in rows:
            text += "<|assistant|>\n" if role == me else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
            if role == me:
                spans.append(f"{len(text)}-{len(text) + len(body) + 8}")
            text += body + "<|end|>\n"
        out[me] = (text, ",".join(spans))
    return out


def test_long_dialogues_stay_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 7, ("system", "ann", "bob", "cy")[int(rng.integers(0, 4))], "é" * int(rng.integers(0, 9))) for i in range(400)] + [(9999, "bob", "x" * 300_000)]
    df = spark.createDataFrame([(1, *r, "extra", 0) for r in rows], "conv_id long, turn long, role string, text string, part string, own int")
    got = {r.participant: (r.text, r.assistant_spans) for r in chat.rotate(df).collect()}
    assert got == plain_rotation(rows)


def test_chat_parts_and_marks(spark):
    rows = [(1, i, f"p{i % 2}", f"x{i}") for i in range(10)] + [(2, 0, "a|>\n<|system", "b|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part, r.participant): r for r in chat.rotate(df, part=4, context=2).collect()}
    assert sorted(k[:2] for k in got) == [(1, 0), (1, 0), (1, 1), (1, 1), (1, 2), (1, 2), (2, 0)]
    one = got[1, 1, "p0"]
    assert one.n_turns == 6 and [one.text[int(a) : int(b)] for a, b in (s.split("-") for s in one.assistant_spans.split(","))] == ["x4<|end|>\n", "x6<|end|>\n"]
    assert got[2, 0, "a| > < |system"].text == "<|assistant|>\nb| ><|end|>\n"


# 2


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(0, 20, 80)] + 0.08 * rng.normal(size=(80, 16))
    chain = [np.cos(a) * base[0] / np.linalg.norm(base[0]) + np.sin(a) * (o := base[1] - base[1] @ base[0] / (base[0] @ base[0]) * base[0]) / np.linalg.norm(o) for a in np.arange(1, 5) * 0.35]
    v = np.concatenate([base, near, base[:5], chain])
    rows = [(i, [float(x) for x in e], i % 2) for i, e in enumerate(v)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, rows[0][1], None), (905, [1.0, 0.0], 0), (906, [1.0, 0.0], 0), (907, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in embedding_graph.embedding_near_duplicates(df, scratch(spark)).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.arange(len(v)) % 2 == np.arange(len(v))[:, None] % 2)
    np.fill_diagonal(link, False)
    comp = np.arange(len(v))
    for _ in range(len(v)):
        comp = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(v))])
    want = {i: (int(link[i].sum()), int(comp[i])) for i in range(len(v))} | {i: (0, i) for i, _, _ in odd} | {905: (1, 905), 906: (1, 905)}
    assert got == want
    assert embedding_graph.embedding_near_duplicates(df.limit(0), scratch(spark)).count() == 0


def test_embeddings_in_blocks_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    v = np.concatenate([centre + 0.1 * rng.normal(size=(150, 16)), rng.normal(size=(250, 16))])
    df = spark.createDataFrame([(i, [float(x) for x in e], 1) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embedding_graph, "SHARD", 50)
    monkeypatch.setattr(embedding_graph, "BLOCK", 64)
    got = {r.id: r.n_links for r in embedding_graph.embedding_near_duplicates(df, scratch(spark)).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * want.sum() > 0


# 3


def test_classifier(spark):
    rng = np.random.default_rng(5)
    good = [prose(rng, 60).capitalize() + "." for _ in range(120)]
    bad = [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(60)]
    texts = good + bad
    df = docs(spark, texts + ["", None])
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = quality.score(df, model, name="s").collect()
    assert got[0].score == "x" and len(got) == 182 and all(0 <= r.s <= 1 for r in got)
    held = [r for r in got if r.doc_id < 180 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.s >= 0.3) == (r.doc_id < 120) for r in held]) > 0.9
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id < 120").count() >= 115
    assert quality.keep_good(df.limit(0), labels).count() == 0
    assert all(r.s == pytest.approx(quality.PRIOR) for r in quality.score(df, quality.fit(df, labels.limit(0)), name="s").collect())


def test_risk_and_its_slopes_against_sums():
    rng = np.random.default_rng(6)
    for shift in (-2.0, 0.0, 3.0):
        zp, zu, prior = rng.normal(shift, 1, 7), rng.normal(0, 1, 11), 0.6
        loss = lambda z: float(np.log1p(np.exp(z)))
        positive = prior * sum(loss(-z) for z in zp) / 7
        negative = sum(loss(z) for z in zu) / 11 - prior * sum(loss(z) for z in zp) / 7
        a, b, gp, gu = quality.risk(zp, zu, prior)
        assert (a, b) == (pytest.approx(positive), pytest.approx(negative))

        def goal(zp, zu):
            a, c, _, _ = quality.risk(zp, zu, prior)
            return a + c if b >= 0 else -c

        for z, g in ((zp, gp), (zu, gu)):
            for i in range(len(z)):
                up, down = z.copy(), z.copy()
                up[i] += 1e-5
                down[i] -= 1e-5
                there = goal(up, zu) - goal(down, zu) if z is zp else goal(zp, up) - goal(zp, down)
                assert g[i] == pytest.approx(there / 2e-5, abs=1e-6)


def test_prior_from_positives_and_unlabelled_texts():
    rng = np.random.default_rng(7)
    good = [prose(rng, 60).capitalize() + "." for _ in range(1500)]
    bad = [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(300)]
    x = np.array([quality.features(t) for t in good + bad])
    assert quality.class_prior(x[:700], x[700:]) == pytest.approx(800 / 1100, abs=0.08)


def test_a_very_long_text_is_scored_whole(spark):
    rng = np.random.default_rng(8)
    long = " ".join([prose(rng, 70_000), *["spam###"] * 140_000])
    assert quality.features(long)[quality.SURFACE - 1] > 0.6 and quality.features(long[: len(long) // 8])[quality.SURFACE - 1] == 0
    df = docs(spark, [long, None])
    assert quality.score(df, quality.fit(df, spark.createDataFrame([], "doc_id long, quality int")), name="s").count() == 2


# 4


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizers_path("byte_bpe_50k.json")
    own, lib = bpe.ByteBpe(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    parts = ["the ", "  ", "\n", "\t", "é", "漢", "😀", "'s", "1", "a", "aaaa", "Zz", "!!", "\xa0", "\x1c", "<|endoftext|>", "<|end", " \n x"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(400)] + ["x" * 5000, " " * 3000]
    for text, ids in zip(texts, own.encode_batch(texts)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)
    got = {r.id: r for r in bpe.round_trip(docs(spark, EDGES), path).collect()}
    assert len(got) == len(EDGES) and got[1].n_tokens == 0 and got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(EDGES))
    assert bpe.round_trip(docs(spark, EDGES).limit(0), path).count() == 0


# 5


def test_warc(spark):
    pages = [(i, f"http://x/{i}\r\nEvil: 1", h) for i, h in enumerate(["<p>é</p>", "", None, "<p>é</p>", "z" * 600_000, "<p>é</p>"])] + [(5, None, "<p>é</p>"), (None, "u", "n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    s = scratch(spark)
    index = warc.write_archives(df, s.path("archives"), s)
    got = sorted(warc.read_archives(index, s.path("archives")).collect(), key=lambda r: (-1 if r.page_id is None else r.page_id, r.record_type))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (None, "response", None), (0, "revisit", 5), (1, "revisit", 2), (2, "response", None), (3, "revisit", 5), (4, "response", None), (5, "response", None), (5, "revisit", 5),
    ]
    assert got[1].payload_bytes == len("<p>é</p>".encode()) and got[1].payload_digest == warc.payload_digest("<p>é</p>".encode())
    small = warc.write_archives(df, s.path("more"), common.Scratch(spark, "t"), min_bytes=5)
    assert {r.page_id: r.record_type for r in warc.read_archives(small, s.path("more")).collect()}[1] == "response"
    none = warc.write_archives(df.limit(0), s.path("none"), common.Scratch(spark, "t"))
    assert warc.read_archives(none, s.path("none")).count() == 0


def test_warc_frames_are_seekable(tmp_path):
    import zstandard

    writer = warc.BundleWriter(str(tmp_path))
    raw = [bytes([65 + i]) * 100_000 for i in range(8)]
    places = [writer.add(r) for r in raw]
    writer.close()
    reader = warc.BundleReader(str(tmp_path), writer.name)
    assert len(reader.sizes) > 2
    for r, (frame, at, n) in zip(raw, places):
        assert reader.frame(frame)[at : at + n] == r
    whole = zstandard.ZstdDecompressor().stream_reader(open(tmp_path / writer.name, "rb"), read_across_frames=True).read()
    assert whole == b"".join(raw)


# 6


def test_first_fit_decreasing_against_a_plain_loop():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        sizes = rng.integers(1, 101, n).tolist()
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room: list[int] = []
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            assert (bins[i], offsets[i]) == (b, 100 - room[b])
            room[b] -= sizes[i]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizers_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    texts = EDGES + [prose(rng, int(n)) for n in rng.integers(1, 400, 30)] + [prose(rng, 6000), "İ ŉ ﬀ Ǆ ́x \xa0 a b 's don't"]
    got = packing.pack(docs(spark, texts), path, scratch(spark), length=512, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == ids
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(p.ids) and p.length * 4 == len(p.ids) for p in pieces)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        used = sum(r.length for r in rows)
        assert [r.offset for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1]] and used <= 512
        assert rows[0].padded_tokens == (used if used & (used - 1) == 0 else 512)
    assert packing.pack(docs(spark, texts).limit(0), path, scratch(spark)).count() == 0


# 7


def test_exact_dedup(spark):
    ids = [3, 1, 2, 7, 4, 9, 9, None]
    texts = ["a", "a", None, "", "b", "c", "c", "b"]
    s = scratch(spark)
    index = exact_dedup.DigestIndex(spark, path=s.path("index"), buckets=4)
    got = index.ingest(docs(spark, texts, ids), s).collect()
    assert sorted((r.id or -1, r.keep_id, r.copies) for r in got) == [(-1, 4, 2), (1, 3, 2), (2, 7, 2), (3, 3, 2), (4, 4, 2), (7, 7, 2), (9, 9, 2), (9, 9, 2)]
    assert sorted(r.id for r in got if r.kept) == [3, 4, 7, 9]
    later = index.ingest(docs(spark, ["a", "new"], [50, 51]), common.Scratch(spark, "t")).collect()
    assert {r.id: (r.keep_id, r.copies, r.kept) for r in later} == {50: (3, 3, False), 51: (51, 1, True)}
    third = index.ingest(docs(spark, ["a", "a", "b"], [60, 61, 62]), common.Scratch(spark, "t")).collect()
    assert {r.id: (r.keep_id, r.copies, r.kept) for r in third} == {60: (3, 5, False), 61: (3, 5, False), 62: (4, 3, False)}
    assert index.table().count() == 5 and sorted(r.copies for r in index.table().collect()) == [1, 2, 2, 3, 5]
    packed = index.compacted("digest_index_packed", s.path("packed"))
    assert sorted(map(str, packed.table().collect())) == sorted(map(str, index.table().collect()))
    for x in (index, packed):
        x.forget()
    fresh = exact_dedup.DigestIndex(spark, path=s.path("index2"), buckets=4)
    kept = exact_dedup.keep_first_of_equal(docs(spark, texts, ids), fresh, common.Scratch(spark, "t"))
    assert kept.columns == DOCS.replace(" string", "").replace(" long", "").split(", ") and sorted(r.doc_id for r in kept.collect()) == [3, 4, 7, 9]
    empty = exact_dedup.DigestIndex(spark, path=s.path("index3"), buckets=4)
    assert empty.ingest(docs(spark, []), common.Scratch(spark, "t")).count() == 0


# 8


def test_licenses(spark):
    mit = dict((i, t) for i, t in reversed(licenses.KNOWN) if i == "MIT" and len(t) > 200)["MIT"]
    changed = "Copyright (c) 2020 Ann\n" + mit.upper().replace(",", " ,").replace("\n", "\n\n") + "\n(C) 1999 Bob"
    texts = [mit, changed, mit + " more", "text\nReleased under the MIT Licence.\nmore", "", None, "Released under the MIT License"]
    got = {r.id: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert [got[i].license_id for i in range(7)] == ["MIT", "MIT", None, None, None, None, "MIT"]
    assert got[3].notices == "MIT" and got[2].notices is None and got[4].canonical_sha256 == got[5].canonical_sha256
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0


# 9


def test_compact_windows_hold_each_subsequence_once():
    rng = np.random.default_rng(0)
    for _ in range(100):
        h = rng.integers(1, 30, rng.integers(1, 50)).astype(np.uint64)
        h[rng.random(len(h)) < 0.03] = 0
        least = int(rng.integers(1, 9))
        found = {}
        for l, c, r in zip(*substring.compact_windows(h, least)):
            for i in range(l, c + 1):
                for j in range(max(c, i + least - 1), r + 1):
                    assert (i, j) not in found
                    found[i, j] = c
        for i in range(len(h)):
            for j in range(i + least - 1, len(h)):
                part = h[i : j + 1]
                assert found.get((i, j)) == (None if (part == 0).any() else i + int(part.argmin()))


def test_passages(spark):
    rng = np.random.default_rng(9)
    shared, edited = prose(rng, 60).split(), prose(rng, 120).split()
    changed = list(edited)
    changed[40] = "other"
    short = prose(rng, 30)
    texts = [
        prose(rng, 100) + "\n" + " ".join(shared) + " " + prose(rng, 30),
        prose(rng, 20) + " " + " ".join(shared) + "  " + prose(rng, 80),
        prose(rng, 70) + " " + " ".join(edited),
        " ".join(changed) + " " + prose(rng, 10),
        prose(rng, 300) + " " + short,
        short + " " + prose(rng, 200),
        prose(rng, 80),
        " ".join(["spam"] * 300),
        None,
        "",
    ]
    df = docs(spark, texts)
    got = {(r.id, r.other): r for r in substring.near_duplicate_passages(df, scratch(spark)).collect()}
    assert set(got) == {(1, 0), (3, 2)}
    assert got[1, 0].start == 20 and got[1, 0].stop == 80 and got[3, 2].similarity >= 0.8
    cut = {r.doc_id: r for r in substring.cut_passages(df, scratch(spark)).collect()}
    assert set(cut) == set(range(10)) and [cut[i].text for i in (0, 2, 4, 5, 6, 7)] == [texts[i] for i in (0, 2, 4, 5, 6, 7)]
    assert len(cut[1].text.split()) == 100 and cut[1].n_chars == len(cut[1].text) and cut[1].spans == "p"
    assert substring.cut_passages(df.limit(0), scratch(spark)).count() == 0


def test_verbatim_passages_survive_a_crowd(spark):
    """Many documents share the middle of two passages: those that are longer
    meet all the same."""
    rng = np.random.default_rng(10)
    middle, left, right = prose(rng, 30), prose(rng, 20), prose(rng, 20)
    texts = [prose(rng, 40) + " " + middle + " " + prose(rng, 40) for _ in range(12)]
    texts += [prose(rng, 40) + f" {left} {middle} {right} " + prose(rng, 40) for _ in range(2)]
    got = {(r.id, r.other) for r in substring.near_duplicate_passages(docs(spark, texts), scratch(spark)).collect()}
    assert got == {(13, 12)}


# 10


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(12)
    texts = [prose(rng, 300, 50) for _ in range(20)]
    for t in texts[:10]:
        w = t.split()
        for _ in range(3):
            w[int(rng.integers(0, 300))] = "Edit"
            texts.append(" ".join(w))
    texts += EDGES
    df = docs(spark, texts)
    got = {r.id: (r.f0 % 2**64, r.component_id) for r in simhash.simhash_classes(df, scratch(spark)).collect()}
    import xxhash

    prints = []
    for t in texts:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(texts)))
    for _ in range(len(texts)):
        comp = [min(comp[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(texts))]
    assert got == {i: (prints[i], comp[i]) for i in range(len(texts))}
    assert simhash.simhash_classes(df.limit(0), scratch(spark)).count() == 0


def test_anchors_cover_every_close_pair(spark):
    rng = np.random.default_rng(13)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(300)], np.uint64)
    both = np.unique(np.concatenate([a, a ^ flips])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in both], "f0 long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.hamming_links(df).collect()}
    u = both.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    assert got == {(int(both[i]), int(both[j])) if both[i] < both[j] else (int(both[j]), int(both[i])) for i, j in zip(*np.nonzero(near)) if i != j}


@pytest.mark.parametrize("code", [simhash.hamming32(), simhash.golay23()])
def test_covering_radius(code):
    errors, start, size = code.patterns(code.covering_radius)
    assert (size > 0).all()
    x = np.random.default_rng(1).integers(0, 1 << code.bits, 500).astype(np.uint64)
    home = x ^ errors[start[code.syndromes(x)]]
    assert (code.syndromes(home) == 0).all() and (np.bitwise_count(x ^ home) <= code.covering_radius).all()


def test_near_duplicates_by_similarity(spark):
    rng = np.random.default_rng(14)
    texts = [prose(rng, 250) for _ in range(30)]
    for k in range(30):
        w = texts[k].split()
        w[int(rng.integers(5, 245))] = "changed"
        w[int(rng.integers(5, 245))] = "too"
        texts.append(" ".join(w))
    texts += ["", None, "short", "short"]
    df = docs(spark, texts)
    got = {r.node: r.component for r in simhash.near_duplicates(df, scratch(spark)).collect()}
    found = sum(got.get(30 + k) == k for k in range(30))
    assert found >= 27 and all(i % 30 == c % 30 for i, c in got.items() if i < 60)
    kept = {r.doc_id for r in simhash.keep_one_of_each_group(df, scratch(spark)).collect()}
    assert set(range(30)) <= kept and len(kept & set(range(30, 60))) == 30 - found
    assert simhash.keep_one_of_each_group(df.limit(0), scratch(spark)).count() == 0
