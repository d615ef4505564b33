"""Embedding near-duplicates on a robust-pruned flat graph.

Vectors go to the shards of their nearest few centroids.  Each shard builds a
flat graph whose edges survive robust pruning; the adjacency lists of a vector
from all its shards are united.  Each shard then runs a greedy search from its
medoid for each member, which keeps expanding as long as it meets vectors in
range.  Found pairs are verified by their cosine in double precision, and
recall is audited against brute force over all vectors for a fixed set of
queries.

Nothing is emitted for each pair: a shard returns a count for each vector and
a spanning forest of its links.  A pair that shares several shards is counted
in the one with the least number.

Defined cases: only vectors with the same label, not null, and the same length
are compared.  Null or empty vectors, zero vectors and those with a null or
non-finite component link with nothing.  Equal vectors are searched once and
count as linked; rows with the same id are rows of their own.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, join_per_key, tidy

#: Vectors a shard should have; more than BLOCK are searched block by block.
SHARD, BLOCK = 1024, 2048
#: Bounds on what the shards' centroids are chosen from, and on their number.
SAMPLE, CENTROIDS = 40_000, 4096
#: Centroids are less alike than this, so a dense group isn't cut up.
APART = 0.8
#: Out-degree, candidates and slack of the robust pruning; steps of the search.
DEGREE, NEAREST, RANDOM, ALPHA, STEPS = 24, 48, 24, 1.2, 24
#: Queries of the audit at least (or the root of the number of vectors), the
#: recall to reach, and the queries of a family size whose own recall counts.
AUDIT, RECALL, ENOUGH = 2000, 0.9, 20
#: Cells of similarities at a time; numbers of opened vectors at a time, and
#: queries, so that both stay in a core's cache.
CELLS, OPENED, QUERIES = 1 << 21, 1 << 16, 256
#: With more centroids than this a pair too often shares none of two shards.
FEW = 50


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of lists of the same length as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def prune(d: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Robust pruning for all nodes at once.

    ``d``: distances between all; ``cand``: candidates of each node, nearest
    first.  Returns up to DEGREE neighbours of each, padded with -1.  Having
    taken the nearest p, a node drops every candidate c with
    ALPHA * d(p, c) <= d(node, c).
    """
    n = len(d)
    rows = np.arange(n)
    own = d[rows[:, None], cand]
    alive = cand != rows[:, None]
    out = np.full((n, DEGREE), -1)
    for k in range(min(DEGREE, cand.shape[1])):
        at = alive.argmax(1)
        some = alive[rows, at]
        if not some.any():
            break
        p = cand[rows, at]
        out[some, k] = p[some]
        alive[rows, at] = False
        alive &= ALPHA * d[p[:, None], cand] > own
    return out


def build(v: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Adjacency of the flat graph over unit vectors, with every node reachable
    from the medoid; and the medoid."""
    n = len(v)
    d = np.maximum(0, 2 - 2 * (v @ v.T))
    medoid = int((v @ v.sum(0)).argmax())
    k = min(n, NEAREST + 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    cand = np.concatenate([near, np.random.default_rng(seed).integers(0, n, (n, RANDOM)), np.full((n, 1), medoid)], axis=1)
    cand = np.take_along_axis(cand, np.argsort(np.take_along_axis(d, cand, 1), axis=1, kind="stable"), 1)
    edge = np.zeros((n, n), bool)
    out = prune(d, cand)
    from_, k = np.nonzero(out >= 0)
    edge[from_, out[from_, k]] = True
    edge |= edge.T
    np.fill_diagonal(edge, False)
    seen = np.zeros(n, bool)
    seen[medoid] = True
    while True:
        front = seen.copy()
        while front.any():
            front = edge[front].any(0) & ~seen
            seen |= front
        if seen.all():
            return edge, medoid
        lost = np.flatnonzero(~seen)
        had = np.flatnonzero(seen)
        pair = d[np.ix_(lost, had)]
        i = int(pair.min(1).argmin())
        a, b = lost[i], had[pair[i].argmin()]
        edge[a, b] = edge[b, a] = seen[a] = True


def search(q: np.ndarray, v: np.ndarray, edge: np.ndarray, start: np.ndarray, least: float) -> np.ndarray:
    """Similarities of queries to the nodes that their search opens; -9 for all
    others, which are never compared.

    ``start``: nodes each query starts from.  STEPS best-first steps, then all
    that is in range is expanded until nothing new is.
    """
    ends = np.cumsum(edge.sum(1))
    lists = np.nonzero(edge)[1], np.concatenate(([0], ends[:-1])), np.diff(ends, prepend=0)
    wide = edge.astype(np.float32)
    parts = [_search(q[at : at + QUERIES], v, lists, wide, start[at : at + QUERIES], least) for at in range(0, len(q), QUERIES)]
    return np.concatenate(parts) if parts else np.empty(start.shape)


def _search(q: np.ndarray, v: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], wide: np.ndarray, start: np.ndarray, least: float) -> np.ndarray:
    """``search`` of a few queries.  ``lists``: neighbours of all nodes in a row,
    where each node's begin and their number."""
    nq, n = start.shape
    near, begin, many = lists
    # open_: as sim, without the nodes that were expanded.
    sim, open_, seen = np.full((nq, n), -9.0), np.full((nq, n), -9.0), np.zeros((nq, n), bool)
    step = max(1, OPENED // v.shape[1])
    x, y = np.empty((2, step, v.shape[1]))

    def opened(rows: np.ndarray, cols: np.ndarray) -> None:
        seen[rows, cols] = True
        for at in range(0, len(rows), step):
            r, c = rows[at : at + step], cols[at : at + step]
            k = len(r)
            np.take(q, r, axis=0, out=x[:k], mode="clip")
            np.take(v, c, axis=0, out=y[:k], mode="clip")
            sim[r, c] = open_[r, c] = np.einsum("ij,ij->i", x[:k], y[:k])

    opened(*np.nonzero(start))
    rows = np.arange(nq)
    for _ in range(min(STEPS, n)):
        best = open_.argmax(1)
        go = rows[open_[rows, best] > -9]
        if not len(go):
            break
        best = best[go]
        open_[go, best] = -9.0
        size = many[best]
        row = np.repeat(go, size)
        col = near[np.arange(len(row)) + np.repeat(begin[best] - np.cumsum(size) + size, size)]
        new = ~seen[row, col]
        opened(row[new], col[new])
    while True:
        front = open_ >= least
        go = np.flatnonzero(front.any(1))
        if not len(go):
            return sim
        open_[front] = -9.0
        row, col = np.nonzero((front[go].astype(np.float32) @ wide > 0) & ~seen[go])
        opened(go[row], col)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Links of a spanning forest of the given links between numbers."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def choose_centroids(reps: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """For each label and length, unit vectors of the sample that are apart.

    The sample is bounded: SAMPLE rows in all, spread over the labels by their
    share; labels beyond CENTROIDS share shards, being left without centroids.
    """
    total = reps.count()
    shares = reps.groupBy("label", "dim").count().orderBy(F.desc("count"), "label", "dim").limit(CENTROIDS).collect()
    want = {(r.label, r.dim): max(1, min(CENTROIDS, -(-2 * r["count"] // SHARD))) for r in shares if r["count"] > SHARD}
    if not want:
        return {}
    sample = reps.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, total)))).select("label", "dim", "embedding").toArrow()
    table: dict[tuple[int, int], np.ndarray] = {}
    left = CENTROIDS
    for (label, dim), k in want.items():
        mine = sample.filter(pa.compute.and_(pa.compute.equal(sample["label"], label), pa.compute.equal(sample["dim"], dim)))
        if not mine.num_rows:
            continue
        v, most = unit(mine["embedding"]), min(k, left)
        chosen, many = np.empty((min(most, len(v)), v.shape[1])), 0
        for x in v:
            if many >= most:
                break
            if not many or (chosen[:many] @ x).max() < APART:
                chosen[many] = x
                many += 1
        left -= many
        if many:
            table[label, dim] = chosen[:many].copy()
    return table


def place(reps: DataFrame, table: dict[tuple[int, int], np.ndarray], overlap: int) -> DataFrame:
    """``rid`` and the sorted numbers of the centroids nearest to it."""

    def run(batches):
        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            lists: list[list[int]] = [[0]] * batch.num_rows
            for key in set(zip(labels, dims)):
                at = [i for i, x in enumerate(zip(labels, dims)) if x == key]
                if key in table:
                    c = table[key]
                    away = -(unit(batch.column("embedding").take(pa.array(at))) @ c.T)
                    near = np.argpartition(away, min(overlap, len(c)) - 1, axis=1)[:, :overlap]
                    for i, x in zip(at, np.sort(near, axis=1).tolist()):
                        lists[i] = x
            yield pa.record_batch([batch.column("rid"), pa.array(lists, pa.list_(pa.int32()))], ["rid", "shards"])

    return reps.select("rid", "label", "dim", "embedding").mapInArrow(tidy(run), "rid long, shards array<int>")


KEY = ["label", "dim", "shard"]


def _graph(table: pa.Table) -> pa.Table:
    v = unit(table["embedding"])
    rid = np.asarray(table["rid"])
    order = np.argsort(rid)
    v, rid = v[order], rid[order]
    edge, medoid = build(v, int(rid[0]) & 0xFFFF)
    lists = [rid[e] for e in edge]
    return pa.table({"rid": rid, "near": pa.array(lists, pa.list_(pa.int64())), "medoid": np.arange(len(rid)) == medoid})


def padded(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as rows, filled up with -1."""
    rows = lists.to_pylist()
    most = max(map(len, rows))
    return np.array([x + [-1] * (most - len(x)) for x in rows])


def _found(least: float):
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        q, node = (table.filter(pa.array((side & bit) > 0)) for bit in (1, 2))
        empty = {"rid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}
        if not q.num_rows or not node.num_rows:
            return pa.table(empty)
        shard = table["shard"][0].as_py()
        qr, nr = np.asarray(q["rid"]), np.asarray(node["rid"])
        order = np.argsort(nr)
        near = node["near"].combine_chunks()
        target = np.asarray(near.flatten())
        from_ = np.repeat(np.arange(len(nr)), np.asarray(pa.compute.list_value_length(near)))
        at = np.minimum(np.searchsorted(nr, target, sorter=order), len(nr) - 1)
        here = nr[order[at]] == target
        edge = np.zeros((len(nr), len(nr)), bool)
        edge[from_[here], order[at[here]]] = True
        own = qr[:, None] == nr[None, :]
        start = own | np.asarray(node["medoid"])[None, :]
        hit = (search(unit(q["embedding"]), unit(node["embedding"]), edge, start, least) >= least) & ~own
        i, j = np.nonzero(hit)
        ours, theirs = (padded(x["shards"]) for x in (q, node))
        counted = np.ones(len(i), bool)
        for x in ours.T:
            for y in theirs.T:
                counted &= (x[i] != y[j]) | (x[i] < 0) | (x[i] >= shard)
        links = np.bincount(i[counted], np.asarray(node["copies"])[j[counted]], len(qr)).astype(np.int64)
        pairs = forest(np.stack([qr[i], nr[j]], 1))
        none = [None] * len(pairs)
        return pa.table(
            {
                "rid": pa.concat_arrays([pa.array(qr, pa.int64()), pa.array(none, pa.int64())]),
                "links": pa.concat_arrays([pa.array(links, pa.int64()), pa.array(none, pa.int64())]),
                "a": pa.concat_arrays([pa.array([None] * len(qr), pa.int64()), pa.array(pairs[:, 0])]),
                "b": pa.concat_arrays([pa.array([None] * len(qr), pa.int64()), pa.array(pairs[:, 1])]),
            }
        )

    return run


def search_shards(reps: DataFrame, table: dict[tuple[int, int], np.ndarray], overlap: int, least: float, scratch: Scratch, turn: str) -> DataFrame:
    """Counts (``rid, links``) and forest links (``a, b``) of every shard."""
    placed = scratch.keep(place(reps, table, overlap), f"placed{turn}")
    members = reps.join(placed.hint("merge"), "rid").withColumn("shard", F.explode("shards"))
    sizes = members.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
    # Only shards above BLOCK are cut, at most 2 / BLOCK of all rows.
    blocks = sizes.select(*KEY, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    members = scratch.keep(
        members.join(blocks.hint("shuffle_hash"), KEY).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")),
        f"members{turn}",
    )
    graphs = scratch.keep(
        members.groupBy(*KEY, "block").applyInArrow(_graph, "rid long, near array<long>, medoid boolean"), f"graphs{turn}"
    )
    # The union of a vector's lists, from at most ``overlap`` shards.
    united = graphs.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("medoid").alias("medoid"))
    full = scratch.keep(members.join(united.hint("merge"), "rid"), f"full{turn}")
    lone = full.where("blocks = 1").withColumn("against", F.lit(0)).withColumn("side", F.lit(3))
    cut = full.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = cut.withColumn("against", F.col("other")).withColumn("side", F.lit(1)).drop("other")
    told = cut.withColumn("against", F.col("block")).withColumn("block", F.col("other")).withColumn("side", F.lit(2)).drop("other")
    work = lone.unionByName(asks).unionByName(told)
    return scratch.keep(
        work.groupBy(*KEY, "block", "against").applyInArrow(_found(least), "rid long, links long, a long, b long"), f"found{turn}"
    )


def audit(reps: DataFrame, counts: DataFrame, least: float) -> list[tuple[int, float, int]]:
    """``family, recall, n`` of the audited queries that have links: the mean
    share of a query's links that were found, by the power of two of their
    number.  Links found are true and counted once, so they are pairs.
    """
    asked = max(AUDIT, int(reps.count() ** 0.5))
    asked = reps.orderBy(F.xxhash64("rid"), "rid").limit(asked).select("rid", "label", "dim", "embedding").toArrow()
    if not asked.num_rows:
        return []
    by: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    labels, dims = asked["label"].to_pylist(), asked["dim"].to_pylist()
    for key in set(zip(labels, dims)):
        some = asked.take(pa.array([i for i, x in enumerate(zip(labels, dims)) if x == key]))
        by[key] = np.asarray(some["rid"]), unit(some["embedding"])

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            for key in set(zip(labels, dims)) & set(by):
                rows = [i for i, x in enumerate(zip(labels, dims)) if x == key]
                rid, q = by[key]
                step = max(1, CELLS // len(rid))
                for at in range(0, len(rows), step):
                    part = batch.take(pa.array(rows[at : at + step]))
                    hit = (q @ unit(part.column("embedding")).T >= least) & (rid[:, None] != np.asarray(part.column("rid"))[None, :])
                    sums[key] = sums.get(key, 0) + hit @ np.asarray(part.column("copies"))
        for key, there in sums.items():
            yield pa.record_batch([pa.array(by[key][0]), pa.array(there)], ["rid", "there"])

    there = reps.select("rid", "label", "dim", "embedding", "copies").mapInArrow(tidy(run), "rid long, there long")
    there = there.groupBy("rid").agg(F.sum("there").alias("there")).where(F.col("there") > 0)
    share = F.least(F.coalesce("links", F.lit(0)), F.col("there")) / F.col("there")
    rows = there.join(counts, "rid", "left").groupBy(F.floor(F.log2("there")).alias("family")).agg(F.avg(share).alias("recall"), F.count(F.lit(1)).alias("n"))
    return sorted((int(r.family), float(r.recall), int(r.n)) for r in rows.collect())


def enough(recalls: list[tuple[int, float, int]]) -> bool:
    """Whether the mean query and each family size reach RECALL."""
    mean = sum(r * n for _, r, n in recalls) >= RECALL * sum(n for _, _, n in recalls) - 1e-9
    return mean and all(r >= RECALL for _, r, n in recalls if n >= ENOUGH)


def embedding_near_duplicates(rows: DataFrame, scratch: Scratch, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, n_links, component_id`` of every row.

    Shards overlap twofold, or fourfold if a label has more than FEW
    centroids; if the audit finds less than RECALL for the mean query or for
    those of a family size, the search runs again with twice the overlap, up to
    eightfold, and then raises.
    """
    vector = F.col("embedding")
    rows = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast(T.ArrayType(T.DoubleType())).alias("embedding"),
    )
    good = (
        F.col("label").isNotNull()
        & F.coalesce(F.size(vector) > 0, F.lit(False))
        & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("key", F.when(good, F.unhex(F.sha2(F.concat_ws(":", "label", vector.cast("string")), 256))))
    keyed = scratch.keep(rows.select("id", "key"), "keyed")
    reps = scratch.keep(
        rows.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dim", F.size("embedding"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "reps",
    )
    table = choose_centroids(reps)
    for overlap in (2, 4, 8) if max(map(len, table.values()), default=0) <= FEW else (4, 8):
        found = search_shards(reps, table, overlap, least, scratch, f"-{overlap}")
        counts = scratch.keep(found.where(F.col("rid").isNotNull()).groupBy("rid").agg(F.sum("links").alias("links")), f"counts-{overlap}")
        recalls = audit(reps, counts, least)
        if enough(recalls):
            break
    else:
        raise RuntimeError(f"the search's recall by family size: {recalls}")
    parts = connected_components(found.where(F.col("a").isNotNull()).select("a", "b"), scratch)
    known = scratch.keep(
        reps.select("rid", "key", "least", "copies").join(counts, "rid", "left").join(parts.withColumnRenamed("node", "rid"), "rid", "left"), "known"
    )
    linked = known.where(F.col("component").isNotNull())
    smallest = scratch.keep(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "smallest")
    labels = scratch.keep(
        join_per_key(linked, smallest, "component", "members")
        .select("key", "copies", "links", "component_id")
        .unionByName(known.where(F.col("component").isNull()).select("key", "copies", "links", F.col("least").alias("component_id"))),
        "labels",
    )
    usable = join_per_key(keyed.where(F.col("key").isNotNull()), labels, "key", "copies").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    return usable.unionByName(keyed.where(F.col("key").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
