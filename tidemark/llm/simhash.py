"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints that differ in few bits are found without comparing all pairs.
The bits are cut into blocks; on each block the anchors are the words of a
perfect code with covering radius R, so every value has an anchor within R and
two values at distance t share that anchor if both are sent to every anchor
within R + t.  Values are compared per block and anchor only.

Defined cases: a null text counts as empty; an empty text has fingerprint zero
and links like any other.  Rows with equal texts or repeated ids are rows of
their own.  Null ids get a component but are never its smallest id unless it
has no other.  An empty table gives an empty result.  Other columns are
ignored.  Texts of any length are hashed in pieces of bounded memory.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, join_per_key, slices, tidy, unused

#: Shingles whose bits are unpacked at once.
PIECE = 1 << 14


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by spaces; of the whole
    sequence if it is shorter; nothing if there are no words."""
    if not words:
        return np.empty(0, np.uint64)
    text, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([h(text, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - size + 1
    return np.fromiter((h(text[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[size - 1 :].tolist())), np.uint64, last)


def run_hashes(t: np.ndarray, run: int) -> np.ndarray:
    """A hash of every ``run`` values in a row: polynomials, doubled in length
    step by step."""
    n, by = len(t) - run + 1, 0x9E3779B97F4A7C15
    if n <= 0:
        return t[:0]
    out, done, width, power = None, 0, 1, t
    while done < run:
        factor = np.uint64(pow(by, width, 1 << 64))
        if run & width:
            m = len(t) - done - width + 1
            out = power if out is None else out[:m] * factor + power[done : done + m]
            done += width
        power = power[:-width] * factor + power[width:]
        width *= 2
    return stirred(out, run)


#: Bytes of text hashed at once, and the places of a word with factors of their
#: own; bytes in lower case, and which of them are white space.
CHUNK, FACTORS = 1 << 20, np.random.default_rng(42).integers(0, 1 << 63, (2, 4096), np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of some texts, and how many each has."""
    raw = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = ~SPACE[raw]
    change = np.flatnonzero(np.diff(inside, prepend=False))
    begin, size = change[::2], change[1::2] - change[::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    count = np.diff(np.searchsorted(begin, ends), prepend=0)
    if not len(begin):
        return np.empty(0, np.uint64), count
    at = np.flatnonzero(inside)
    place = at - np.repeat(begin, size)
    value = FACTORS[0][place & 4095] * (raw[at].astype(np.uint64) + np.uint64(1))
    if size.max() > 4096:
        value *= stirred(FACTORS[1][place >> 12 & 4095] + (place >> 24).astype(np.uint64), 1) | np.uint64(1)
    return stirred(np.add.reduceat(value, np.cumsum(size) - size), 1), count


def token_hashes(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text a hash of every run of ``size`` words, made from hashes of
    the words; of the whole sequence if it is shorter; nothing if there are no
    words."""
    raw, out, begin = [(t or "").encode("utf-8", "surrogatepass") for t in texts], [], 0
    while begin < len(raw):
        end, total = begin + 1, len(raw[begin])
        while end < len(raw) and total + len(raw[end]) <= CHUNK:
            total += len(raw[end])
            end += 1
        h, n = word_hashes(raw[begin:end])
        runs, ends, begin = run_hashes(h, size), np.cumsum(n), end
        for a, b in zip((ends - n).tolist(), ends.tolist()):
            if b - a >= size:
                out.append(runs[a : b - size + 1])
            else:
                out.append(run_hashes(h[a:b], b - a) if b > a else h[:0])
    return out


def stirred(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64 bits from a 64-bit hash (k = 0: the hash itself)."""
    if not k:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(h: np.ndarray) -> int:
    """64 bits, each 1 where more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), PIECE):
        part = np.ascontiguousarray(h[at : at + PIECE]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id`` and the 64-bit fingerprint ``f0`` of every row, from the XXH64 of
    its shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1)):
                out[i] = fingerprint(shingle_hashes(words_of(text.as_py()), size))
            yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], ["id", "f0"])

    return _texts(docs, id_col, text_col).mapInArrow(tidy(run), "id long, f0 long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """``id``, the number of a row's distinct shingles (``many``) and ``WIDE``
    64-bit words ``f0, f1, ...`` of their SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, PART):
                out, many = np.zeros((WIDE, batch.num_rows), np.uint64), np.zeros(batch.num_rows, np.int64)
                for i, h in enumerate(token_hashes(batch.column(1).to_pylist(), size)):
                    h = np.unique(h)
                    many[i] = len(h)
                    for k in range(WIDE):
                        out[k, i] = fingerprint(stirred(h, k))
                yield pa.record_batch([batch.column(0), pa.array(many), *(pa.array(x.view(np.int64)) for x in out)], ["id", "many", *NAMES])

    return _texts(docs, id_col, text_col).mapInArrow(tidy(run), "id long, many long, " + ", ".join(f"{x} long" for x in NAMES))


class Code:
    """A linear code of up to 32 bits, given by what each bit adds to the
    syndrome, and the error patterns of each syndrome."""

    def __init__(self, columns: list[int], covering_radius: int):
        self.columns, self.bits, self.covering_radius = columns, len(columns), covering_radius
        self.rows = max(columns).bit_length()
        self.masks = [sum(1 << i for i, c in enumerate(columns) if c >> r & 1) for r in range(self.rows)]

    def syndromes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for r, mask in enumerate(self.masks):
            out |= (np.bitwise_count(x & np.uint64(mask)).astype(np.int64) & 1) << r
        return out

    def patterns(self, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Errors of weight up to ``radius``, grouped by syndrome; where each
        group starts and its size."""
        found: list[tuple[int, int]] = []
        for weight in range(radius + 1):
            for bits in itertools.combinations(range(self.bits), weight):
                s = e = 0
                for b in bits:
                    s, e = s ^ self.columns[b], e | 1 << b
                found.append((s, e))
        found.sort()
        size = np.bincount([s for s, _ in found], minlength=1 << self.rows)
        return np.array([e for _, e in found], np.uint64), np.concatenate(([0], np.cumsum(size)[:-1])), size


def hamming32() -> Code:
    """The perfect Hamming code on 31 bits (radius 1) beside one free bit."""
    return Code([*range(1, 32), 0], 1)


def golay23() -> Code:
    """The perfect binary Golay code (radius 3): the syndrome of bit i is the
    remainder of x^i by x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1."""
    columns, rest = [], 1
    for _ in range(23):
        columns.append(rest)
        rest <<= 1
        if rest >> 11:
            rest ^= 0b110001110101
    return Code(columns, 3)


def expanded(code: Code, patterns: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For values ``x`` of a block: the row, the anchor and the error of every
    anchor among the patterns' errors."""
    errors, start, size = patterns
    s = code.syndromes(x)
    many = size[s]
    row = np.repeat(np.arange(len(x)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    e = errors[np.repeat(start[s], many) + nth]
    return row, x[row] ^ e, e


def anchored(prints: DataFrame, code: Code, blocks: int, radius: int) -> DataFrame:
    """A row for each fingerprint ``f0``, block of its bits and anchor within
    ``radius``.  Added: ``anchor`` (block and code word) and ``home`` (the
    anchor is within the covering radius)."""
    n = code.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = code.patterns(radius)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                f = np.asarray(batch.column(0)).view(np.uint64)
                for block in range(blocks):
                    row, anchor, e = expanded(code, patterns, (f >> np.uint64(block * n)) & np.uint64((1 << n) - 1))
                    anchor = anchor | np.uint64(block << 32)
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array(row)), pa.array(anchor.view(np.int64)), pa.array(np.bitwise_count(e) <= code.covering_radius)],
                        ["f0", "anchor", "home"],
                    )

    return prints.select("f0").mapInArrow(tidy(run), "f0 long, anchor long, home boolean")


def hamming_links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs ``a, b`` of different 64-bit fingerprints (column ``f0``, each
    once) that differ in up to ``threshold`` bits.

    Two blocks of 32 bits: one of them differs in ``t = threshold // 2`` bits
    at most, so the fingerprint's home anchor there (within R) is within R + t
    of the other.
    """
    code = hamming32()
    sent = anchored(prints, code, 2, code.covering_radius + threshold // 2)
    near = (F.col("x.f0") < F.col("y.f0")) & (F.bit_count(F.col("x.f0").bitwiseXOR(F.col("y.f0"))) <= threshold)
    return (
        sent.where("home").alias("x")
        .join(sent.alias("y").hint("merge"), (F.col("x.anchor") == F.col("y.anchor")) & near)
        .select(F.col("x.f0").alias("a"), F.col("y.f0").alias("b"))
    )


def simhash_classes(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: int = 2) -> DataFrame:
    """``id, f0, component_id`` of every row: fingerprints at up to
    ``threshold`` differing bits link, and a component takes its smallest id.

    Rows with equal fingerprints are one class from the start, so a group of
    copies costs one row in the search.
    """
    rows = scratch.keep(fingerprints(docs, id_col, text_col, size), "prints")
    classes = scratch.keep(rows.groupBy("f0").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    links = scratch.keep(hamming_links(classes, threshold).distinct(), "links")
    parts = connected_components(links, scratch)
    known = scratch.keep(classes.join(parts.withColumnRenamed("node", "f0"), "f0", "left"), "known")
    linked = known.where(F.col("component").isNotNull())
    smallest = scratch.keep(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "smallest")
    labels = scratch.keep(
        join_per_key(linked, smallest, "component", "members")
        .select("f0", "component_id", "n")
        .unionByName(known.where(F.col("component").isNull()).select("f0", F.col("least").alias("component_id"), "n")),
        "labels",
    )
    return join_per_key(rows, labels, "f0", "n").select("id", "f0", "component_id")


#: For whole texts: words of a fingerprint, the bits that may differ in all and
#: from a leader, and the rows of a bucket that each one goes on with.  At similarity 0.8 a bit differs with probability
#: 0.15: about 29 +- 5 of 192; unrelated texts differ in about 96.
WIDE, FAR, CLOSE, NEAREST = 3, 46, 29, 3
NAMES = [f"f{k}" for k in range(WIDE)]
#: Probabilities that a pair at similarity 0.8 shares an anchor of a block (a
#: Golay code, radius 3 + 1 on both sides) and agrees in a further bit; the
#: chance to miss it in all blocks.
SHARED, AGREED, MISSED = 0.6, 0.85, 0.004
#: Rows of a block that one more exact bit is used for when there are twice as
#: many; rows of a bucket compared at once; bytes of text and of sets at a time.
ROWS, BUCKET, PART = 1 << 17, 2048, 8 << 20


def layout(rows: int) -> list[np.ndarray]:
    """The bits of each block for that many rows: 23 for the code and some that
    must agree, one more with each doubling beyond ROWS.  So a bucket's rows
    stay bounded, and blocks are added until a pair is missed by all with
    probability MISSED at most: comparisons and anchors for each row grow as
    the input's 0.23rd power."""
    tail = max(0, int(np.ceil(np.log2(max(1, rows) / ROWS))))
    blocks = int(np.ceil(np.log(MISSED) / np.log1p(-SHARED * AGREED**tail)))
    rng, size, out, deck = np.random.default_rng(23), 23 + tail, [], np.empty(0, np.int64)
    for _ in range(blocks):
        if len(deck) < size:
            deck = rng.permutation(64 * WIDE)
        out.append(deck[:size])
        deck = deck[size:]
    return out


def far_apart(f: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of the fingerprints (a row for each word) at i and j."""
    return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in f)


def nearest(own: np.ndarray, other: np.ndarray, d: np.ndarray, many: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``own`` with the ``many`` of ``other`` at the least ``d``."""
    order = np.lexsort((other, d, own))
    own, other = own[order], other[order]
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    some = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own)))) < many
    return own[some], other[some]


def leaders(anchor: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by anchor: each row with the nearest earlier leader of its
    bucket and with the NEAREST rows of any kind, if within FAR bits; which
    rows are leaders; and those with a row within FAR bits that they are not
    paired with.

    A row is no leader if an earlier leader of its bucket is within CLOSE bits.
    So pairs are a few to each row, in families of any size.
    """
    n = len(anchor)
    lead, left, right, bits = np.ones(n, bool), [], [], []
    i = np.arange(n)
    for step in range(1, n):
        i = i[: np.searchsorted(i, n - step)]
        i = i[anchor[i] == anchor[i + step]]
        if not len(i):
            break
        d = far_apart(f, i, i + step)
        near = d <= FAR
        if near.any():
            left.append(i[near])
            right.append(i[near] + step)
            bits.append(d[near])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64), lead, np.empty(0, np.int64)
    i, j, d = np.concatenate(left), np.concatenate(right), np.concatenate(bits)
    close = np.flatnonzero(d <= CLOSE)
    close = close[np.lexsort((i[close], j[close]))]
    for a, b in zip(i[close].tolist(), j[close].tolist()):
        if lead[a]:
            lead[b] = False
    led, own, other = lead[i], np.concatenate([i, j]), np.concatenate([j, i])
    x, y = zip(nearest(j[led], i[led], d[led]), nearest(own, other, np.concatenate([d, d]), NEAREST))
    x, y = np.concatenate(x), np.concatenate(y)
    out = ~np.isin(i * n + j, np.minimum(x, y) * n + np.maximum(x, y))
    return x, y, lead, np.unique(np.concatenate([i[out], j[out]]))


#: A row at an anchor, and whether rows there have stayed behind (``cut``); or,
#: with ``other``, a pair, which of a row with itself says that it is left open.
_SENT = "anchor long, id long, other long, cut boolean, " + ", ".join(f"{x} long" for x in NAMES)


def _sent(anchor, ids, cut, f, a, b) -> pa.RecordBatch:
    many = len(a)
    columns = [pa.array(np.concatenate([anchor.view(np.int64), np.zeros(many, np.int64)])), pa.array(np.concatenate([ids, a]))]
    columns.append(pa.array(np.concatenate([np.zeros(len(ids), np.int64), b]), mask=np.arange(len(ids) + many) < len(ids)))
    columns.append(pa.array(np.concatenate([cut, np.zeros(many, bool)])))
    columns += [pa.array(np.concatenate([w.view(np.int64), np.zeros(many, np.int64)])) for w in f]
    return pa.record_batch(columns, ["anchor", "id", "other", "cut", *NAMES])


def at_blocks(f: np.ndarray, blocks: list[np.ndarray], code: Code, patterns: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block the rows of fingerprints and their anchors."""
    for number, bits in enumerate(blocks):
        x, more = (sum((f[b // 64] >> np.uint64(b % 64) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(part)) for part in (bits[:23].tolist(), bits[23:].tolist()))
        row, anchor, _ = expanded(code, patterns, x)
        if len(bits) > 23:
            anchor = anchor | (more << np.uint64(23))[row]
        yield row, anchor | np.uint64(number << 50)


def to_anchors(prints: DataFrame, rows: int) -> DataFrame:
    """Every fingerprint at every anchor within radius 3 + 1, combined where
    they are made: where a batch has many rows at an anchor, it sends on their
    leaders and their pairs with them.  Rows that stay behind are left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, blocks = golay23(), layout(rows)
        patterns = code.patterns(code.covering_radius + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                ids, f = np.asarray(batch.column(0)), np.stack([np.asarray(batch.column(1 + k)).view(np.uint64) for k in range(WIDE)])
                for row, anchor in at_blocks(f, blocks, code, patterns):
                    order = np.lexsort((ids[row], anchor))
                    row, anchor = row[order], anchor[order]
                    a = b = np.empty(0, np.int64)
                    cut = np.zeros(len(row), bool)
                    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                    size = np.diff(np.append(first, len(anchor)))
                    # Only buckets far above the mean are worth combining here.
                    big = np.repeat(size > 16 + 4 * size.mean(), size)
                    if big.any():
                        stay = np.flatnonzero(~big)
                        for some in pieces(np.flatnonzero(big), anchor):
                            i, j, lead, _ = met(some, anchor, f[:, row])
                            behind = np.setdiff1d(some, lead)
                            cut[some] = np.isin(anchor[some], anchor[behind])
                            behind = ids[row[behind]]
                            a, b, stay = np.concatenate([a, ids[row[i]], behind]), np.concatenate([b, ids[row[j]], behind]), np.append(stay, lead)
                        row, anchor, cut = row[stay], anchor[stay], cut[stay]
                    yield _sent(anchor, ids[row], cut, f[:, row], a, b)

    return prints.select("id", *NAMES).mapInArrow(tidy(run), _SENT)


def pieces(at: np.ndarray, anchor: np.ndarray) -> Iterator[np.ndarray]:
    """``at``, rows sorted by anchor, in pieces of whole buckets: of about
    BUCKET rows in all, or one bucket."""
    first = np.flatnonzero(np.append(True, anchor[at][1:] != anchor[at][:-1])) if len(at) else at
    begin = 0
    while begin < len(at):
        next_ = first[min(len(first) - 1, np.searchsorted(first, begin + BUCKET, side="right") - 1)]
        if next_ <= begin:  # a bucket of more rows; or the last one
            k = np.searchsorted(first, begin, side="right")
            next_ = first[k] if k < len(first) else len(at)
        elif len(at) - begin <= BUCKET:
            next_ = len(at)
        yield at[begin:next_]
        begin = next_


def met(at: np.ndarray, anchor: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``leaders`` of a piece, by rows: of a bucket above BUCKET rows each part
    meets the leaders so far only, and all are left open."""
    lead, left, right, out = at[:0], [], [], at
    for begin in range(0, len(at), BUCKET):
        both = np.concatenate([lead, at[begin : begin + BUCKET]])
        i, j, first, some = leaders(anchor[both], f[:, both])
        out = out if len(at) > BUCKET else both[some]
        left.append(both[i])
        right.append(both[j])
        lead = both[first]
    return np.concatenate([at[:0], *left]), np.concatenate([at[:0], *right]), lead, out


def at_anchors(sent: DataFrame) -> DataFrame:
    """Candidate pairs ``a, b``, each once, and which of both is left open
    (``one, two``): it may have others within FAR bits at an anchor which it is
    not paired with.  A row that is open without a pair there is one with itself.

    Rows meet at their anchor in sorted streams, and each is compared with the
    bucket's leaders.  Of a bucket above BUCKET rows only the leaders so far
    are held.
    """

    def pairs(ids, i, j, out) -> pa.RecordBatch:
        a, b = ids[i], ids[j]
        key = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        own, key = np.unique(ids[out]), key[key[:, 0] != key[:, 1]]
        alone = np.setdiff1d(own, key)
        key = np.concatenate([key, np.stack([alone, alone], 1)])
        return pa.record_batch([pa.array(x) for x in (key[:, 0], key[:, 1], np.isin(key[:, 0], own), np.isin(key[:, 1], own))], ["a", "b", "one", "two"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int64, np.int64, bool, *[np.uint64] * WIDE)]

        def compared(some, anchor, ids, cut, f):
            i, j, lead, out = met(some, anchor, f)
            return pairs(ids, i, j, np.append(out, some[np.isin(anchor[some], anchor[some[cut[some]]])])), lead

        for batch in batches:
            done = ~np.asarray(batch.column("other").is_null())
            own = batch.filter(pa.array(done))
            a, b = np.asarray(own.column("id")), np.asarray(own.column("other"))
            yield pairs(np.concatenate([a, b]), np.arange(len(a)), len(a) + np.arange(len(a)), np.flatnonzero(a == b))
            new = batch.filter(pa.array(~done))
            rows = [np.concatenate([x, np.asarray(new.column(k)).view(x.dtype)]) for x, k in zip(held, ("anchor", "id", "cut", *NAMES))]
            anchor, ids, cut, f = rows[0], rows[1], rows[2], np.stack(rows[3:])
            ended = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            for some in pieces(np.arange(ended), anchor):
                yield compared(some, anchor, ids, cut, f)[0]
            rest = np.arange(ended, len(anchor))
            if len(rest) > BUCKET:
                batch, rest = compared(rest, anchor, ids, cut, f)
                cut[rest] = True
                yield batch
            held = [x[rest] for x in rows]
        yield compared(np.arange(len(held[0])), *held[:3], np.stack(held[3:]))[0]

    spread = F.when(F.col("other").isNull(), F.col("anchor")).otherwise(F.xxhash64("id", "other"))
    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(n, spread).sortWithinPartitions("anchor", "id").mapInArrow(tidy(run), "a long, b long, one boolean, two boolean").groupBy("a", "b").agg(F.max("one").alias("one"), F.max("two").alias("two"))


def every_anchor(prints: DataFrame, rows: int) -> DataFrame:
    """Every row of ``prints`` at every anchor, with its ``component``."""
    names = ["id", "component", "many", "common", *NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, blocks = golay23(), layout(rows)
        patterns = code.patterns(code.covering_radius + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                f = np.stack([np.asarray(batch.column(x)).view(np.uint64) for x in NAMES])
                for row, anchor in at_blocks(f, blocks, code, patterns):
                    yield pa.record_batch([pa.array(anchor.view(np.int64)), *batch.take(pa.array(row)).columns], ["anchor", *names])

    return prints.select(*names).mapInArrow(tidy(run), "anchor long, " + ", ".join(f"{x} long" for x in names))


def open_pairs(prints: DataFrame, marks: DataFrame, rows: int, similarity: float, scratch: Scratch) -> DataFrame:
    """All pairs ``a, b``, each once, of ``prints`` that share an anchor, are
    within FAR bits and not in one component, without those whose numbers of
    shingles, in all (``many``) and those that others have too (``common``), or
    whose parities (``marks``; null: unknown) rule the similarity out.  So the
    pairs of a large family whose members are within reach but less similar
    are never made.

    At an anchor the rows of its largest component meet the others only, so a
    family that holds together costs as many comparisons as there are others.
    """
    sent = scratch.keep(every_anchor(prints, rows), "open")
    parts = sent.groupBy("anchor", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("anchor").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    mixed = scratch.keep(mixed.where("parts > 1").drop("parts"), "mixed")
    sent = join_per_key(sent, mixed, "anchor", "n").withColumn("minor", F.col("component") != F.col("major")).drop("major", "n")
    sent = scratch.keep(sent.join(marks.hint("merge"), "id", "left"), "met")
    differing = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in NAMES), F.lit(0))
    least = F.coalesce(differing_marks(F.col("x.marks"), F.col("y.marks")), F.lit(0))
    most = F.least("x.common", "y.common")
    fewer = F.least(most, (F.col("x.many") + F.col("y.many") - least) / 2)
    near = (
        (F.col("x.anchor") == F.col("y.anchor"))
        & (F.col("x.component") != F.col("y.component"))
        & (~F.col("y.minor") | (F.col("x.component") < F.col("y.component")))
        & (differing <= FAR)
        & (most >= similarity * (F.col("x.many") + F.col("y.many") - most))
        & (fewer >= similarity * (F.col("x.many") + F.col("y.many") - fewer))
    )
    both = sent.where("minor").alias("x").join(sent.alias("y").hint("merge"), near)
    return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id`` and the sorted distinct shingle hashes of each row, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, PART):
                sets = [np.unique(h).tobytes() for h in token_hashes(batch.column(1).to_pylist(), size)]
                yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return _texts(docs, id_col, text_col).mapInArrow(tidy(run), "id long, shingles binary")


def own_shingles(sets: DataFrame) -> DataFrame:
    """``id`` and how many of its shingles (``own``) no other row of ``sets``
    has; ids of several rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in zip(batch.column("id").to_pylist(), batch.column("shingles")):
                h = np.frombuffer(packed.as_buffer(), np.int64)
                for at in range(0, len(h), PIECE):
                    part = h[at : at + PIECE]
                    yield pa.record_batch([pa.array(part), pa.array(np.full(len(part), i, np.int64))], ["h", "id"])

    once = sets.mapInArrow(tidy(run), "h long, id long").groupBy("h").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    single = sets.groupBy("id").count().where("count = 1").select("id")
    return once.groupBy("id").agg(F.count(F.lit(1)).alias("own")).join(single.hint("merge"), "id", "left_semi")


def parities(h: np.ndarray) -> np.ndarray:
    """64-bit words of a bitmap, a power of two of them and 2 to 4 bits for each
    of the distinct hashes: a bit is the parity of the hashes that it stands for.
    So bitmaps of two sets differ in no more bits than the sets in hashes, and
    the halves of a bitmap, one XOR the other, are that of half the size."""
    words = max(2, 1 << (max(0, len(h) - 1) >> 5).bit_length())
    odd = np.bincount((h & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def shingle_marks(sets: DataFrame) -> DataFrame:
    """``id`` and the ``parities`` of its shingles (``marks``); ids of several
    rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parities(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column("shingles")]
            yield pa.record_batch([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "marks"])

    marks = sets.mapInArrow(tidy(run), "id long, marks array<long>")
    return marks.groupBy("id").agg(F.first("marks").alias("marks"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def differing_marks(x: Column, y: Column) -> Column:
    """Bits in which two bitmaps of ``parities`` differ, once the larger is
    folded to the smaller's size if it is twice that; null for other sizes."""
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda n, v: n + v)
    folded = lambda a, n: F.zip_with(F.slice(a, 1, n), F.slice(a, n + 1, n), lambda v, w: v.bitwiseXOR(w))
    n, m = F.size(x), F.size(y)
    return F.when(n == m, apart(x, y)).when(n == 2 * m, apart(folded(x, m), y)).when(m == 2 * n, apart(x, folded(y, n)))


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs ``a, b`` those whose shingle sets have that Jaccard similarity
    or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, np.empty(0, np.uint64)
        for batch in batches:
            good = []
            other, one, two = np.asarray(batch.column("b")), batch.column("x"), batch.column("y")
            for k in range(batch.num_rows):
                if last != other[k]:  # pairs of one text follow each other
                    last, y = other[k], np.frombuffer(two[k].as_buffer(), np.uint64).copy()
                x = np.frombuffer(one[k].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x, y = (sets.select(F.col("id").alias(i), F.col("shingles").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``node, component`` of rows whose text is in a near-duplicate group:
    linked by a Jaccard similarity of distinct ``size``-word shingles of
    ``similarity`` or more, verified on the whole texts.

    Candidates share an anchor of the Golay code on one of ``layout``'s blocks
    of a 192-bit SimHash, within radius 3 + 1 on either side: a pair at
    similarity 0.8 does with probability ``1 - MISSED``.  All rows of an anchor
    are compared; each goes on with the nearest leader and the nearest rows
    there, and with others at other anchors, so groups of any size cost a few
    pairs to each row and hold together by them.  Rows that have further ones
    within FAR bits meet once more, with all whose component is another one by
    then; so no candidate pair is left whose link would join two components.
    Bounds on the shared shingles rule most of those out where they meet.
    Rows are named by id: rows with the same id are one, similar if one of their texts is; rows
    without an id are in no group.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    prints = scratch.keep(wide_fingerprints(rows, id_col, text_col, size), "wide")
    total = prints.count()

    def sets_of(wanted: DataFrame, table: str) -> DataFrame:
        some = rows.join(wanted.hint("merge"), F.col(id_col).cast("long") == F.col("wanted_id"), "left_semi")
        return scratch.keep(shingle_sets(some, id_col, text_col, size), table)

    met_ = scratch.keep(at_anchors(to_anchors(prints, total)), "pairs")
    pairs = met_.where("a != b").select("a", "b")
    left = scratch.keep(met_.where("one").select(F.col("a").alias("id")).unionByName(met_.where("two").select(F.col("b").alias("id"))).distinct(), "left")
    wanted = pairs.select(F.col("a").alias("wanted_id")).unionByName(pairs.select(F.col("b").alias("wanted_id"))).distinct()
    links = scratch.keep(similar_pairs(pairs, sets_of(wanted, "sets"), similarity), "links")
    scratch.drop("sets")
    parts = connected_components(links, scratch)
    if left.isEmpty():
        return parts
    parts = scratch.keep(parts, "parts")
    sets = sets_of(left.withColumnRenamed("id", "wanted_id"), "sets-rest")
    own = scratch.keep(own_shingles(sets), "own")
    named = prints.join(left.hint("merge"), "id", "left_semi").join(parts.hint("merge"), F.col("id") == F.col("node"), "left")
    named = named.join(own.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"), "many", (F.col("many") - F.coalesce("own", F.lit(0))).alias("common"), *NAMES)
    rest = scratch.keep(open_pairs(named, shingle_marks(sets), total, similarity, scratch).join(pairs.hint("merge"), ["a", "b"], "left_anti"), "pairs-rest")
    scratch.drop("open", "met")
    if rest.isEmpty():
        return parts
    more = scratch.keep(similar_pairs(rest, sets, similarity), "links-rest")
    scratch.drop("sets-rest")
    if more.isEmpty():
        return parts
    stars = parts.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(stars.unionByName(more), scratch)


def keep_one_of_each_group(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose near-duplicate
    group has a smaller id.  Rows without an id stay."""
    groups = near_duplicates(docs, scratch, id_col, text_col, size, similarity)
    name = unused(docs, "dropped")
    dropped = groups.where("node != component").select(F.col("node").alias(name))
    return docs.join(dropped.hint("merge"), F.col(id_col).cast("long") == F.col(name), "left_anti")
