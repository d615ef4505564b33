"""Packing documents into sequences by first-fit decreasing.

Documents are tokenized and cut into pieces of at most the sequence length;
pieces are dealt at random into groups, and each group packs its pieces, from
the longest on, into the first sequence with room.  That sequence is found by a
tournament tree whose nodes hold the largest room below them.

Defined cases: a null text counts as empty; an empty document has one token,
the separator.  Rows with equal texts or ids are documents of their own.  A
longer document is cut into full sequences and a rest.  An empty table gives an
empty result.  Other columns are ignored.  Pieces depend on nothing but their
document, and groups on nothing but the number of pieces and a seed.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import HELD, Scratch, slices, tidy

#: Pieces of a group on average, parts of words kept between batches, the longest
#: part kept, and bytes of text split at a time.
GROUP, CACHE, LONG, PART = 8192, 1_000_000, 64, 8 << 20
#: How the tokenizer cuts words; a fixed value.  ``WordTokenizer.cut`` is the same
#: for plain words: ASCII and Latin-1 letters, whose normal form is themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes: ASCII white space, of letters, digits, marks, and what a plain
#: word doesn't have.  Latin-1 letters are C3 and another byte; C3 97 and C3 B7
#: are no letters.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
KIND = bytearray([ODD] * 256)
KIND[0x21:0x7F] = bytes([MARK] * 0x5E)
KIND[0x80:0xC0] = bytes([LETTER] * 0x40)
for _bytes, _kind in ((b" \t\n\v\f\r", SPACE), (b"\x97\xb7", ODD), (b"0123456789", DIGIT), (b"\xc3" + bytes([*range(65, 91), *range(97, 123)]), LETTER)):
    for _byte in _bytes:
        KIND[_byte] = _kind
#: Lower case of the bytes of plain words.
LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))


class WordTokenizer:
    """Ids by the tokenizers library, word by word.

    Only for tokenizers that drop white space before anything else looks past
    it, so that words between ASCII white space have the same ids alone as in
    the text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        # The numpy rounds know this one way of cutting words.
        self.merger = bpe.ByteBpe(path) if PATTERN in pattern else None
        self.kind = bytes(KIND) if self.merger else bytes(SPACE if k == SPACE else ODD for k in KIND)
        self.known: dict[bytes, bytes] = {}

    def cut(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The parts of a text that ends in white space: where they begin in it,
        their bytes one after the other, where they begin there, and which are
        words of other bytes than plain ones or with the mark of a special token.
        These are whole; plain words are lower-cased and cut."""
        text, low = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(LOWER), np.uint8)
        kind = np.frombuffer(raw.translate(self.kind), np.uint8)
        word = kind != SPACE
        begin = np.append(True, kind[1:] != kind[:-1])[: len(kind)]
        begin |= kind == DIGIT
        begin &= word
        # A mark that begins a part may begin one of the short endings.
        at = np.flatnonzero(text == ord("'"))
        at = at[begin[at]]
        one, two = low[at + 1], low[np.minimum(at + 2, len(low) - 1)]
        short = np.isin(one, list(b"stmd"))
        long = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begin[at[short | long] + 1] = False
        for after in (at[short] + 2, at[long] + 3):
            begin[after] |= kind[after] == LETTER
        odd = np.flatnonzero(kind == ODD)
        if b"<|" in raw:
            odd = np.union1d(odd, np.flatnonzero((text[:-1] == ord("<")) & (text[1:] == ord("|"))))
        whole = np.zeros(0, np.int64)
        if len(odd):
            gaps = np.append(-1, np.flatnonzero(~word))
            right = np.searchsorted(gaps, odd)
            right = right[np.append(True, right[1:] != right[:-1])]
            whole = gaps[right - 1] + 1
            inside = np.zeros(len(text), np.int8)
            inside[whole], inside[gaps[right]] = 1, -1
            inside = np.cumsum(inside, dtype=np.int8).view(bool)
            begin[inside] = False
            begin[whole] = True
            low = np.where(inside, text, low)
        place = np.flatnonzero(begin)
        other = np.zeros(len(place), bool)
        other[np.searchsorted(place, whole)] = True
        return place, low[word], np.flatnonzero(begin[word]), other

    def learn(self, parts: list[bytes], other: list[bool]) -> list[bytes]:
        """Ids of parts.  Those of plain words are merged together by the numpy
        rounds, with the library's ids; the library itself encodes all others."""
        plain, rest = [p for p, o in zip(parts, other) if not o], [p for p, o in zip(parts, other) if o]
        ids: list[bytes] = []
        for at in range(0, len(plain), bpe.WORDS):
            ids += self.merger.merge(plain[at : at + bpe.WORDS])
        made = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)]
        ids, made = iter(ids), iter(made)
        return [next(made) if o else next(ids) for o in other]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        known, raw = self.known, [t.encode() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in raw])
        place, data, first, other = self.cut(b" ".join([*raw, b""]))
        buffers = [None, pa.py_buffer(np.append(first, len(data))), pa.py_buffer(data)]
        found = pa.Array.from_buffers(pa.large_binary(), len(first), buffers).dictionary_encode()
        every, which = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        ids = list(map(known.get, every))
        new = [i for i, x in enumerate(ids) if x is None]
        if len(known) + len(new) > CACHE:
            # What this batch uses stays: the parts that are common.
            known.clear()
            known.update((p, x) for p, x in zip(every, ids) if x is not None)
        alone = np.zeros(len(every), bool)
        alone[which[other]] = True
        for i, x in zip(new, self.learn([every[i] for i in new], alone[new].tolist())):
            ids[i] = x
            if len(every[i]) <= LONG:
                known[every[i]] = x
        size = np.array([len(x) for x in ids], np.int64) // 4
        start, size = (np.cumsum(size) - size)[which], size[which]
        upto = np.append(0, np.cumsum(size))
        tokens = np.frombuffer(b"".join(ids), "<u4")[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        upto = (4 * upto[np.searchsorted(place, ends)]).tolist()
        return [tokens[a:b] for a, b in zip([0, *upto], upto)]


@functools.lru_cache(2)
def loaded(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut_documents(docs: DataFrame, path: str, length: int, separator: int, with_ids: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: ``id, tag, start, length, ids_crc32, doc_tokens`` and,
    if asked for, the packed ``ids``.  ``tag`` tells rows apart."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        HELD["packing"] = tokenizer.known.clear
        for whole in batches:
            for batch in slices(whole, PART):
                rows: list[tuple] = []
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for i, ids in enumerate(tokenizer.encode_batch(texts)):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, length):
                        piece = ids[4 * at : 4 * (at + length)]
                        rows.append((i, at, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else b""))
                row, start, size, crc, total, kept = zip(*rows)
                own = batch.take(pa.array(row))
                columns = [own.column("id"), own.column("tag"), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
                names = ["id", "tag", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.record_batch(columns, names)

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("tag"), F.col(text_col).cast("string").alias("text")
    )
    schema = "id long, tag long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return rows.mapInArrow(tidy(run, "packing"), schema)


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, items taken from the largest on (ties in
    their order)."""
    leaves = 1 << max(1, (len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def padded(used: Column, length: int) -> Column:
    """Sequences are padded to ``length``, except at a power of two."""
    power = used.cast("long").bitwiseAND(used.cast("long") - 1) == 0
    return F.when(power, used.cast("long")).otherwise(F.lit(length).cast("long"))


def pack(docs: DataFrame, path: str, scratch: Scratch, length: int = 4096, separator: int = 2, seed: int = 7, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: where it lies in which sequence, and how long that is
    before and after padding (``sequence_tokens, padded_tokens``)."""
    pieces = scratch.keep(cut_documents(docs, path, length, separator, with_ids, id_col, text_col), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("tag", "start", F.lit(seed)), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("tag", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_pylist(), length)
        bins, offsets = np.array(bins, np.int64), np.array(offsets, np.int64)
        used = np.bincount(bins, weights=np.asarray(table["length"])).astype(np.int64)
        number = bins + (table["group"][0].as_py() << 32)
        table = table.drop_columns(["group"])
        for name, x in (("sequence_id", number), ("offset", offsets), ("sequence_tokens", used[bins])):
            table = table.append_column(name, pa.array(x))
        return table

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, sequence_tokens long"
    return dealt.groupBy("group").applyInArrow(run, schema).withColumn("padded_tokens", padded(F.col("sequence_tokens"), length))
