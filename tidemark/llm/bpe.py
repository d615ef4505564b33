"""Byte-level BPE in batches: merge rounds over many words at once in numpy.

The symbols of all new words of a batch lie in one flat array.  Each round
looks up every neighbouring pair by binary search in the sorted pair keys,
takes each word's lowest rank and merges all its places from left to right.
Words without a known pair leave the array.

Defined cases: a null text counts as empty and has no tokens.  The special
tokens' strings in a text are these tokens, as the tokenizers library has it by
default.  Texts of any length are cut between words into pieces of bounded
size.  Rows with equal texts or ids are rows of their own; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, tidy

#: How byte-level pre-tokenizers cut a text; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode's white space, and chunks: white space and what follows up to the
#: next.  No word of the pattern goes on from other characters to white space,
#: and what it takes of white space depends on what comes before within a chunk.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
#: Chunks kept between batches, words merged and tokens decoded at a time.
CACHE, WORDS, TOKENS = 600_000, 100_000, 1 << 20
#: Bytes of text that are cut into words at a time.
PART = 4 << 20
#: Longer words aren't kept.
LONG = 64


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if
    printable in Latin-1, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE vocabulary from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(tokens) + 1
        parts = [tokens.get(i, b"") for i in range(size)]
        self.length = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        # The symbols of a word's last byte, where words end in a suffix.
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.end_id = np.array([vocab[c + suffix] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.order = np.argsort(key, kind="stable")  # rank of each sorted key
        self.keys, self.made = key[self.order], made
        self.cut = regex.compile(PATTERN)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def ranks(self, sym: np.ndarray, inside: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pairs that begin at these places; the number of merges
        for no such pair."""
        none = len(self.order)
        out = np.full(len(at), none)
        pair = np.flatnonzero(inside[at])
        left = at[pair]
        key = sym[left] << 32 | sym[left + 1]
        found = np.minimum(np.searchsorted(self.keys, key), none - 1)
        out[pair] = np.where(self.keys[found] == key, self.order[found], none)
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, last = self.byte_id[raw], np.cumsum(sizes) - 1
        sym[last] = self.end_id[raw[last]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        none = len(self.order)
        inside = np.append(word[1:] == word[:-1], False)[: len(sym)]
        rank = self.ranks(sym, inside, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.append(True, ~inside[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            over = best == none
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            hit = (rank == best) & ~over
            # Of touching places (the same symbol in a row) every other one.
            place = np.arange(len(sym))
            hit &= (place - np.maximum.accumulate(np.where(hit, -1, place))) % 2 == 1
            sym[hit] = self.made[rank[hit]]
            gone = np.append(False, hit[:-1])
            inside[hit] = inside[np.flatnonzero(hit) + 1]
            stay = ~over & ~gone
            new = np.flatnonzero(hit[stay])
            sym, word, inside, rank = sym[stay], word[stay], inside[stay], rank[stay]
            # Only the pairs that hold a new symbol have another rank.
            mark = np.zeros(len(sym), bool)
            mark[new] = mark[new[new > 0] - 1] = True
            touched = np.flatnonzero(mark)
            rank[touched] = self.ranks(sym, inside, touched)
        if not done_sym:
            return [b""] * len(words)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        sym = sym[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return [sym[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks: their words are merged together."""
        cut = [(c, self.cut.findall(c)) for c in chunks]
        words = list({w for _, ws in cut for w in ws})
        ids: dict[str, bytes] = {}
        for at in range(0, len(words), WORDS):
            part = words[at : at + WORDS]
            ids.update(zip(part, self.merge([w.encode() for w in part])))
        return {c: b"".join([ids[w] for w in ws]) for c, ws in cut}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        special, known = self.special, self.known
        parts = [[p if p in special else CHUNK(p) for p in (self.apart.split(t) if special else [t])] for t in texts]
        every: set[str] = set()
        for text in parts:
            for p in text:
                if type(p) is list:
                    every.update(p)
        new = every.difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = every
        ids = self.learn(new)
        known.update((w, i) for w, i in ids.items() if len(w) <= LONG)
        look = {w: i for w, i in ids.items() if len(w) > LONG}
        out = []
        for text in parts:
            made = [special[p].to_bytes(4, "little") if type(p) is str else b"".join([known[w] if w in known else look[w] for w in p]) for p in text]
            out.append(b"".join(made))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode_bytes(self, ids: bytes) -> Iterator[bytes]:
        """The bytes that the ids stand for, piece by piece."""
        every = np.frombuffer(ids, "<u4")
        for at in range(0, len(every), TOKENS):
            part = every[at : at + TOKENS]
            n = self.length[part]
            shift = np.repeat(self.start[part] - (np.cumsum(n) - n), n)
            yield self.blob[shift + np.arange(len(shift))].tobytes()

    def decode(self, ids: bytes) -> str:
        return b"".join(self.decode_bytes(ids)).decode("utf-8", "replace")


def pieces(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of up to about ``size`` bytes of text (column 1), a row at least."""
    sizes = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(batch.column(1)).cast(pa.float64()))))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size)))
        yield batch.slice(at, end - at)
        at = end


@functools.lru_cache(2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` of every row: its token ids as packed 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        HELD["bpe"] = bpe.known.clear
        for batch in batches:
            for part in pieces(batch, PART):
                ids = bpe.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, "bpe"), "id long, ids binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row: digests of its
    ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, a, b = [], [], []
            for ids in batch.column(1):
                ids = ids.as_py()
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_documents(docs, path, id_col, text_col).mapInArrow(tidy(run, "bpe"), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
