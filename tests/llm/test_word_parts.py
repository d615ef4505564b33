"""Operator 6's tokenizer: each part of a word is merged once, whatever words
hold it, with the library's ids."""

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def merged(monkeypatch):
    """What the numpy rounds were given."""
    seen, plain = [], bpe.ByteBpe.merge
    monkeypatch.setattr(bpe.ByteBpe, "merge", lambda self, words: seen.extend(words) or plain(self, words))
    return seen


def test_parts_of_known_words_are_not_merged_again(merged):
    tokenizer = packing.WordTokenizer(PATH)
    tokenizer.encode_batch(["thanheit reation", "entlich & ., !"])
    assert sorted(merged) == sorted([b"thanheit", b"reation", b"entlich", b"&", b".,", b"!"])
    merged.clear()
    # Other words of the same parts, in the next batch.
    tokenizer.encode_batch(["Thanheit&REATION thanheit! entlich., (reation", "Entlich&"])
    assert merged == [b"("]


def test_batches_have_the_librarys_ids(monkeypatch):
    from tokenizers import Tokenizer

    lib, tokenizer = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    monkeypatch.setattr(packing, "CACHE", 300)
    rng = np.random.default_rng(3)
    some = [*"sStTmMdDrReEvVlLaZ09'''\"&.<|> \t\n\v\f\r\x00\x1c\x7f\x85\xa0éÉß×÷ÿ́Kſİ中　😀", "<|endoftext|>", "'LL", "I've", "  "]
    for n in [0, 1, 2, 40] * 25:
        texts = ["".join(rng.choice(some, rng.integers(0, 30))) for _ in range(n)]
        got = [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode_batch(texts)]
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(tokenizer.known) < 2000
