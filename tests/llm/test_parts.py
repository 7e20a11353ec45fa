"""Parts of texts that encode separately: right at every place, and few of them."""

import base64

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from fieldmark.llm import bpe, pretokens, tokenfile

SYMBOLS = [*"ab  \n\t\r'stVLÉé1² 你 　\u001f\u0085    ​﻿😀.,;:!?-ßà“—", "\r\n", " the", "don't ", "\n\n", ". ", "<|endoftext|>"]


def random_texts(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(SYMBOLS, rng.integers(0, 30))) for _ in range(n)]


class Counting:
    """A tokenizer that counts the texts and letters it is given."""

    def __init__(self, inner):
        self.inner, self.texts, self.letters = inner, 0, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        self.letters += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("limit", [0, 20_000, 1 << 24])
def test_library_ids_of_many_texts(limit, monkeypatch):
    monkeypatch.setattr(pretokens, "TOGETHER", 400)
    monkeypatch.setattr(pretokens, "GATHERED", 7)
    monkeypatch.setattr(tokenfile, "JOINED", 5)
    whole = Tokenizer.from_file(tokenfile.VOCABULARY)
    encoder = tokenfile.LibraryEncoder(tokenfile.VOCABULARY)
    encoder.parts.clear(limit)
    for seed in range(4):
        texts = random_texts(400, seed)
        got = list(encoder.encode(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(encoder.encode([])) == [] and list(encoder.encode(["", ""])) == [b"", b""]


def test_library_sees_words_in_rows():
    """Distinct words reach the library many in a row and once for all texts of a batch, also where nothing is remembered."""
    encoder = tokenfile.LibraryEncoder(tokenfile.VOCABULARY)
    encoder.parts.clear(0)
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in ("ama", "iri", "ungo") for c in "mnprstvwxz"]
    texts = [" ".join(w + stop for w in words) for stop in ("", ",", ".", ";") for _ in range(200)]
    assert len(list(encoder.encode(texts))) == 800
    assert counting.texts <= 12
    assert counting.letters <= 4 * sum(len(w) + 2 for w in words)


def test_texts_stay_whole_where_the_vocabulary_asks_for_more(tmp_path):
    """A vocabulary with another first step encodes as the library does."""
    from tokenizers import pre_tokenizers

    other = Tokenizer.from_file(tokenfile.VOCABULARY)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)
    other.save(path := str(tmp_path / "other.json"))
    texts = ["in the end.\nAnd so on", " of the, with the", *random_texts(50, 9)]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokenfile.LibraryEncoder(path).encode(texts)]
    assert got == [other.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("limit", [0, 20_000, 1 << 24])
def test_own_ids_of_many_texts(limit, monkeypatch):
    monkeypatch.setattr(pretokens, "TOGETHER", 400)
    monkeypatch.setattr(pretokens, "GATHERED", 7)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.codec(memo=limit)
    for seed in range(4):
        texts = random_texts(400, seed)
        got = list(codec.parts.encode(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode_ordinary(t) for t in texts]
        assert [codec.decode(x) for x in got] == [t.encode() for t in texts]
    assert codec.parts.memo.room >= 0


def test_a_word_merges_once(monkeypatch):
    """Whatever stops follow it and however many texts hold it, also where nothing is remembered."""
    codec, seen = bpe.codec(memo=0), []
    monkeypatch.setattr(codec, "merge", lambda piece, inner=codec.merge: seen.append(piece) or inner(piece))
    words = [f"zx{a}qq{b}vw" for a in "bdfgkl" for b in "mnprstvwxz"]
    texts = [" ".join(w + stop for w in words) + "\nAnd" for stop in ("", ",", ".", ";", ".\n") for _ in range(100)]
    assert len(list(codec.parts.encode(texts))) == 500
    assert len(seen) <= 2 * len(words) + 10
