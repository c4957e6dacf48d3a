"""BPE against the library that defines the ids, and its round trip."""

import random

import public_tokenizers
import pytest
import tiktoken

from made import documents  # noqa: F401

from visitloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def samples():
    rnd = random.Random(11)
    alphabets = ["ab", "a", "xyzé", "日本語", "<|end|> \n\t'sve", "0123456789", "!!%$#", "😀a", " \x1c\x85\xa0", "eiou", "\n\n  a"]
    for _ in range(1500):
        chars = "".join(rnd.sample(alphabets, rnd.randint(1, 3)))
        yield "".join(rnd.choice(chars) for _ in range(rnd.choice([0, 3, 20, 90, 700])))
    yield from ["", "a" * 40_000, "ab" * 9_000, "word " * 20_000, " " * 5_000, "é" * 3_000]


def test_ids_equal_the_library(encoder, library):
    for text in samples():
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text), text[:80]
        assert encoder.decode(ids) == text.encode()


def test_halves_join_at_any_place(encoder):
    rnd = random.Random(2)
    for _ in range(400):
        data = "".join(rnd.choice(["the", "ing", "tion", "a", "zz", "é"]) for _ in range(rnd.randint(2, 30))).encode()
        cut = rnd.randrange(1, len(data))
        assert encoder.join(encoder.leaf(data[:cut]), encoder.leaf(data[cut:])) == encoder.leaf(data)


def test_every_token_is_its_own_encoding(encoder):
    assert all(encoder.leaf(t) == [r] for t, r in list(encoder.ranks.items())[::7])


def test_columns(documents, library):
    texts = ["Hello there, world's end", "", None, "x" * 5000, "Hello there, world's end"]
    docs = documents(*enumerate(texts), ids="old", IDS2="kept")
    encoded = bpe.encode(docs, PATH)
    assert set(encoded.columns) == set(docs.columns)
    both = {r.doc_id: (r.ids, bytes(r.bytes), r.IDS2) for r in bpe.decode(encoded, PATH).collect()}
    assert both == {i: (library.encode_ordinary(t or ""), (t or "").encode(), "kept") for i, t in enumerate(texts)}
    assert bpe.encode(documents(), PATH).collect() == []
