"""Byte-level BPE encoding as a tree reduction, and decoding."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from visitloom.llm.common import add_columns

#: Up to so many bytes are merged directly, and so many ids decoded; longer pieces and lists are halved.
LEAF, IDS = 16, 64
#: Pieces whose ids a task remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 64
NO_RANK = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 of the bytes, blank, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def fast_pattern(pattern: str) -> re.Pattern:
    """The same split as ``pattern`` on texts of the Basic Multilingual Plane.

    The properties are written out as ranges, taken from the library that
    defines them, so that the plain ``re`` engine can run it.
    """
    plane = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))

    def ranges(of: str) -> str:
        found: list[list[int]] = []
        for c in map(ord, regex.findall(of, plane)):
            if found and found[-1][1] == c - 1:
                found[-1][1] = c
            else:
                found.append([c, c])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in found)

    letters, numbers, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    inside = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": space}
    out = pattern.replace(r"(?!\S)", f"(?![^{space}])")
    out = re.sub(r"\[\^?(?:\\s|\\p\{[LN]\})+\]", lambda m: re.sub(r"\\s|\\p\{[LN]\}", lambda p: inside[p[0]], m[0]), out)
    done = re.sub(r"(?<!\[)(\\s|\\p\{[LN]\})(?=\+)", lambda p: f"[{inside[p[0]]}]", out)
    return re.compile(done)


class Encoder:
    """Ids of texts under ranks, the same as merging by lowest rank, leftmost first.

    A sequence of tokens is the encoding of its bytes if and only if each two
    neighbours are the encoding of their joint bytes. So encodings of two parts
    join by re-encoding a window at the seam, which grows until the tokens at
    its edges fit the tokens outside.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = list(map(str, range(len(self.tokens))))
        self.slow, self.fast = regex.compile(pattern), fast_pattern(pattern)
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.known: dict[str, tuple[int, ...]] = {}
        self.fits = lru_cache(1 << 16)(self._fits)

    def leaf(self, data: bytes) -> list[int]:
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        order = [get(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while order:
            lowest = min(order)
            if lowest == NO_RANK:
                break
            i = order.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i < len(order):
                order[i] = get(parts[i] + parts[i + 1], NO_RANK)
            if i:
                order[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
        return [self.ranks[p] for p in parts]

    def _fits(self, a: int, b: int) -> bool:
        return self.leaf(self.tokens[a] + self.tokens[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings, one after the other."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            window = left[-width:] + right[:width]
            middle = self.leaf(b"".join(map(self.tokens.__getitem__, window)))
            before, after = left[:-width], right[width:]
            if (not before or self.fits(before[-1], middle[0])) and (not after or self.fits(middle[-1], after[0])):
                return before + middle + after
            width *= 2

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece: of its halves, joined."""
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        if len(data) <= LEAF:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def encode(self, text: str | None) -> list[int]:
        """Pieces never merge with each other, so their ids are only put together."""
        if not text:
            return []
        pieces = (self.slow if self.beyond.search(text) else self.fast).findall(text)
        known = self.known
        for piece in set(pieces).difference(known):
            if len(piece) <= LONGEST:
                known[piece] = tuple(self.piece(piece.encode()))
        if all(map(known.__contains__, pieces)):
            ids = list(chain.from_iterable(map(known.__getitem__, pieces)))
        else:
            ids = list(chain.from_iterable(known.get(p) or self.piece(p.encode()) for p in pieces))
        if len(known) > REMEMBERED:
            known.clear()
        return ids

    def decode(self, ids: list[int] | None) -> bytes:
        """Bytes of the ids: those of their halves, one after the other."""
        if not ids:
            return b""
        if len(ids) <= IDS:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encoders(path: str, pattern: str) -> Callable[[], Encoder]:
    """Maker of one encoder per task. The file, of bounded size, is read by the driver only."""
    ranks, made = read_ranks(path), []

    def encoder() -> Encoder:
        if not made:
            made.append(Encoder(ranks, pattern))
        return made[0]

    return encoder


def encode(
    docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", name: str = "ids"
) -> DataFrame:
    """``docs`` with the token ids of a text column, without special tokens.

    Null and empty texts have an empty array. A column of the same name is
    replaced; all rows, repeated ones too, and all other columns stay.
    """
    encoder = encoders(path, pattern)
    return add_columns(
        docs, text, {name: "array<int>"}, lambda texts: [list(map(encoder().encode, texts.to_pylist()))]
    )


def decode(
    docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids", name: str = "bytes"
) -> DataFrame:
    """``docs`` with the bytes that the token ids of a column stand for; null and no ids: no bytes."""
    encoder = encoders(path, pattern)
    return add_columns(
        docs, ids, {name: "binary"}, lambda lists: [list(map(encoder().decode, lists.to_pylist()))]
    )


def round_trip(
    docs: DataFrame,
    path: str,
    types: dict[str, str],
    derive: Callable[[Encoder, list[int], bytes], tuple],
    pattern: str = public_tokenizers.PATTERN,
    text: str = "text",
) -> DataFrame:
    """``docs`` with what ``derive`` makes of the ids of each text and the bytes decoded from them.

    For uses that need only a small part of the ids: they then never leave the
    task. Null and empty texts have no ids and no bytes. All rows, repeated ones
    too, stay with their other columns; columns named like the new ones are replaced.
    """
    encoder = encoders(path, pattern)

    def make(texts: pa.Array) -> list[list]:
        own = encoder()
        found = []
        for text_ in texts.to_pylist():
            ids = own.encode(text_)
            found.append(derive(own, ids, own.decode(ids)))
        return [list(x) for x in zip(*found)] if found else [[] for _ in types]

    return add_columns(docs, text, types, make)
