"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from visitloom.llm.common import text_bytes

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE, STEP = 0x100000001B3, 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def lower_table() -> np.ndarray:
    """A-Z to lower case, per byte."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return lower


def alphanumeric() -> np.ndarray:
    """Per byte: digits, letters and all beyond ASCII."""
    member = np.zeros(256, dtype=bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        member[a:b] = True
    return member


def visible() -> np.ndarray:
    """Per byte: all but ASCII white space."""
    member = np.ones(256, dtype=bool)
    member[9:14] = member[32] = False
    return member


class Words:
    """Words of a block of texts: byte ranges, hashes, and the first word of each text."""

    def __init__(self, values: pa.Array, member: np.ndarray):
        data, begins = text_bytes(values)
        self.data, self.bytes, self.begins = data, lower_table()[data], begins
        inside = member[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[begins] = True
        first = inside & np.concatenate(([True], ~inside[:-1])) if len(data) else inside
        first |= inside & edge[:-1]
        last = inside & np.concatenate((~inside[1:], [True])) if len(data) else inside
        last |= inside & edge[1:]
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, begins)
        if len(self.start):
            place = np.arange(len(data)) - np.repeat(
                np.concatenate(([0], self.start)), np.diff(np.concatenate(([0], self.start, [len(data)])))
            )
            longest = int((self.stop - self.start).max())
            power = powers(BASE, longest + 1)
            spread = np.where(inside, (self.bytes.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, longest)], 0)
            self.hash = mixed(np.add.reduceat(spread, self.start))
        else:
            self.hash = np.zeros(0, dtype=np.uint64)
