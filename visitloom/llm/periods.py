"""Periodic runs of words: recompression into a run-length grammar, whose LCE queries extend grid candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from visitloom.llm.common import add_columns
from visitloom.llm.words import mixed

#: A run has at least so many words, and repeats its period at least so many times.
LEAST_WORDS, REPEATS = 6, 4
#: Grid positions that are compared at a time.
CHUNK = 1 << 20
#: Rounds of block and pair compression at most; queries are right with any number.
ROUNDS = 64


class Level:
    """One sequence of the grammar: where each symbol starts, its name, and how often it repeats from there on."""

    def __init__(self, start: np.ndarray, symbol: np.ndarray):
        self.start, self.symbol = start, symbol
        last = np.flatnonzero(np.append(symbol[1:] != symbol[:-1], True))
        index = np.arange(len(symbol))
        self.rest = last[np.searchsorted(last, index)] + 1 - index

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that start at the places, and whether one does."""
        index = np.minimum(np.searchsorted(self.start, place), len(self.start) - 1)
        return index, self.start[index] == place

    def step(self, i: np.ndarray, j: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Moves the live pairs of places over equal symbols; the pairs that moved, and those that did not."""
        a, b = self.at(i[live])[0], self.at(j[live])[0]
        same = self.symbol[a] == self.symbol[b]
        moved, a, b = live[same], a[same], b[same]
        over = np.minimum(self.rest[a], self.rest[b])
        i[moved], j[moved] = self.start[a + over], self.start[b + over]
        return moved, live[~same]


def named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Equal pairs of numbers get equal names, different ones different names."""
    return np.unique((first.astype(np.int64) << 32) | second, return_inverse=True)[1]


def grammar(words: np.ndarray, fence: np.ndarray) -> list[Level]:
    """Levels of the run-length grammar, the words first.

    Rounds alternate: equal neighbours become one symbol with their number
    (block compression), then symbols fall into two halves by a hash and a
    neighbour pair of left and right half becomes one (pair compression). Both
    depend on the symbols alone, so equal stretches are cut alike except near
    their ends. ``fence`` marks symbols between texts, each unlike all others,
    which stay single.
    """
    levels = [Level(np.arange(len(words)), words)]
    for number in range(ROUNDS):
        before = len(levels[-1].start)
        old = levels[-1]
        heads = np.flatnonzero(np.append(True, old.symbol[1:] != old.symbol[:-1]))
        if len(heads) < before:
            levels.append(Level(old.start[heads], named(old.symbol[heads], old.rest[heads])))
            fence, old = fence[heads], levels[-1]
        odd = (mixed(old.symbol.astype(np.uint64) + np.uint64(number << 32)) & np.uint64(1)).astype(bool)
        left = np.append(~odd[:-1] & odd[1:] & ~fence[:-1] & ~fence[1:], False)
        heads = np.flatnonzero(~np.append(False, left[:-1]))
        if len(heads) < len(old.start):
            second = np.where(left, np.append(old.symbol[1:], 0) + 1, 0)
            levels.append(Level(old.start[heads], named(old.symbol[heads], second[heads])))
            fence = fence[heads]
        if np.count_nonzero(~fence) <= np.count_nonzero(fence):
            break
    return levels


def backwards(levels: list[Level], n: int) -> list[Level]:
    """The same grammar read from the end; a place there is counted from the end."""
    return [Level(n - np.append(x.start[1:], n)[::-1], x.symbol[::-1]) for x in levels]


def common(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common extension: how many words from each place of ``i`` on equal those from ``j`` on.

    A pair of places goes over equal symbols until both are symbol starts of
    the next level and rises there, which local cuts make a few steps a level.
    At the first difference it descends again; words settle the rest.
    """
    begin, i, j = i, i.copy(), j.copy()
    stopped = np.zeros(len(i), dtype=np.int64)
    rising = np.arange(len(i))
    for depth, level in enumerate(levels):
        live, risen = rising, [rising[:0]]
        while len(live):
            if depth + 1 < len(levels):
                both = levels[depth + 1].at(i[live])[1] & levels[depth + 1].at(j[live])[1]
                risen.append(live[both])
                live = live[~both]
            live, ended = level.step(i, j, live)
            stopped[ended] = depth
        rising = np.concatenate(risen)
    for depth in range(len(levels) - 2, -1, -1):
        live = np.flatnonzero(stopped > depth)
        while len(live):
            live = levels[depth].step(i, j, live)[0]
    return i - begin


def grid(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of all texts: text, place and period.

    For each period q the multiples of q within a text are looked at. A run of
    4 q words has four of them in a row, with equal words; nothing else can be
    a run. A text of n words has about n ln n such places.
    """
    periods = size // REPEATS
    text = np.repeat(np.arange(len(size)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    places = (size[text] - 1) // period - (REPEATS - 2)
    ends = np.cumsum(places)
    found = []
    for at in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        number = np.arange(at, min(at + CHUNK, int(ends[-1])))
        pair = np.searchsorted(ends, number, side="right")
        place = begin[text[pair]] + (number - (ends[pair] - places[pair])) * period[pair]
        for times in range(1, REPEATS):
            same = words[place] == words[place + times * period[pair]]
            place, pair = place[same], pair[same]
        found.append((text[pair], place, period[pair]))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def runs(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of texts that stand one after the other: text, start in it, length and smallest period."""
    begin = np.cumsum(size) - size
    text, place, period = grid(words, begin, size)
    kept, text = np.unique(text, return_inverse=True)
    # the texts that have candidates, with fences around each
    starts = np.cumsum(size[kept] + 1) - size[kept]
    n = int(size[kept].sum()) + len(kept) + 1
    fence = np.zeros(n, dtype=bool)
    fence[0] = True
    fence[starts + size[kept]] = True
    fenced = np.empty(n, dtype=np.int64)
    inside = np.arange(n - len(kept) - 1) - np.repeat(np.cumsum(size[kept]) - size[kept], size[kept])
    fenced[~fence] = words[np.repeat(begin[kept], size[kept]) + inside]
    fenced[fence] = (int(words.max()) + 1 if len(words) else 0) + np.arange(len(kept) + 1)
    place = place - begin[kept][text] + starts[text]

    levels = grammar(fenced, fence) if len(place) else []
    ahead = common(levels, place, place + period) if len(place) else place
    back = common(backwards(levels, n), n - place, n - place - period) if len(place) else place
    first, last = place - back, place + period + ahead
    enough = last - first >= np.maximum(LEAST_WORDS, REPEATS * period)
    text, first, last, period = text[enough], first[enough], last[enough], period[enough]
    # several periods give one stretch: all are multiples of the smallest, which finds it too
    order = np.lexsort((period, last, first))
    text, first, last, period = text[order], first[order], last[order], period[order]
    new = np.append(True, (first[1:] != first[:-1]) | (last[1:] != last[:-1]))[: len(first)]
    text, first, last, period = text[new], first[new], last[new], period[new]
    order = np.lexsort((period, first))
    text, first, last, period = text[order], first[order], last[order], period[order]
    return kept[text], first - starts[text], last - first, period


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones the first, then the shortest period.

    Different ratios of numbers below 2 ** 32 differ by more than 2 ** -64.
    """
    return max(found, key=lambda r: ((r[1] << 64) // r[2], -r[0], -r[2]), default=None)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that a run has after its first period."""
    if not found:
        return b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]).decode()


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text collapsed, and ``n_words``, ``runs``, ``strongest``.

    Words stand between ASCII white space and are compared byte by byte. A run
    is a stretch with smallest period q (words q apart are equal) of at least 6
    words and 4 q words that cannot be extended with that period. ``runs`` (array of start, length, period, by start and
    period) counts words from 0; ``strongest`` is the one with the greatest
    length / period (ties: smallest start, then period). The text keeps each
    word that no run contains after its first q words, joined by one space.

    Each text is searched whole, in its task; nothing is shuffled, and repeated
    rows each get their result. Null, empty and blank texts have no words, no
    runs, a null ``strongest`` and become empty. Columns named like the three
    new ones are replaced.
    """

    def make(values: pa.Array) -> list[list]:
        split = [t.encode().split() if t else [] for t in values.to_pylist()]
        size = np.fromiter(map(len, split), np.int64, len(split))
        names: dict[bytes, int] = {}
        words = np.fromiter((names.setdefault(w, len(names)) for x in split for w in x), np.int64, int(size.sum()))
        found: list[list[tuple[int, int, int]]] = [[] for _ in split]
        for owner, *run in zip(*(x.tolist() for x in runs(words, size))):
            found[owner].append(tuple(run))
        spans = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in found]
        best = [strongest(x) for x in found]
        best = [dict(zip(("start", "length", "period"), r)) if r else None for r in best]
        return [[collapsed(w, x) for w, x in zip(split, found)], size.tolist(), spans, best]

    span = "struct<start:bigint,length:bigint,period:bigint>"
    types = {text: "string", "n_words": "bigint", "runs": f"array<{span}>", "strongest": span}
    return add_columns(docs, text, types, make)
