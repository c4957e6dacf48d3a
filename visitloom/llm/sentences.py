"""Substring dedup: sentences in repeated runs of several sentences are removed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import add_columns, blocks, free_name, hash_bits, in_bits
from visitloom.llm.words import BASE, STEP, Words, mixed, powers, visible
from visitloom.sources.staging import stage

#: A run has at least so many sentences and so many words.
SENTENCES, WORDS = 3, 20
#: In a sentence of more words, the least word hash of each PART words in a row also ends a part.
LONG, PART = 16, 8
#: Bits of the filters, whatever the input: 4 MB each.
FILTER_BITS = 1 << 25


class Sentences(Words):
    """Sentences of a block of texts: first word of each, and of each text its first sentence.

    A sentence ends at a word that ends in ``.``, ``!`` or ``?``, at a line end
    and at the end of the text. Long ones are cut where the words themselves
    say so, hence alike in every text that holds them: at the least word hash of
    each window of PART words, the last of equal ones. No part has more than
    PART words, and a word said over and over is a part each time.
    """

    def __init__(self, values: pa.Array):
        super().__init__(values, visible())
        n = len(self.start)
        last = self.bytes[self.stop - 1] if n else self.bytes
        lines = np.concatenate(([0], np.cumsum(self.data == 10)))
        ends = np.isin(last, np.frombuffer(b".!?", dtype=np.uint8))
        ends[:-1] |= lines[self.start[1:]] > lines[self.stop[:-1]]
        ends[self.first[1:][np.diff(self.first) > 0] - 1] = True
        number = np.concatenate(([0], np.cumsum(ends)))[:-1]
        size = np.bincount(number, minlength=1)
        if n:
            least = np.arange(max(n - PART + 1, 0))
            for i in range(1, PART):
                after = np.arange(i, len(least) + i)
                least = np.where(self.hash[after] <= self.hash[least], after, least)
            whole = number[: len(least)] == number[PART - 1 :]
            ends[least[whole & (size[number[: len(least)]] > LONG)]] = True
        self.sentence = np.concatenate(([0], np.flatnonzero(ends) + 1))
        if n == 0:
            self.sentence = np.zeros(1, dtype=np.int64)
        self.of_text = np.searchsorted(self.sentence, self.first)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From each sentence, and up to each, the shortest run that is long enough: text, first and last + 1
        sentence, two hashes.

        They cover any longer run: a sentence from which the shortest run leaves
        it lies in the shortest run up to its end. Sentences are counted within
        their text; runs are sorted by first and last.
        """
        count = len(self.sentence) - 1
        begin = np.arange(count)
        end = np.maximum(begin + SENTENCES, np.searchsorted(self.sentence, self.sentence[:-1] + WORDS))
        text = np.searchsorted(self.of_text, begin, side="right") - 1
        inside = end <= self.of_text[text + 1]
        until = begin + 1
        back = np.minimum(until - SENTENCES, np.searchsorted(self.sentence, self.sentence[1:] - WORDS, side="right") - 1)
        new = back >= self.of_text[text]
        new[new] = end[back[new]] != until[new]
        begin, end = np.concatenate((begin[inside], back[new])), np.concatenate((end[inside], until[new]))
        order = np.lexsort((end, begin))
        begin, end, text = begin[order], end[order], np.concatenate((text[inside], text[new]))[order]
        a, b = self.sentence[begin], self.sentence[end]
        hashes = []
        for base in (STEP, BASE):
            power = powers(base, len(self.hash) + 1)
            back = powers(pow(base, -1, 1 << 64), len(self.hash) + 1)
            total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.hash * power[:-1], dtype=np.uint64)))
            hashes.append(mixed((total[b] - total[a]) * back[a]))
        first = self.of_text[text]
        return text, begin - first, end - first, hashes[0], hashes[1]


def _runs(docs: DataFrame, columns: list[str], types: str, pick: Callable[[Sentences], list]) -> DataFrame:
    """Rows that ``pick`` makes of the runs of each block: the first array holds places of texts in the block,
    for which it gets the given columns; the others are columns as they are."""
    *carried, _ = columns
    schema = docs.select(*(F.col(f"`{c}`") for c in carried)).schema
    for field in docs.sparkSession.createDataFrame([], types).schema:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in blocks(batch.column(len(carried))):
                part = batch.slice(start, stop - start)
                owner, *arrays = pick(Sentences(part.column(len(carried))))
                kept = [part.column(i).take(pa.array(owner)) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in arrays)], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)


def _marked(units: Sentences) -> tuple[np.ndarray, ...]:
    """The runs with ``again`` where the same text has them before."""
    owner, first, last, h1, h2 = units.runs()
    order = np.lexsort((first, h2, h1, owner))
    again = np.zeros(len(owner), dtype=bool)
    same = np.ones(max(len(owner) - 1, 0), dtype=bool)
    for x in (owner, h1, h2):
        same &= x[order][1:] == x[order][:-1]
    again[order[1:]] = same
    return owner, h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), first, last, again


def _hashes(units: Sentences) -> list:
    owner, h1, _, _, _, again = _marked(units)
    return [owner[~again], h1[~again]]


def _candidates(bits: np.ndarray) -> Callable[[Sentences], list]:
    """Runs whose hash may repeat, or that repeat in their own text."""

    def pick(units: Sentences) -> list:
        owner, h1, h2, first, last, again = _marked(units)
        kept = again | in_bits(bits, h1)
        return [x[kept] for x in (owner, h1, h2, first.astype(np.int32), last.astype(np.int32), again)]

    return pick


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, list[dict]]:
    """The text without the given runs (first and last + 1 sentence), how many sentences those are, and
    where they stood in the old text."""
    data = text.encode()
    units = Sentences(pa.array([text]))
    count = len(units.sentence) - 1
    gone = np.zeros(count + 1, dtype=bool)
    for first, last in spans:
        gone[first:last] = True
    starts = np.append(units.start[units.sentence[:-1]], len(data))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)))
    kept, removed, at = [], [], 0
    for a, b in zip(starts[edges[::2]].tolist(), starts[edges[1::2]].tolist()):
        kept.append(data[at:a].decode())
        middle = len(data[a:b].decode())
        begin = (removed[-1]["end"] if removed else 0) + len(kept[-1])
        removed.append({"start": begin, "end": begin + middle})
        at = b
    return "".join([*kept, data[at:].decode()]), int(gone.sum()), removed


def _passes(bits: np.ndarray) -> Callable[[Column], Column]:
    """Whether a hash may be in the filter; other columns of the rows do not go through Python."""

    @F.pandas_udf("boolean")
    def check(h: pd.Series) -> pd.Series:
        return pd.Series(in_bits(bits, h.to_numpy()))

    return check


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text cut, and ``n_removed``, ``removed``, ``copies_of``.

    A run is at least 3 consecutive sentences of at least 20 words together;
    words are what stands between white space, A-Z in lower case. Where equal
    runs stand in several places, the one in the row with the smallest ``key``
    is first (a null key is last; of equal keys any one; within a text the
    first). The sentences of all others go, with the white space behind them.
    ``n_removed`` counts them, ``removed`` (array of start, end) has their
    places in the old text in code points, ``copies_of`` the keys of the rows
    that keep them, sorted.

    Long sentences are cut into parts by their own words (``Sentences``), and parts
    count as sentences. Certain to go is what equals whole sentences or parts
    elsewhere. A passage that starts or ends in mid-sentence may be cut otherwise
    at its two ends: there up to a part of 8 words can stay, and one that leaves
    fewer than 3 parts or 20 words in common stays whole.

    Hashes of all runs are grouped first, nothing else. A bit filter of fixed
    size then tells which runs may repeat; these alone are read again with their
    places, and equal hashes decide. Texts are moved only where a run of theirs
    may be covered.

    Every row stays, repeated ones too, if need be with an empty text. Null,
    empty and short texts have no runs and stay as they are. Columns named like
    the three new ones are replaced.
    """
    names = ["n_removed", "removed", "copies_of"]
    kept = [c for c in docs.columns if c not in names]
    row, spans = free_name(docs, "row_number"), free_name(docs, "spans")
    numbered = stage(docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn(row, F.monotonically_increasing_id()))
    hashes = _runs(numbered, [row, text], "h1 long", _hashes)
    often = hashes.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    bits = hash_bits(often, "h1", FILTER_BITS)
    named = numbered.select(F.col(f"`{row}`").alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"))
    types = "h1 long, h2 int, first int, last int, again boolean"
    runs = stage(_runs(named, ["row", "key", "t"], types, _candidates(bits)))
    place = F.struct(F.col("key").isNull(), F.col("key")) if dict(numbered.dtypes)[key] not in ("bigint", "int") else (
        F.coalesce("key", F.lit((1 << 63) - 1))
    )
    once = runs.where(~F.col("again"))
    repeated = (
        once.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("row", place).alias("keeper"), F.min("key").alias("keeper_key"))
        .where(F.col("n") > 1)
        .select("h1", "h2", "keeper", "keeper_key")
    )
    others = once.select("row", "h1", "h2", "first", "last").join(repeated, ["h1", "h2"])
    others = others.where(F.col("row") != F.col("keeper")).select("row", "first", "last", "keeper_key")
    own = runs.where("again").select("row", "first", "last", F.col("key").alias("keeper_key"))
    covered = others.unionByName(own).groupBy("row").agg(
        F.collect_set(F.struct("first", "last")).alias(spans),
        F.array_sort(F.collect_set("keeper_key")).alias("copies_of"),
    )
    covered = stage(covered.withColumn("h", F.xxhash64("row")))
    maybe = _passes(hash_bits(covered, "h", FILTER_BITS))(F.xxhash64(row))
    key_type = numbered.schema[key].dataType.simpleString()
    no_keys = F.array().cast(f"array<{key_type}>")
    untouched = numbered.where(~maybe).select(
        *(F.col(f"`{c}`") for c in kept),
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:int,end:int>>").alias("removed"),
        no_keys.alias("copies_of"),
    )
    joined = numbered.where(maybe).join(covered.drop("h").withColumnRenamed("row", row), row, "left")
    given = free_name(joined, "given")
    joined = joined.withColumn(given, F.struct(F.col(f"`{text}`").alias("text"), F.col(spans).alias("spans")))

    def make(values: pa.Array) -> list[list]:
        texts, lists = values.field("text").to_pylist(), values.field("spans").to_pylist()
        made = [cut(t, [(x["first"], x["last"]) for x in s]) if s else (t, 0, []) for t, s in zip(texts, lists)]
        return [list(x) for x in zip(*made)] if made else [[], [], []]

    types = {text: "string", "n_removed": "bigint", "removed": "array<struct<start:int,end:int>>"}
    out = add_columns(joined.drop(spans), given, types, make)
    return out.select(
        *(F.col(f"`{c}`") for c in kept), "n_removed", "removed", F.coalesce("copies_of", no_keys).alias("copies_of")
    ).unionByName(untouched)
