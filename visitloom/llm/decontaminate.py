"""Benchmark decontamination by winnowed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.llm.common import BLOCK_BYTES, blocks, free_name
from visitloom.llm.words import STEP, Words, alphanumeric, mixed, powers
from visitloom.sources.staging import stage

#: Words of a window, and of the n-grams that are hashed in it.
WINDOW, GRAM = 13, 9
#: Bits of the filter that the documents' fingerprints pass before they are shuffled: its size is fixed.
FILTER_BITS = 1 << 23
PRINT = "length int, hash bigint, at int, lead int, words string"
#: What a fingerprint takes beside its words, in bytes, when those of a block are dealt out to batches.
PRINT_BYTES = 64

class Grams(Words):
    """Words of documents and benchmark items, with their n-grams."""

    def __init__(self, values: pa.Array):
        super().__init__(values, alphanumeric())
        self._spaced: tuple[np.ndarray, np.ndarray] | None = None

    def fingerprints(self, length: int, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winnowed n-grams for windows of ``length`` words, in the texts marked: word positions and hashes.

        Each window keeps its least n-gram hash, the last of equal ones, so two
        equal windows keep the same n-gram at the same place in them.
        """
        n, size = len(self.hash), min(GRAM, length)
        counts = np.diff(self.first)
        fits = np.zeros(n + 1, dtype=np.int32)
        chosen = texts & (counts >= length)
        np.add.at(fits, self.first[:-1][chosen], 1)
        np.add.at(fits, self.first[1:][chosen] - length + 1, -1)
        begins = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
        if not len(begins):
            return begins, np.zeros(0, dtype=np.uint64)
        power = powers(STEP, size)
        gram = np.zeros(n - size + 1, dtype=np.uint64)
        for j in range(size):
            gram += self.hash[j : n - size + 1 + j] * power[j]
        gram = mixed(gram)
        best, at = gram[begins], begins.copy()
        for j in range(1, length - size + 1):
            here = gram[begins + j]
            lower = here <= best
            best = np.where(lower, here, best)
            at[lower] = begins[lower] + j
        at = np.unique(at)
        return at, gram[at]

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with a blank after each, and where each word begins, and the last ends, in that."""
        if self._spaced is None:
            sizes = self.stop - self.start
            ends = np.cumsum(sizes)
            source = np.arange(sizes.sum()) + np.repeat(self.start - ends + sizes, sizes)
            out = np.full(len(source) + len(sizes), 32, dtype=np.uint8)
            out[np.arange(len(source)) + np.repeat(np.arange(len(sizes)), sizes)] = self.bytes[source]
            self._spaced = out, np.concatenate(([0], np.cumsum(sizes + 1)))
        return self._spaced

    def around(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text of each n-gram, and from which word to which the windows reach that hold it."""
        text = np.searchsorted(self.first, at, side="right") - 1
        low = np.maximum(at + min(GRAM, length) - length, self.first[text])
        return text, low, np.minimum(at + length, self.first[text + 1])

    def joined(self, low: np.ndarray, high: np.ndarray) -> pa.Array:
        """Words from ``low`` to before ``high``, blank between."""
        data, place = self.spaced()
        sizes = place[high] - 1 - place[low]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        source = np.arange(ends[-1]) + np.repeat(place[low] - ends[:-1], sizes)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(data[source])]
        return pa.Array.from_buffers(pa.large_string(), len(low), buffers)


def probes(h: Column) -> list[Column]:
    """Places of a fingerprint in the filter."""
    return [F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftright(h, 32), F.lit(FILTER_BITS))]


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    signed = hashes.view(np.int64)
    ok = np.ones(len(hashes), dtype=bool)
    for place in (signed % FILTER_BITS, (signed >> 32) % FILTER_BITS):
        ok &= ((bits[place >> 6] >> (place & 63)) & 1).astype(bool)
    return ok


def _filter(prints: DataFrame) -> np.ndarray:
    """Bit filter of the hashes: at most FILTER_BITS / 64 rows reach the driver, whatever the input."""
    place = prints.select(F.explode(F.array(*probes(F.col("hash")))).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return out


def _found(words: Grams, lengths: list[int] | None, bits: np.ndarray | None) -> Iterator[tuple[np.ndarray, list]]:
    """Fingerprints of a block of texts, about BLOCK_BYTES of them at a time: number of the text, and columns of PRINT."""
    counts = np.diff(words.first)
    own = np.minimum(counts, WINDOW)
    for length in lengths if lengths is not None else np.unique(own[own > 0]).tolist():
        texts = counts >= length if lengths is not None else own == length
        at, hashes = words.fingerprints(length, texts)
        if bits is not None:
            ok = _passes(bits, hashes)
            at, hashes = at[ok], hashes[ok]
        if not len(at):
            continue
        text, low, high = words.around(at, length)
        place = words.spaced()[1]
        ends = np.cumsum(place[high] - place[low] + PRINT_BYTES)
        start = 0
        while start < len(at):
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")), start + 1)
            part = slice(start, stop)
            yield text[part], [
                pa.array(np.full(len(at[part]), length, dtype=np.int32)),
                pa.array(hashes[part].view(np.int64)),
                pa.array((at[part] - words.first[text[part]]).astype(np.int32)),
                pa.array((at[part] - low[part]).astype(np.int32)),
                words.joined(low[part], high[part]),
            ]
            start = stop


def _prints(
    df: DataFrame, text: str, key: str, names: tuple[str, str], lengths: list[int] | None, bits: np.ndarray | None
) -> DataFrame:
    """``df`` with the number of words, and a row more for each fingerprint; without ``lengths`` each text has windows of its own kind.

    A row of ``df`` has its number of words and no fingerprint; that of a
    fingerprint has the ``key`` of its text, and null in all other columns. So
    a text that is hit all over makes many rows, not a large one.
    """
    old = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    carried = df.select(*(F.col(f"`{c}`") for c in old), F.col(f"`{text}`").alias(free_name(df, "__in")))
    fields = [T.StructField(f.name, f.dataType, f.name != key or f.nullable) for f in carried.schema[: len(old)]]
    fields += [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.StructType.fromDDL(PRINT))]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        kinds, print_ = [f.type for f in out], out.field(len(old) + 1).type

        def filled(arrays: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([a if a.type == t else a.cast(t) for a, t in zip(arrays, kinds)], schema=out)

        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            for start, stop in blocks(values):
                words = Grams(values.slice(start, stop - start))
                rows = [batch.column(i).slice(start, stop - start) for i in range(len(old))]
                yield filled([*rows, pa.array(np.diff(words.first)), pa.nulls(stop - start, print_)])
                for owner, columns in _found(words, lengths, bits):
                    columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, print_)]
                    own = [
                        rows[i].take(pa.array(owner)) if name == key else pa.nulls(len(owner), kinds[i])
                        for i, name in enumerate(old)
                    ]
                    struct = pa.StructArray.from_arrays(columns, fields=list(print_))
                    yield filled([*own, pa.nulls(len(owner), pa.int64()), struct])

    return carried.mapInArrow(run, schema)


def extended(length: int, lead: int, words: str, lead2: int, words2: str) -> tuple[int, int] | None:
    """Equal words around a common n-gram, as offsets from its first word; None if no window is filled."""
    a, b, size = words.split(" "), words2.split(" "), min(GRAM, length)
    if a[lead : lead + size] != b[lead2 : lead2 + size]:
        return None
    left = 0
    while left < min(lead, lead2) and a[lead - left - 1] == b[lead2 - left - 1]:
        left += 1
    right, room = size, min(len(a) - lead, len(b) - lead2)
    while right < room and a[lead + right] == b[lead2 + right]:
        right += 1
    return (-left, right) if left + right >= length else None


def mark(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_words``, ``n_hit``, ``spans``, ``items``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower
    case. A window is any 13 consecutive words of an item, or a whole item of
    fewer words. ``spans`` (array of start, end in words, sorted) are the runs
    of the document that windows occur in, ``n_hit`` the number of words in
    them, ``items`` the ids of the occurring items as strings, sorted.

    Both sides are winnowed, the fingerprints joined, and each common n-gram
    extended over the words around it; equal words decide, not hashes. Any
    common window has a fingerprint in it, so none is missed.

    Every row stays, repeated ones too. Null, empty and wordless texts have no
    words and no hits, items without words have no windows, and an item without
    id counts for spans but is not listed. Without items nothing is hit.
    Columns of ``docs`` named like the four new ones are replaced.
    """
    names = ["n_words", "n_hit", "spans", "items"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in names]
    row, prints = free_name(docs, "row_number"), free_name(docs, "prints")
    bodies = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body"))
    used = stage(
        _prints(bodies, "body", "item", ("n", "p"), None, None)
        .where("p is not null")
        .select("item", "p.length", "p.hash", F.col("p.lead").alias("lead2"), F.col("p.words").alias("words2"))
        .distinct()
    )
    lengths = sorted(r[0] for r in used.select("length").distinct().collect())
    bits = _filter(used)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    counted = _prints(numbered, text, row, ("n_words", prints), lengths, bits)
    counted = stage(counted.select(*(F.col(f"`{c}`") for c in kept), row, "n_words", prints))
    matched = (
        counted.where(F.col(prints).isNotNull())
        .select(F.col(row).alias("row"), F.col(prints).alias("p"))
        .select("row", "p.length", "p.hash", "p.at", "p.lead", "p.words")
        .join(used, ["length", "hash"])
        .select("row", "item", "at", "length", "lead", "words", "lead2", "words2")
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for number, item, at, *pair in zip(*(c.to_pylist() for c in batch.columns)):
                run = extended(*pair)
                if run:
                    for column, value in zip(out, (number, item, at + run[0], at + run[1])):
                        column.append(value)
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=t) for v, t in zip(out, types)], ["row", "item", "start", "end"]
            )

    runs = matched.mapInArrow(extend, "row bigint, item string, start int, end int")
    hits = runs.groupBy(F.col("row").alias(row)).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    hits = hits.withColumn("spans", _joined(F.col("spans")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    none = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,end:int>>")
    return counted.where(F.col("n_words").isNotNull()).join(hits, row, "left").select(
        *(F.col(f"`{c}`") for c in kept),
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", none[1]).alias("spans"),
        F.coalesce("items", none[0]).alias("items"),
    )


def _joined(spans: Column) -> Column:
    """Sorted spans, those that overlap or touch made one."""

    def step(done, span):
        end = F.element_at(done["all"], -1)["end"]
        joins = (F.size(done["all"]) > 0) & (span["start"] <= done["upto"])
        last = F.element_at(done["all"], -1)
        widened = F.struct(last["start"].alias("start"), F.greatest(end, span["end"]).alias("end"))
        whole = F.when(
            joins, F.concat(F.slice(done["all"], 1, F.greatest(F.size(done["all"]) - 1, F.lit(0))), F.array(widened))
        ).otherwise(F.concat(done["all"], F.array(span)))
        return F.struct(whole.alias("all"), F.greatest(done["upto"], span["end"]).alias("upto"))

    empty = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("all"), F.lit(-1).alias("upto"))
    return F.aggregate(spans, empty, step, lambda done: done["all"])


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words, and at least one, is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with its columns, that are not contaminated by the items.

    Null, empty and wordless texts stay, repeated rows share their fate, and
    without items all rows stay. Columns named like those of ``mark`` are kept.
    """
    renamed = {c: free_name(docs, f"own_{c}") for c in docs.columns if c in ("n_words", "n_hit", "spans", "items")}
    marked = mark(docs.withColumnsRenamed(renamed), items, renamed.get(text, text))
    kept = marked.where(~contaminated(F.col("n_hit"), F.col("n_words")))
    return kept.select(*(F.col(f"`{renamed.get(c, c)}`").alias(c) for c in docs.columns))
