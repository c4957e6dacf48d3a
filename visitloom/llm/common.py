"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.sources.staging import stage

#: Bytes of text that a task turns into numpy arrays at a time.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has the name (any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def add_columns(
    df: DataFrame, column: str, types: dict[str, str], make: Callable[[pa.Array], list[list]]
) -> DataFrame:
    """``df`` with columns that ``make`` derives from the values of one column.

    ``make`` gets the values of some rows and returns one list per new column. Rows pass through in Arrow batches, a
    block of bounded text size at a time, so one task holds one batch. A new
    column replaces one of the same name; all others stay as they are.
    """
    old = [c for c in df.columns if c.lower() not in {t.lower() for t in types}]
    spark = df.sparkSession
    extra = spark.createDataFrame([], ", ".join(f"`{k}` {t}" for k, t in types.items())).schema
    carried = df.select(*(F.col(f"`{c}`") for c in old), F.col(f"`{column}`").alias(free_name(df, "__in")))
    schema = carried.select(*(F.col(f"`{c}`") for c in old)).schema
    for field in extra:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            for start, stop in blocks(values):
                made = make(values.slice(start, stop - start))
                arrays = [batch.column(i).slice(start, stop - start) for i in range(len(old))]
                arrays += [pa.array(v, type=out.field(len(old) + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(
                    [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, out)], schema=out
                )

    return carried.mapInArrow(run, schema)


def blocks(values: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer text is a range of its own."""
    limit = limit or BLOCK_BYTES
    ends = offsets(values)
    if ends is None:
        yield from ((i, min(i + 4096, len(values))) for i in range(0, len(values), 4096))
        return
    start = 0
    while start < len(values):
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(values))
        yield start, stop
        start = stop


def offsets(values: pa.Array) -> np.ndarray | None:
    """Where each text or binary value begins, and the last ends, in the array's bytes; None for other types."""
    kind = values.type
    if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        width = np.int64
    elif pa.types.is_string(kind) or pa.types.is_binary(kind):
        width = np.int32
    else:
        return None
    if not len(values):
        return np.zeros(1, dtype=width)
    return np.frombuffer(values.buffers()[1], dtype=width)[values.offset : values.offset + len(values) + 1]


def text_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a slice of texts, one after the other, and where each begins; null is empty."""
    if values.null_count:
        values = values.fill_null("")
    ends = offsets(values)
    data = values.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def hash_bits(hashes: DataFrame, name: str, size: int) -> np.ndarray:
    """Bit filter of a column of 64-bit hashes: at most ``size`` / 64 words reach the driver, whatever the input.

    With more hashes than bits it lets all pass: it can spare work, never decide a result.
    """
    place = F.pmod(F.col(name), F.lit(size))
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(`{name}`, {size}L) & 63 as int))")).alias("bits")
    )
    found, out = words.toArrow(), np.zeros(size // 64, dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the signed hashes may be in the filter."""
    place = hashes % (64 * len(bits))
    return ((bits[place >> 6] >> (place & 63)) & 1).astype(bool)


def cut_out(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with ``mark`` for each span, for spans that overlap or touch once; spans by start."""
    parts, at = [], 0
    for start, end in spans:
        if not parts or start > at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (``a``, ``b``): columns ``node``, ``root``.

    ``root`` is the smallest node reachable; nodes without an edge are not listed.
    Large-star and small-star rounds: each joins the edges with one row per node,
    so a hub of any degree is split by AQE like any hot key of an inner join.
    Every round is written to the shared folder; nothing is collected but a
    count and a checksum, whose repetition ends the rounds.
    """
    a, b = F.col("a"), F.col("b")
    stars = stage(
        edges.where(a != b).select(F.greatest(a, b).alias("c"), F.least(a, b).alias("p")).distinct()
    )
    mark = _mark(stars)
    while mark[0]:
        both = stars.select(F.col("c").alias("u"), F.col("p").alias("v")).unionByName(
            stars.select(F.col("p").alias("u"), F.col("c").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("v"))
        least = least.select(F.col("u").alias("p"), F.least("u", "v").alias("m"))
        stars = stage(stars.join(least, "p").select("c", F.col("m").alias("p")).distinct())
        least = stars.groupBy("c").agg(F.min("p").alias("m"))
        moved = stars.join(least, "c").where(F.col("p") != F.col("m"))
        stars = stage(
            moved.select(F.col("p").alias("c"), F.col("m").alias("p"))
            .unionByName(least.select("c", F.col("m").alias("p")))
            .distinct()
        )
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    nodes = stars.select(F.col("c").alias("node"), F.col("p").alias("root"))
    return nodes.unionByName(stars.select(F.col("p").alias("node"), F.col("p").alias("root"))).distinct()


def _mark(stars: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("c", "p").cast("decimal(38,0)"))
    return tuple(stars.agg(F.count(F.lit(1)), total).first())


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links a-b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        live = low != high
        if not live.any():
            return root
        a, b = a[live], b[live]
        np.minimum.at(root, high[live], low[live])
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
