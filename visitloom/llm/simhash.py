"""Near-duplicates by 64-bit SimHash and a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import add_columns, components, free_name, local_roots
from visitloom.sources.staging import stage

#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of the ``width``-word shingles, repeats counted; 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    cuts = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], 42) for i, j in cuts], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def add_fingerprint(docs: DataFrame, text: str = "text", width: int = 4, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the SimHash of a text column. Null and wordless texts get 0."""
    return add_columns(docs, text, {name: "bigint"}, lambda texts: [[fingerprint(t, width) for t in texts.to_pylist()]])


def near_links(prints: DataFrame, distance: int = 4, blocks: int = 6, most: int = 2048) -> DataFrame:
    """Links (``a``, ``b``) that join all fingerprints at most ``distance`` bits apart.

    ``prints`` has distinct values in ``fingerprint``. The links span the groups:
    two fingerprints in reach of each other are connected by them, pairs inside
    a group are not listed.

    Of ``blocks`` bit blocks at least ``blocks - distance`` agree in any such
    pair. So for each choice of that many blocks there is one forest of binary
    tries, a trie per value of the chosen bits, and each pair meets in a trie.
    A trie is dealt to a task by its value; tries of over ``most`` leaves are
    cut by hash into slices, and one task gets each pair of slices.
    """
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [
        sum(((1 << int(edges[i + 1])) - (1 << int(edges[i]))) for i in chosen)
        for chosen in combinations(range(blocks), blocks - distance)
    ]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    roots = F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m)) for m in signed)))
    leaves = prints.select("fingerprint", roots.alias("choice", "path"))
    large = (
        leaves.groupBy("choice", "path")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > most)
        .select("choice", "path", F.ceil(F.col("n") / most).cast("int").alias("slices"))
    )
    leaves = leaves.join(large, ["choice", "path"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("slices")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    dealt = leaves.select("fingerprint", "choice", "path", own.alias("own"), other.alias("other")).select(
        "fingerprint", "choice", "path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    keys = ["choice", "path", "i", "j"]
    sorted_tries = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, values in whole_groups(batches):
            a, b = trie_links(group, values, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return sorted_tries.mapInArrow(run, "a bigint, b bigint").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the tries and their fingerprints, cut where a trie ends."""
    kept = None
    for batch in batches:
        values, *keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
        now = [np.concatenate(x) for x in zip(kept, (values, *keys))] if kept else [values, *keys]
        new = np.zeros(len(now[0]), dtype=bool)
        for k in now[1:]:
            new[1:] |= k[1:] != k[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield np.cumsum(new[:cut]), now[0][:cut].view(np.uint64)
        kept = [x[cut:] for x in now]
    if kept and len(kept[0]):
        new = np.zeros(len(kept[0]), dtype=bool)
        for k in kept[1:]:
            new[1:] |= k[1:] != k[:-1]
        yield np.cumsum(new), kept[0].view(np.uint64)


def trie_links(group: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the leaves at most ``distance`` bits apart, within each group.

    A trie lies in the sorted values: a node is a range, its children split it
    where the next bit turns to one. Pairs of nodes go down together, each with
    the bits in which their paths differ; beyond the budget a pair is pruned,
    and a pair of single leaves is settled by its remaining bits at once.
    """
    order = np.lexsort((values, group))
    group, values = group[order], values[order]
    n = len(values)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    stop = np.r_[start[1:], n]
    many = stop - start > 1
    lo1, hi1 = start[many], stop[many]
    lo2, hi2, dist = lo1.copy(), hi1.copy(), np.zeros(len(lo1), dtype=np.int8)
    found_a, found_b = [], []
    for bit in range(63, -2, -1):
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if single.any():
            a, b = lo1[single], lo2[single]
            near = (np.bitwise_count(values[a] ^ values[b]) <= distance) & (a != b)
            found_a.append(a[near])
            found_b.append(b[near])
            lo1, hi1, lo2, hi2, dist = (x[~single] for x in (lo1, hi1, lo2, hi2, dist))
        if bit < 0 or not len(lo1):
            break
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        mid1 = hi1 - (ones[hi1] - ones[lo1])
        mid2 = hi2 - (ones[hi2] - ones[lo2])
        cross = lo1 != lo2
        far = dist + 1
        pairs = [
            (lo1, mid1, lo2, mid2, dist, None),
            (mid1, hi1, mid2, hi2, dist, None),
            (lo1, mid1, mid2, hi2, far, None),
            (mid1, hi1, lo2, mid2, far, cross),
        ]
        parts = []
        for p, q, r, s, d, only in pairs:
            keep = (q > p) & (s > r) & (d <= distance)
            if only is not None:
                keep &= only
            parts.append(tuple(x[keep] for x in (p, q, r, s, d)))
        lo1, hi1, lo2, hi2, dist = (np.concatenate(x) for x in zip(*parts))
    # equal leaves that are left share all bits
    if len(lo1):
        found_a.append(lo1)
        found_b.append(hi2 - 1)
    a = np.concatenate(found_a) if found_a else np.zeros(0, dtype=np.int64)
    b = np.concatenate(found_b) if found_b else a
    root = local_roots(n, a, b)
    child = np.flatnonzero(root != np.arange(n))
    return values[child], values[root[child]]


def duplicate_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4
) -> DataFrame:
    """``docs`` without the text, with ``fingerprint`` (bigint) and ``component_id``.

    Texts link where their SimHashes differ in at most ``distance`` bits;
    ``component_id`` is the smallest ``key`` reachable over links. Rows of equal
    texts, and of texts without words, have equal fingerprints and share a group.
    Null keys are carried and are never the smallest, unless a group has no
    other. Repeated rows stay. Columns named like the two new ones are replaced.
    """
    rest = docs.select(key, text)
    prints = stage(add_fingerprint(rest, text, width).select(key, "fingerprint"))
    classes = prints.groupBy("fingerprint").agg(F.min(key).alias("least"))
    classes = stage(classes)
    links = components(near_links(classes.select("fingerprint"), distance))
    linked = links.select(F.col("node").alias("fingerprint"), "root")
    rooted = classes.join(linked, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(member, "fingerprint").select(key, "fingerprint", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns.

    The row with the smallest ``key`` stays; of rows with equal keys one stays,
    and so does one row of a group without keys.
    """
    mark, row = free_name(docs, "fingerprint"), free_name(docs, "row_number")
    numbered = stage(add_fingerprint(docs.withColumn(row, F.monotonically_increasing_id()), text, width, mark))
    first = numbered.groupBy(F.col(mark).alias("fingerprint")).agg(
        F.min(F.struct(F.col(key).isNull(), F.col(key), F.col(row))).alias("least")
    )
    first = stage(first)
    links = components(near_links(first.select("fingerprint"), distance))
    linked = links.select(F.col("node").alias("fingerprint"), "root")
    kept = (
        first.join(linked, "fingerprint", "left")
        .groupBy(F.coalesce("root", "fingerprint").alias("root"))
        .agg(F.min("least").alias("least"))
        .select(F.col("least").getField(row).alias(row))
    )
    return numbered.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
