"""Prefix trie of conversations: subtree totals by time-forward processing, within shards and then across their roots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.sources.staging import stage

#: Conversations below the root of a shard at most; the next shards up have roots with this many times more.
MEMBERS = 2048
#: Turns of a conversation that one window runs over; longer ones add up over such stretches.
SPAN = 256


class Trie(NamedTuple):
    """``nodes``: one row per distinct sequence of first turns. ``ends``: one row per conversation
    (``member``), with the node (``conv_id``, ``depth``) at which it ends."""

    nodes: DataFrame
    ends: DataFrame


def thin_turns(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv``, ``turn``, two hashes of role and text, and the text's code points: texts need not be moved.

    Null role or text is empty. Rows without a conversation id belong to none
    and are left out.
    """
    said = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text)]
    return conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), *said).alias("k1"),
        F.xxhash64(F.lit(2), *said).alias("k2"),
        F.char_length(said[1]).cast("long").alias("chars"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """Thin turns with ``pos``, their place in the conversation from 0, by ``turn``, null first; equal turn
    numbers by their hashes.

    Counted within stretches of turn numbers and then over the stretches of a conversation.
    """
    rows = turns.withColumn("stretch", F.coalesce(F.expr(f"turn div {SPAN}"), F.lit(-(1 << 62))))
    inner = Window.partitionBy("conv", "stretch").orderBy(F.col("turn").asc_nulls_first(), "k1", "k2")
    counts = rows.groupBy("conv", "stretch").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("conv").orderBy("stretch")) - F.col("n")
    offsets = counts.select("conv", "stretch", so_far.alias("offset")).where("offset > 0")
    placed = rows.withColumn("inner", F.row_number().over(inner) - 1).join(offsets, ["conv", "stretch"], "left")
    return placed.select(*turns.columns, (F.col("inner") + F.coalesce("offset", F.lit(0))).alias("pos"))


def paths(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes on the way of each conversation: ``depth``, its key (``p1``, ``p2``), its parent's (``q1``,
    ``q2``), the last text's ``chars`` and those of the whole way (``total``).

    A node's key is the exclusive or of a hash of each turn and its place, so
    equal sequences have equal keys, a parent's key is a child's without the
    last turn, and keys of long conversations add up over stretches.
    """
    hashes = [F.xxhash64(F.lit(seed), "pos", "k1", "k2").alias(f"z{seed}") for seed in (1, 2)]
    rows = numbered(turns).select("conv", "pos", "chars", *hashes).withColumn("stretch", F.expr(f"pos div {SPAN}"))
    rows = stage(rows)
    sums = {"z1": F.bit_xor, "z2": F.bit_xor, "chars": F.sum}
    inner = Window.partitionBy("conv", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    along = rows.select("*", *(f(c).over(inner).alias(f"in_{c}") for c, f in sums.items()))
    long = rows.where("stretch > 0").select("conv").distinct()
    totals = rows.join(long, "conv", "left_semi").groupBy("conv", "stretch").agg(*(f(c).alias(c) for c, f in sums.items()))
    earlier = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "stretch", *(f(c).over(earlier).alias(f"so_{c}") for c, f in sums.items()))
    along = along.join(totals.where("stretch > 0"), ["conv", "stretch"], "left")
    keys = {k: F.col(f"in_z{k}").bitwiseXOR(F.coalesce(f"so_z{k}", F.lit(0))) for k in (1, 2)}
    turned = along.select(
        "conv",
        (F.col("pos") + 1).alias("depth"),
        keys[1].alias("p1"),
        keys[2].alias("p2"),
        keys[1].bitwiseXOR(F.col("z1")).alias("q1"),
        keys[2].bitwiseXOR(F.col("z2")).alias("q2"),
        "chars",
        (F.col("in_chars") + F.coalesce("so_chars", F.lit(0))).alias("total"),
    )
    zero = [F.lit(0).cast("long").alias(c) for c in turned.columns[1:]]
    return turned.unionByName(members.select("conv", *zero))


def _segments(nodes: DataFrame) -> DataFrame:
    """The trie without single-child stretches.

    Of the nodes with one smallest member, those with equal numbers of members
    are a chain in which nobody leaves: one row each, known by (``conv_id``,
    ``n_convs``), from depth ``top`` to ``bottom``, with its parent's.
    """
    chains = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"),
        F.max("depth").alias("bottom"),
        F.max("total").alias("total"),
        F.min(F.col("total") - F.col("chars")).alias("before"),
        F.min_by("q1", "depth").alias("q1"),
        F.min_by("q2", "depth").alias("q2"),
    )
    over = nodes.select(
        (F.col("depth") + 1).alias("top"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
        F.col("conv_id").alias("parent_conv"), F.col("n_convs").alias("parent_n"),
    )
    return chains.join(over, ["top", "q1", "q2"], "left").drop("q1", "q2")


def _forward(rows: DataFrame, high: int) -> DataFrame:
    """Time-forward processing of shards: each segment takes the messages addressed to it from a queue ordered
    by level and sends its totals to its parent.

    Spark sorts a shard's segments externally in reverse level order, and they
    stream by. The queue holds a message per segment at most whose parent is
    still to come, which the shard's bound limits.
    """
    order = [F.col("shard"), F.col("bottom").desc(), F.col("conv_id"), F.col("n_convs")]
    given = ["shard", "conv_id", "n_convs", "top", "bottom", "own", "parent_conv", "parent_n", "children", "leaves", "saved"]
    sent = ["conv_id", "n_convs", "parent_conv", "parent_n", "children", "leaves", "saved", "all_saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple] = []
        for batch in batches:
            out = []
            for shard, conv, n, top, bottom, own, over, over_n, children, leaves, saved in zip(
                *(c.to_pylist() for c in batch.columns)
            ):
                key = (shard, -bottom, conv, n)
                while queue and queue[0][0] <= key:
                    to, more_leaves, more_saved = heappop(queue)
                    if to != key:
                        raise ValueError(f"a message to {to} found no segment")
                    children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
                leaves = leaves if children else 1
                if over_n is not None and over_n <= high:
                    heappush(queue, ((shard, 1 - top, over, over_n), leaves, own + saved))
                out.append((conv, n, over, over_n, children, leaves, saved, own + saved))
            columns = [pa.array(x, pa.int64()) for x in zip(*out)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays(columns, sent)

    ready = rows.select(*given).repartition("shard").sortWithinPartitions(*order)
    return ready.mapInArrow(run, ", ".join(f"{c} bigint" for c in sent))


def _totals(segments: DataFrame, nodes: DataFrame, way: DataFrame, everyone: int) -> DataFrame:
    """``children``, ``leaves`` and ``saved`` (of all below) of the segments with several members.

    A segment with one member is the rest of a conversation: one leaf, nothing
    saved; it only counts for its parent. The others go by size: a shard is all
    segments of up to ``MEMBERS`` members below a root whose parent has more,
    so no shard holds more segments than that. The totals of shard roots, added
    up per parent, are the messages to the next, larger segments, which are
    sharded alike, until the root of the trie is reached.
    """
    key = ["conv_id", "n_convs"]
    to = [F.col("parent_conv").alias("conv_id"), F.col("parent_n").alias("n_convs")]
    alone = segments.where("n_convs = 1 and parent_n is not null").groupBy(*to).agg(F.count(F.lit(1)).alias("children"))
    pending = [alone.select(*key, "children", F.col("children").alias("leaves"), F.lit(0).cast("long").alias("saved"))]
    own = ((F.col("n_convs") - 1) * (F.col("total") - F.col("before"))).alias("own")
    shared = segments.where("n_convs > 1").select(*key, "top", "bottom", own, "parent_conv", "parent_n")
    solved, low, high = [], 1, MEMBERS
    while low < everyone:
        part = shared.where(F.col("n_convs").between(low + 1, high))
        sums = [F.sum(c).alias(c) for c in ("children", "leaves", "saved")]
        arrived = reduce(DataFrame.unionByName, pending).where(F.col("n_convs").between(low + 1, high))
        part = part.join(arrived.groupBy(*key).agg(*sums), key, "left").na.fill(0, ["children", "leaves", "saved"])
        if high < everyone:
            above = nodes.where(F.col("n_convs") > high).select("depth", "p1", "p2")
            firsts = way.join(part.select(F.col("conv_id").alias("conv")).distinct(), "conv", "left_semi")
            cut = firsts.join(above, ["depth", "p1", "p2"]).groupBy("conv").agg((F.max("depth") + 1).alias("depth"))
            shard = firsts.join(cut, ["conv", "depth"]).select(F.col("conv").alias("conv_id"), F.col("p1").alias("shard"))
            part = part.join(shard, "conv_id")
        else:
            part = part.withColumn("shard", F.lit(0).cast("long"))
        done = stage(_forward(part, high))
        solved.append(done.select(*key, "children", "leaves", "saved"))
        sent = done.where(F.col("parent_n") > high).groupBy(*to).agg(
            F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("all_saved").alias("saved")
        )
        pending.append(sent)
        low, high = high, high * MEMBERS
    return reduce(DataFrame.unionByName, solved) if solved else None


def trie(turns: DataFrame, members: DataFrame | None = None) -> Trie:
    """The prefix trie of conversations, from ``thin_turns``; the root stands for no turns.

    ``members`` (``conv``, distinct) names all conversations, so that some may
    have no turns; by default those with turns. A node is known by its smallest
    member ``conv_id`` and its ``depth``; ``parent_conv_id`` is its parent's (null
    for the root). ``n_convs`` counts its members, ``n_children`` its children,
    ``n_leaves`` the childless nodes of its subtree, itself included.
    ``saved_tokens`` adds up over the subtree the code points of each node's last
    text, times its members but one: what stands in a shared prefix once.

    Turns of equal number in a conversation stand in an order that role and
    text decide, and repeated rows are turns of their own. Without
    conversations there are no nodes. Conversations that repeat, a first turn
    that all share and conversations of any length are split: nodes add up
    before they are moved, and totals are made in shards of bounded size.
    """
    turns = stage(turns)
    members = stage(members if members is not None else turns.select("conv").distinct())
    way = stage(paths(turns, members))
    same = [F.min(c).alias(c) for c in ("q1", "q2", "chars", "total")]
    nodes = way.groupBy("depth", "p1", "p2").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *same)
    nodes = stage(nodes)
    segments = stage(_segments(nodes))
    everyone = members.count()
    totals = _totals(segments, nodes, way, everyone)
    key = ["conv_id", "n_convs"]
    ends = segments.select(*key, "top", "bottom", F.col("total").alias("down"), "parent_conv")
    if totals is not None:
        ends = ends.join(totals, key, "left")
    else:
        ends = ends.withColumns({c: F.lit(None).cast("long") for c in ("children", "leaves", "saved")})
    known = nodes.select(*key, "depth", "chars", "total").join(ends, key)
    below = (F.col("n_convs") - 1) * (F.col("down") - F.col("total") + F.col("chars"))
    full = known.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent_conv")).alias("parent_conv_id"),
        "n_convs",
        F.when(F.col("depth") < F.col("bottom"), 1).otherwise(F.coalesce("children", F.lit(0))).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + below).alias("saved_tokens"),
    )
    last = way.groupBy("conv").agg(F.max(F.struct("depth", "p1", "p2")).alias("last")).select(F.col("conv").alias("member"), "last.*")
    named = nodes.select("depth", "p1", "p2", "conv_id")
    return Trie(full, last.join(named, ["depth", "p1", "p2"]).select("member", "conv_id", "depth"))


def listed_digest(ends: DataFrame, name: str = "ends_sha256") -> DataFrame:
    """SHA-256 per node of its members' ids, rising and comma-joined, where any ends.

    A digest is made of one list from first to last. Lists are sorted and cut
    over all tasks, a node's list too, into texts of up to 1,024 ids; the task
    that digests a node sees these pass one by one and keeps none.
    """
    node = ["conv_id", "depth"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            before, ids = None, []
            for conv, depth, member in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, depth) != before or len(ids) == 1024:
                    if ids:
                        rows.append((*before, ids[0], ",".join(map(str, ids))))
                    before, ids = (conv, depth), []
                ids.append(member)
            if ids:
                rows.append((*before, ids[0], ",".join(map(str, ids))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], [*node, "first", "listed"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, sha = None, None
        for batch in batches:
            rows = []
            for conv, depth, _, listed in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, depth) != before:
                    if sha:
                        rows.append((*before, sha.hexdigest()))
                    before, sha = (conv, depth), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(listed.encode())
            yield made(rows)
        if sha:
            yield made([(*before, sha.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        types = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*node, name])

    ranges = ends.select(*node, "member").repartitionByRange(*node, "member").sortWithinPartitions(*node, "member")
    texts = ranges.mapInArrow(cut, "conv_id bigint, depth bigint, first bigint, listed string")
    texts = texts.repartition(*node).sortWithinPartitions(*node, "first")
    return texts.mapInArrow(digest, f"conv_id bigint, depth bigint, {name} string")
