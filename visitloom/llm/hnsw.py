"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import components
from visitloom.sources.staging import stage

#: Vectors of a shard, about; links of a node on the ground level and above; beam while building.
SHARD, GROUND, ABOVE, BEAM = 8192, 24, 12, 48
#: Queries searched side by side, and queries of a block that are audited by brute force.
SIDE, AUDITED = 256, 64
#: Share of the true links that an audit must find.
RECALL = 0.999


class Graph:
    """Navigable small-world graph of unit vectors.

    Nodes are numbered so that those on high levels come first: level ``l`` has
    the nodes below ``sizes[l]``. Each level is built from the one above it, a
    batch of nodes at a time: the batch is searched in the graph so far and
    among itself, and each node keeps the near ones that are not nearer to
    another it keeps, which leaves ways out of dense groups.
    """

    def __init__(self, units: np.ndarray, links: list[np.ndarray], lost: np.ndarray | None = None):
        self.units, self.links = units, links
        #: Nodes that a search for their own vector misses; searches for others' vectors may, too.
        self.lost = np.zeros(0, dtype=np.int64) if lost is None else lost

    @classmethod
    def build(cls, units: np.ndarray) -> Graph:
        n = len(units)
        sizes = [n]
        while sizes[-1] > 4 * ABOVE:
            sizes.append(sizes[-1] // ABOVE)
        graph = cls(units, [])
        for level in range(len(sizes) - 1, -1, -1):
            width = GROUND if level == 0 else ABOVE
            links = np.full((sizes[level], width), -1, dtype=np.int32)
            graph.links.insert(0, links)
            done = 0
            while done < sizes[level]:
                stop = min(sizes[level], max(2 * width, min(2 * done, done + SIDE)))
                graph._insert(done, stop, links)
                done = stop
        graph.lost = graph.unreached()
        return graph

    def unreached(self) -> np.ndarray:
        found = [np.zeros(0, dtype=bool)]
        for start in range(0, len(self.units), SIDE):
            own = np.arange(start, min(start + SIDE, len(self.units)))
            ids, _ = self.search(self.units[own], min(BEAM, len(self.units)))
            found.append((ids == own[:, None]).any(1))
        return np.flatnonzero(~np.concatenate(found))

    def _insert(self, start: int, stop: int, links: np.ndarray) -> None:
        new, width = np.arange(start, stop), links.shape[1]
        among = self.units[new] @ self.units[new].T
        np.fill_diagonal(among, -np.inf)
        near = np.argsort(-among, axis=1)[:, : min(2 * width, stop - start - 1)]
        ids, sims = new[near], np.take_along_axis(among, near, 1)
        if start:
            found, close = self.search(self.units[new], BEAM, start)
            ids, sims = np.concatenate((ids, found), 1), np.concatenate((sims, close), 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        links[new] = self._spread(ids, sims, width)
        back: dict[int, list[int]] = {}
        for node, row in zip(new.tolist(), links[new].tolist()):
            for other in row:
                if other >= 0:
                    back.setdefault(other, []).append(node)
        full = []
        for other, more in back.items():
            own = links[other]
            free = np.flatnonzero(own < 0)
            more = [m for m in more if m not in set(own.tolist())]
            own[free[: len(more)]] = more[: len(free)]
            if len(more) > len(free):
                full.append((other, more[len(free) :]))
        if full:
            longest = max(len(m) for _, m in full)
            nodes = np.array([o for o, _ in full])
            extra = np.array([m + [-1] * (longest - len(m)) for _, m in full])
            ids = np.concatenate((links[nodes], extra), 1)
            sims = np.einsum("ijk,ik->ij", self.units[ids], self.units[nodes])
            sims[ids < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            links[nodes] = self._spread(ids, sims, width)

    def _spread(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Per row up to ``width`` of the ids, nearest first, that are not nearer to one kept; then the nearest others."""
        rows = np.arange(len(ids))
        kept = np.full((len(ids), width), -1, dtype=np.int32)
        count = np.zeros(len(ids), dtype=int)
        taken = np.zeros(ids.shape, dtype=bool)
        for j in range(ids.shape[1]):
            one = ids[:, j]
            to_kept = np.einsum("ijk,ik->ij", self.units[kept], self.units[one])
            to_kept[kept < 0] = -np.inf
            repeated = (kept == one[:, None]).any(1)
            good = (one >= 0) & np.isfinite(sims[:, j]) & ~repeated & (count < width * 2 // 3)
            good &= to_kept.max(1) < sims[:, j]
            kept[rows[good], count[good]] = one[good]
            count[good] += 1
            taken[:, j] = good | repeated
        for j in range(ids.shape[1]):
            one = ids[:, j]
            good = (one >= 0) & np.isfinite(sims[:, j]) & ~taken[:, j] & (count < width)
            good &= ~(kept == one[:, None]).any(1)
            kept[rows[good], count[good]] = one[good]
            count[good] += 1
        return kept

    def search(self, queries: np.ndarray, beam: int, below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per query the ``beam`` nearest nodes that a descent finds, nearest first (-1: none), and their cosines.

        ``below``: the nodes in the graph so far, on the lowest level there is.
        """
        entry = np.zeros((len(queries), 1), dtype=np.int64)
        for links in reversed(self.links[1:]):
            entry, _ = self._beam(queries, entry, links, 4, len(links))
        return self._beam(queries, entry, self.links[0], beam, below or len(self.links[0]))

    def _beam(self, queries, entry, links, beam, n):
        rows = np.arange(len(queries))
        ids = np.full((len(queries), beam), -1, dtype=np.int64)
        sims = np.full((len(queries), beam), -np.inf)
        opened = np.ones((len(queries), beam), dtype=bool)
        seen = np.zeros((len(queries), n + 1), dtype=bool)
        entry = np.where(entry < n, entry, -1)
        width = min(beam, entry.shape[1])
        ids[:, :width] = entry[:, :width]
        sims[:, :width] = np.einsum("ijk,ik->ij", self.units[ids[:, :width]], queries)
        sims[ids < 0] = -np.inf
        opened[:, :width] = False
        opened[ids < 0] = True
        seen[rows[:, None], ids] = True
        live = rows
        while len(live):
            waiting = np.where(opened[live], -np.inf, sims[live])
            place = waiting.argmax(1)
            some = np.isfinite(waiting[np.arange(len(live)), place])
            live, place = live[some], place[some]
            if not len(live):
                break
            opened[live, place] = True
            next_ = links[ids[live, place]].astype(np.int64)
            next_[next_ >= n] = -1
            fresh = ~seen[live[:, None], next_] & (next_ >= 0)
            seen[live[:, None], next_] = True
            close = np.einsum("ijk,ik->ij", self.units[next_], queries[live])
            close[~fresh] = -np.inf
            all_ids = np.concatenate((ids[live], np.where(fresh, next_, -1)), 1)
            all_sims = np.concatenate((sims[live], close), 1)
            all_opened = np.concatenate((opened[live], ~fresh), 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, order, 1)
            sims[live] = np.take_along_axis(all_sims, order, 1)
            opened[live] = np.take_along_axis(all_opened, order, 1)
        return ids, sims

    def linked(self, queries: np.ndarray, least: float, beam: int) -> np.ndarray:
        """Per query a row that marks the nodes with a cosine of at least ``least``: those the
        beam finds, and those reached from them through others in range."""
        n = len(self.units)
        out = np.zeros((len(queries), n), dtype=bool)
        for start in range(0, len(queries), SIDE):
            part = queries[start : start + SIDE]
            ids, sims = self.search(part, min(beam, n))
            hit, row = out[start : start + SIDE], np.arange(len(part))[:, None]
            near = (sims >= least - 1e-9) & (ids >= 0)
            r, c = np.nonzero(near)
            edge_row, edge = row[r, 0], ids[r, c]
            hit[edge_row, edge] = True
            while len(edge):
                more = self.links[0][edge]
                q, node = np.repeat(edge_row, more.shape[1]), more.ravel()
                ok = (node >= 0) & ~hit[q, node]
                pair = np.unique(q[ok] * n + node[ok])
                q, node = pair // n, pair % n
                ok = np.einsum("ij,ij->i", self.units[node], part[q]) >= least - 1e-9
                edge_row, edge = q[ok], node[ok]
                hit[edge_row, edge] = True
        return out

    def dump(self, vectors: np.ndarray, nodes: np.ndarray, weights: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=vectors, nodes=nodes, weights=weights, lost=self.lost, **{f"l{i}": x for i, x in enumerate(self.links)})
        return out.getvalue()


def units_of(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    # a first division keeps the squares of very large and very small components in range
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def load(blob: bytes) -> tuple[Graph, np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(blob)) as x:
        links = [x[f"l{i}"] for i in range(len(x.files) - 4)]
        return Graph(units_of(x["vectors"]), links, x["lost"]), x["nodes"], x["weights"]


def exact(queries: np.ndarray, units: np.ndarray, least: float) -> np.ndarray:
    return queries @ units.T >= least


def audited_links(graph: Graph, queries: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, float]:
    """Marks of the links between queries and nodes, and the recall in the last audit.

    The beam doubles until the audits pass. These compare queries with brute
    force: some spread over the block and some over the numbers of links found,
    so that small groups are among them; their recalls count alike, whatever
    the size of their group. For a shard's own vectors each must find itself;
    single ones that never do are compared with all. Nodes that their own graph
    loses are compared with all queries of other shards.
    """
    n = len(graph.units)
    beam = min(BEAM, n)
    found = graph.linked(queries, least, beam)
    few = min(len(queries), AUDITED)
    spread = np.linspace(0, len(queries) - 1, few).astype(int)
    chosen = np.unique(np.concatenate((spread, np.argsort(found.sum(1), kind="stable")[spread])))
    truth = exact(queries[chosen], graph.units, least)
    wanted = truth.sum(1)
    some = wanted > 0
    while True:
        if same:
            found |= found.T
            lost = np.flatnonzero(~found.diagonal())
        else:
            lost = np.zeros(0, dtype=int)
            for start in range(0, len(queries) if len(graph.lost) else 0, SIDE):
                part = slice(start, start + SIDE)
                found[part, graph.lost] |= exact(queries[part], graph.units[graph.lost], least)
        recalls = (found[chosen] & truth).sum(1)[some] / wanted[some]
        recall = recalls.mean() if len(recalls) else 1.0
        if beam >= n or (recall >= RECALL and len(lost) <= n // 50):
            break
        beam = min(n, 2 * beam)
        found = graph.linked(queries, least, beam)
    for start in range(0, len(lost), SIDE):
        part = lost[start : start + SIDE]
        found[part] |= exact(queries[part], graph.units, least)
        if same:
            found[:, part] |= found[part].T
    # the cosine decides in the end, in double precision
    for start in range(0, len(queries), SIDE):
        rows, columns = np.nonzero(found[start : start + SIDE])
        for i in range(0, len(rows), 1 << 16):
            r, c = rows[i : i + (1 << 16)] + start, columns[i : i + (1 << 16)]
            found[r, c] = np.einsum("ij,ij->i", queries[r], graph.units[c]) >= least
    return found, float(recall)


def _roots(links: np.ndarray) -> np.ndarray:
    """Component of each row and each column (behind the rows) of a matrix of links: its smallest number."""
    n, m = links.shape
    rows, columns = np.arange(n), np.arange(n, n + m)
    high = n + m
    while True:
        old = rows.copy(), columns.copy()
        for i in range(0, n, SIDE):
            part = links[i : i + SIDE]
            rows[i : i + SIDE] = np.minimum(rows[i : i + SIDE], np.where(part, columns, high).min(1))
            columns = np.minimum(columns, np.where(part, rows[i : i + SIDE, None], high).min(0))
        if np.array_equal(old[0], rows) and np.array_equal(old[1], columns):
            return np.concatenate((rows, columns))


def usable(vector: Column) -> Column:
    """Not null, no component null or not finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_groups(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = 0.98,
    shard: int = SHARD,
) -> DataFrame:
    """``rows`` without the vector and label, with ``n_links``, ``component_id``, ``kept``, ``recall``.

    Vectors of equal label (not null) and length link from a cosine of
    ``least`` on; null and zero vectors and those with null or non-finite
    components link with nothing. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest key reachable, its own included,
    ``kept`` says that it is the row's own key. ``recall`` is the lowest
    recall in the audits of its label, null without any. Repeated rows are rows
    of their own and link with each other. Null keys are carried; a group
    without any key has a null ``component_id``.

    Equal vectors are put together first. The vectors of a label are dealt by
    hash into shards of about ``shard``; each shard gets a graph, which is
    stored, and each pair of shards of a label one task, which searches one's
    vectors in the other's graph and returns a count and one link per vector.
    """
    numbered = stage(
        rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("usable", usable(F.col("vector")) & F.col("label").isNotNull())
    )
    groups = F.when(F.col("usable"), F.struct("label", "vector"))
    same = (
        numbered.where("usable")
        .groupBy("label", "vector")
        .agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("key").alias("least_key"))
    )
    distinct = stage(same.withColumn("size", F.size("vector")))
    shards = distinct.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = distinct.join(shards, ["label", "size"]).withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    )

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        size = part.column("size")[0].as_py()
        flat = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(-1, size)
        nodes, weights = part.column("node").to_numpy(), part.column("weight").to_numpy()
        order = np.random.default_rng(len(nodes)).permutation(len(nodes))
        vectors, nodes, weights = vectors[order], nodes[order], weights[order]
        blob = Graph.build(units_of(vectors)).dump(vectors, nodes, weights)
        keys = [part.column(c).slice(0, 1).combine_chunks() for c in ("label", "size", "shard")]
        return pa.Table.from_arrays([*keys, pa.array([blob], pa.binary())], ["label", "size", "shard", "graph"])

    key_type = dealt.schema["label"].dataType.simpleString()
    graphs = stage(
        dealt.select("label", "size", "shard", "node", "weight", "vector")
        .groupBy("label", "size", "shard")
        .applyInArrow(build, f"label {key_type}, size int, shard int, graph binary")
    )
    left, right = graphs.alias("l"), graphs.alias("r")
    pairs = left.join(
        right, (F.col("l.label") == F.col("r.label")) & (F.col("l.size") == F.col("r.size"))
        & (F.col("l.shard") <= F.col("r.shard"))
    ).select(
        F.col("l.label").alias("label"), F.col("l.size").alias("size"), F.col("l.shard").alias("i"),
        F.col("r.shard").alias("j"), F.col("l.graph").alias("a"), F.col("r.graph").alias("b"),
    ).repartition("label", "size", "i", "j")
    pairs = pairs.select((F.col("i") == F.col("j")).alias("same"), "a", "b")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, a, b = (batch.column(c)[i].as_py() for c in range(3))
                first, nodes, weights = load(a)
                graph, others, other_weights = (first, nodes, weights) if own else load(b)
                found, recall = audited_links(graph, first.units, least, own)
                yield _summary(found, nodes, weights, others, other_weights, own, recall)

    found = stage(pairs.mapInArrow(search, "node bigint, links bigint, root bigint, recall double"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("recall").alias("recall"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    member = distinct.join(counts, "node", "left").join(joined, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    member = stage(member.select("label", "vector", "node", "weight", "least_key", "links", "recall", "root"))
    smallest = member.groupBy("root").agg(F.min("least_key").alias("component_id"))
    member = member.join(smallest, "root").select(
        F.struct("label", "vector").alias("group"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", "recall",
    )
    out = numbered.withColumn("group", groups).select("key", "group", "usable").join(member, "group", "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("key"))
    return out.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
        "recall",
    )


def _summary(found, nodes, weights, others, other_weights, own, recall) -> pa.RecordBatch:
    """Per vector of either shard: rows linked, and one node of its component here."""
    if own:
        np.fill_diagonal(found, True)  # joins the row and the column of a vector
        root = _roots(found)[: len(nodes)]
        np.fill_diagonal(found, False)
        links, ids, roots = found @ other_weights, nodes, nodes[root]
    else:
        root = _roots(found)
        links = np.concatenate((found @ other_weights, found.T @ weights))
        ids = np.concatenate((nodes, others))
        roots = ids[root]
    data = [pa.array(x.astype(np.int64)) for x in (ids, links, roots)]
    return pa.RecordBatch.from_arrays(
        [*data, pa.array(np.full(len(ids), recall))], ["node", "links", "root", "recall"]
    )
