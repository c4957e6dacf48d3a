"""Small-world graphs against comparing all vectors."""

import numpy as np
import pytest

from visitloom.llm import hnsw


def vectors(n=500, d=24, seed=3):
    rnd = np.random.default_rng(seed)
    out = [rnd.normal(size=d) for _ in range(n)]
    dense = rnd.normal(size=d)
    out += [dense + rnd.normal(size=d) * 0.02 for _ in range(150)]
    for i in range(0, 90, 3):
        out.append(out[i] + rnd.normal(size=d) * 0.1)
        out.append(out[i] * 7.5)
    out += [out[0], out[0], out[5]]
    return np.array(out, dtype=np.float32)


def slow(rows, least=0.98):
    """Links and components by comparing all rows."""
    def fine(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    out = {i: (0, r[0]) for i, r in enumerate(rows)}
    keys = {(r[2], len(r[1])) for r in rows if fine(r[1]) and r[2] is not None}
    for label, size in keys:
        own = [i for i, r in enumerate(rows) if r[2] == label and fine(r[1]) and len(r[1]) == size]
        units = hnsw.units_of(np.array([rows[i][1] for i in own]))
        links = units @ units.T >= least
        np.fill_diagonal(links, True)
        root = np.array([rows[i][0] for i in own])
        while True:
            new = np.where(links, root, 1 << 60).min(1)
            if (new == root).all():
                break
            root = new
        out |= {i: (int(links[k].sum()) - 1, int(root[k])) for k, i in enumerate(own)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, recall string")


@pytest.mark.parametrize("shard", [8192, 200])
def test_groups_equal_brute_force(spark, shard):
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors())]
    rows += [(9000, None, 0), (9001, [0.0] * 24, 0), (9002, [float("nan")] * 24, 0), (9003, [1.0, None] * 12, 0),
             (9004, rows[0][1], None), (9005, [1.0, 2.0], 0), (9006, [2.0, 4.0], 0), (9007, [float("inf")] * 24, 1),
             (9008, [], 0), (9009, [1e30] * 24, 0), (9010, [1e-30] * 24, 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_groups(table(spark, rows), shard=shard).collect()}
    assert got == {rows[i][0]: x for i, x in slow(rows).items()}


def test_repeated_rows_null_keys_and_no_rows(spark):
    rows = [(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (0, [1.0, 0.001], 3), (None, [0.0, 1.0], 3), (5, [0.0, 1.0], 4)]
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_groups(table(spark, rows)).collect())
    assert got == [(-1, 0, None, False), (0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False), (5, 0, 5, True)]
    assert hnsw.near_groups(table(spark, [])).collect() == []


def test_recall_without_the_audits():
    units = hnsw.units_of(vectors(1500, 48))
    graph = hnsw.Graph.build(units)
    truth = np.argsort(-(units @ units.T), axis=1)[:, :5]
    found, _ = graph.search(units, 48)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(truth.tolist(), found[:, :5].tolist())]) > 0.9
    marks, recall = hnsw.audited_links(graph, units, 0.98, True)
    assert recall >= 0.999 and np.array_equal(marks, units @ units.T >= 0.98)


def test_an_unreachable_group_is_found_by_the_audit():
    units = hnsw.units_of(vectors(300, 16))
    graph = hnsw.Graph.build(units)
    for links in graph.links:
        links[np.isin(links, np.arange(100, 140))] = -1
    marks, _ = hnsw.audited_links(graph, units, 0.98, True)
    assert np.array_equal(marks, units @ units.T >= 0.98)


def test_nodes_that_their_own_graph_loses_are_found_from_other_shards():
    """Small groups out of reach, beside one dense group that would fill a pooled audit."""
    rnd = np.random.default_rng(6)
    dense = rnd.normal(size=16)
    own = np.array([dense + rnd.normal(size=16) * 0.01 for _ in range(200)] + [rnd.normal(size=16) for _ in range(100)])
    other = own + rnd.normal(size=own.shape) * 0.005
    graph = hnsw.Graph.build(hnsw.units_of(own))
    for links in graph.links:
        links[np.isin(links, np.arange(220, 300))] = -1
    graph.lost = graph.unreached()
    assert len(graph.lost) > 20
    queries = hnsw.units_of(other)
    marks, recall = hnsw.audited_links(graph, queries, 0.98, False)
    assert recall == 1.0 and np.array_equal(marks, queries @ graph.units.T >= 0.98)


def test_an_audit_without_links_passes():
    a, b = (hnsw.units_of(np.random.default_rng(s).normal(size=(300, 32))) for s in (1, 2))
    marks, recall = hnsw.audited_links(hnsw.Graph.build(a), b, 0.98, False)
    assert recall == 1.0 and not marks.any()


def test_a_stored_graph_is_the_same():
    given = vectors(100, 8)
    graph = hnsw.Graph.build(hnsw.units_of(given))
    again, nodes, weights = hnsw.load(graph.dump(given, np.arange(len(given)), np.ones(len(given), dtype=np.int64)))
    assert all(np.array_equal(a, b) for a, b in zip(graph.links, again.links))
    assert np.array_equal(graph.units, again.units) and len(nodes) == len(weights) == len(given)
