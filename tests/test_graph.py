"""Graph operators on the hand-made graphs of FIXTURES.md §3."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import graph_of
from coweave.operators import graph as gr
from coweave.operators import khop, pagerank, ranking, triangles

TRI_TAIL = [(1, 2), (2, 3), (1, 3), (3, 4)]
PATH4 = [(1, 2), (2, 3), (3, 4)]
STAR = [(1, 2), (1, 3), (1, 4), (1, 5)]


def _map(df, key, val):
    return {r[key]: r[val] for r in df.collect()}


def _ring(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], set()).add(r["other"])
    return out


def test_triangles_triangle_tail(spark):
    t = triangles.triangle_count(graph_of(spark, TRI_TAIL))
    assert _map(t, "id", "triangles") == {1: 1, 2: 1, 3: 1, 4: 0}


def test_triangles_ignore_duplicates_direction_self_loops(spark):
    g = graph_of(spark, TRI_TAIL + [(2, 1), (3, 3), (1, 2)])
    assert _map(triangles.triangle_count(g), "id", "triangles") == {1: 1, 2: 1, 3: 1, 4: 0}


def test_path_has_no_triangle(spark):
    t = triangles.triangle_count(graph_of(spark, PATH4))
    assert set(_map(t, "id", "triangles").values()) == {0}


def _all(g):
    return g.vertices.select("id")


def test_two_hop_triangle_tail(spark):
    g = graph_of(spark, TRI_TAIL)
    ring = _ring(khop.khop_ring(g, _all(g), 2))
    assert ring.get(4) == {1, 2}
    assert 3 not in ring


def test_path_two_and_three_hops(spark):
    g = graph_of(spark, PATH4)
    assert _ring(khop.khop_ring(g, _all(g), 2))[1] == {3}
    assert _ring(khop.khop_ring(g, _all(g), 3))[1] == {4}


def test_star(spark):
    g = graph_of(spark, STAR)
    assert _map(gr.neighbour_count(g), "id", "neighbours") == {1: 4, 2: 1, 3: 1, 4: 1, 5: 1}
    ring = _ring(khop.khop_ring(g, _all(g), 2))
    for leaf in (2, 3, 4, 5):
        assert ring[leaf] == {2, 3, 4, 5} - {leaf}
    pr = _map(pagerank.pagerank(g, 0.001), "id", "pagerank")
    assert abs(sum(pr.values()) - 5) < 1e-9
    assert max(pr, key=pr.get) == 1


def test_isolated_vertex_and_unknown_label(spark):
    g = graph_of(spark, [(1, 7)], vertices={1: "a", 9: "z"})
    names = _map(g.vertices, "id", "name")
    assert names == {1: "a", 9: "z", 7: ""}
    assert _map(triangles.triangle_count(g), "id", "triangles")[9] == 0
    assert 9 not in _map(gr.neighbour_count(g), "id", "neighbours")
    lab = gr.attach_label(spark.createDataFrame([(7,), (9,)], "id bigint"),
                          spark.createDataFrame([(9, "z")], "id bigint, name string"))
    assert _map(lab, "id", "name") == {7: "", 9: "z"}


def test_weighted_degree_and_scatter(spark):
    g = graph_of(spark, [(1, 2, 3), (2, 3, 1)])
    d = {r["id"]: (r["neighbours"], r["coworks"]) for r in gr.degree_table(g).collect()}
    assert d == {1: (1, 3), 2: (2, 4), 3: (1, 1)}
    assert all(c >= n for n, c in d.values())


def test_degree_extrema_ties_smallest_id(spark):
    ext = {r["kind"]: (r["id"], r["degree"]) for r in gr.degree_extrema(graph_of(spark, PATH4)).collect()}
    assert ext == {"in": (2, 2), "out": (2, 2), "total": (2, 4)}


def test_khop_one_is_neighbours(spark):
    g = graph_of(spark, TRI_TAIL)
    ring = _ring(khop.khop_ring(g, _all(g), 1))
    assert ring == {1: {2, 3}, 2: {1, 3}, 3: {1, 2, 4}, 4: {3}}


def _random_graph(spark, seed, n=14, m=22):
    rnd = random.Random(seed)
    edges = set()
    while len(edges) < m:
        a, b = rnd.randrange(n), rnd.randrange(n)
        if a != b:
            edges.add((min(a, b), max(a, b)))
    return graph_of(spark, sorted(edges))


def _distances(g):
    near = {}
    for e in g.edges.collect():
        near.setdefault(e["src"], set()).add(e["dst"])
        near.setdefault(e["dst"], set()).add(e["src"])
    out = {}
    for s in near:
        seen, frontier, d = {s: 0}, {s}, 0
        while frontier:
            d += 1
            frontier = {y for x in frontier for y in near[x]} - set(seen)
            seen |= {y: d for y in frontier}
        out[s] = seen
    return out


def test_ring_equals_shortest_distances(spark):
    for seed in (1, 2):
        g = _random_graph(spark, seed)
        want = sorted((s, o) for s, seen in _distances(g).items() for o, d in seen.items() if d == 2)
        assert sorted(tuple(r) for r in khop.khop_ring(g, _all(g), 2).collect()) == want


def test_duplicate_vertex_ids_count_once(spark):
    v = spark.createDataFrame([(1, "a"), (1, "a2"), (2, "b")], "id bigint, name string")
    e = spark.createDataFrame([(1, 2, 1)], "src bigint, dst bigint, w bigint")
    g = gr.build_graph(v, e)
    assert sorted((r["id"], r["name"]) for r in g.vertices.collect()) == [(1, "a2"), (2, "b")]
    assert gr.attach_label(gr.degree_table(g), g.vertices).count() == 2


def test_triangles_at_a_hub_of_ten_thousand(spark):
    n = 10_000
    spokes = spark.range(1, n + 1).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"),
                                          F.lit(1).cast("bigint").alias("w"))
    rim = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"),
                                   F.lit(1).cast("bigint").alias("w"))
    names = spark.range(0, n + 1).select("id", F.lit("x").alias("name"))
    t = triangles.triangle_count(gr.build_graph(names, spokes.union(rim)))
    few = triangles.triangle_count(gr.build_graph(names, spokes.union(rim)), block_ids=1)
    assert few.exceptAll(t).count() == 0
    hub, total = t.agg(F.max(F.when(F.col("id") == 0, F.col("triangles"))), F.sum("triangles")).first()
    assert (hub, total) == (n - 1, 3 * (n - 1))


def test_pagerank_against_power_iteration(spark):
    g = _random_graph(spark, 9, n=40, m=90)
    near = {}
    for e in g.edges.collect():
        near.setdefault(e["src"], []).append(e["dst"])
        near.setdefault(e["dst"], []).append(e["src"])
    rank = {v: 1.0 for v in near}
    for _ in range(300):
        rank = {v: 0.15 + 0.85 * sum(rank[u] / len(near[u]) for u in near[v]) for v in near}
    scale = len(rank) / sum(rank.values())
    got = _map(pagerank.pagerank(g, 1e-6, rounds_per_job=5), "id", "pagerank")
    assert all(abs(got[v] - rank[v] * scale) < 1e-4 for v in rank)


def test_pagerank_raises_when_not_converged(spark):
    with pytest.raises(RuntimeError, match="not converged"):
        pagerank.pagerank(graph_of(spark, TRI_TAIL), 0.001, max_rounds=2)


def test_pagerank_hub_above_default_salt(spark):
    n = 5_000                                        # edges_per_salt is 4096
    e = spark.range(1, n + 1).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"),
                                     F.lit(1).cast("bigint").alias("w"))
    g = gr.build_graph(spark.range(0, n + 1).select("id", F.lit("").alias("name")), e)
    hub, leaf, total = pagerank.pagerank(g, 0.01).agg(
        F.max("pagerank"), F.min("pagerank"), F.sum("pagerank")).first()
    assert abs(total - (n + 1)) < 1e-6 and hub > 1000 * leaf


def test_triangle_sum_divisible_by_three(spark):
    g = _random_graph(spark, 5, n=12, m=30)
    total = sum(_map(triangles.triangle_count(g), "id", "triangles").values())
    assert total % 3 == 0


def test_aggregate_messages_sum_of_weights(spark):
    g = graph_of(spark, [(1, 2, 3), (2, 3, 1)])
    m = gr.aggregate_messages(g, F.sum("msg"), to_dst=F.col("w"))
    assert _map(m, "id", "msg") == {1: 3, 2: 4, 3: 1}


def test_top_n_ties_by_label_then_id(spark):
    df = spark.createDataFrame([(1, "b", 5), (2, "a", 5), (3, "c", 9), (4, "a", 5)],
                               "id bigint, name string, v bigint")
    top = ranking.top_n(df, "v", 3).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in top] == [(1, 3), (2, 2), (3, 4)]


def test_snowball_levels(spark):
    # works: {1,2}, {2,3}, {3,4}, {4,5}: from seed 1, three rounds reach 1..4
    m = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (11, 3), (12, 3), (12, 4),
                               (13, 4), (13, 5)], "work_id bigint, member bigint")
    seeds = spark.createDataFrame([(1,)], "member bigint")
    found, works = khop.snowball(m, seeds, 3)
    assert _map(found, "member", "round") == {1: 0, 2: 1, 3: 2, 4: 3}
    assert sorted({r["work_id"] for r in works.collect()}) == [10, 11, 12]


def test_heavy_edges_and_category(spark):
    g = graph_of(spark, [(1, 2, 10), (2, 3, 9), (3, 4, 11)])
    assert sorted((r["src"], r["dst"]) for r in gr.heavy_edges(g, 10).collect()) == [(1, 2), (3, 4)]
    assert _map(gr.node_category(g, 10), "id", "category") == {1: 1, 2: 1, 3: 1, 4: 1}
    assert _map(gr.node_category(g, 11), "id", "category") == {1: 0, 2: 0, 3: 1, 4: 1}


def test_pagerank_salted_hub_matches_unsalted(spark):
    # hub 1 with 9 leaves plus a triangle tail; edges_per_salt=2 gives the hub 5 salts
    edges = [(1, k) for k in range(2, 11)] + [(2, 3), (3, 11), (11, 12)]
    g = graph_of(spark, edges)
    a = _map(pagerank.pagerank(g, 0.001), "id", "pagerank")
    b = _map(pagerank.pagerank(g, 0.001, edges_per_salt=2, rounds_per_job=1), "id", "pagerank")
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert abs(sum(a.values()) - len(a)) < 1e-9


def test_seeded_ring_with_labels(spark):
    g = graph_of(spark, PATH4, vertices={1: "a", 2: "b", 3: "c", 4: "d"})
    seeds = spark.createDataFrame([(1,), (4,), (99,)], "id bigint")
    got = sorted(tuple(r) for r in khop.khop_ring_labelled(g, 2, seeds).collect())
    assert got == [(1, "a", 3, "c"), (4, "d", 2, "b")]


def test_triangles_are_listed_once(spark):
    g = _random_graph(spark, 4, n=12, m=34)
    near = {}
    for e in g.edges.collect():
        near.setdefault(e["src"], set()).add(e["dst"])
        near.setdefault(e["dst"], set()).add(e["src"])
    want = {tuple(sorted((a, b, c))) for a in near for b in near[a] for c in near[a] & near[b]}
    for block_ids in (1, 1024):
        got = [tuple(sorted(r)) for r in triangles.triangles(g.edges, block_ids=block_ids).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pagerank_rounds_walk_lists_and_sort_no_edges(spark):
    """Out-lists in all blocks, each vertex's edges once, bounded lists; the
    join of a round takes them as they are dealt and sorted."""
    hub = [(0, k) for k in range(1, 201)] + [(1, 2), (2, 3)]
    s = graph_of(spark, hub).symmetric().select("src", "dst")
    inv = s.groupBy("src").agg(F.count(F.lit(1)).alias("d")).withColumn("inv", 1 / F.col("d"))
    lists = pagerank.out_lists(s, inv, 3, 8).persist()
    rows = lists.collect()
    assert sorted((r["src"], d) for r in rows for d in r["dsts"]) == sorted(tuple(r) for r in s.collect())
    assert len({r["cell"] for r in rows if r["src"] == 0}) == 3 and max(len(r["dsts"]) for r in rows) < 40
    senders = spark.createDataFrame([(0, 0.15), (1, 0.15)], "id bigint, delta double")
    plan = pagerank._messages(senders, lists, 3)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("InMemoryRelation")[0]           # below it stands how the lists were made
    assert "InMemoryTableScan" in plan
    # the senders to the cells, the sums to the receivers; of the join's sides only the senders are sorted
    assert plan.count("- Exchange ") == 2 and "hashpartitioning(cell" not in plan and plan.count("- Sort [") <= 1
    lists.unpersist()


@pytest.mark.parametrize("blocks", [1, 3])
def test_triangles_by_triples_of_blocks(spark, blocks):
    """Sparse vertices, a dense part (bits), a hub, and both met in one cell."""
    rnd = random.Random(4)
    edges = {tuple(sorted(rnd.sample(range(-300, 300), 2))) for _ in range(1500)}
    edges |= {(a, b) for a in range(1000, 1090) for b in range(a + 1, 1090) if rnd.random() < 0.6}
    edges |= {(0, v) for v in range(1000, 1040)} | {(-1, v) for v in range(1, 250)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = {v: sum(len(near[v] & near[u]) for u in near[v]) // 2 for v in near}
    listed = list(edges) + [(b, a) for a, b in list(edges)[::7]] + [(3, 3)]
    got = _map(triangles.triangle_count(graph_of(spark, listed), blocks=blocks), "id", "triangles")
    assert got == {**{3: 0}, **want}


def test_every_edge_is_in_one_matrix(spark):
    """Dense edges take a bit each; a matrix, not a list per edge, goes to the cells."""
    n = 256
    u, v = zip(*[(a, b) for a in range(n) for b in range(a + 1, n)])
    sides = pa.table({"block": [0], "i": [0], "j": [0], "ids": [list(range(n))]})
    m = triangles.matrix(pa.table({"u": u, "v": v}), sides).to_pylist()[0]
    assert m["bits"] and len(m["data"]) == n * n // 8
    few = triangles.matrix(pa.table({"u": u[:9] * 2, "v": v[:9] * 2}), sides).to_pylist()[0]
    assert not few["bits"] and len(few["data"]) == 4 * (n + 9)
    cell = pa.table({k: [m[k]] for k in m} | {"a": [0], "b": [0], "c": [0]})
    found = triangles.count_cell(cell, 100).to_pydict()
    assert sum(found["found"]) == n * (n - 1) * (n - 2) // 2
    assert triangles.blocks_for(90_000, 900_000_000) < 20      # 60 copies of the events


def test_pagerank_over_packed_cells(spark):
    """The same ranks; the cells stay where they are dealt, an edge is packed twice."""
    rnd = random.Random(6)
    edges = sorted({tuple(sorted(rnd.sample(range(-30, 30), 2))) for _ in range(150)} | {(100, k) for k in range(-30, 30)} | {(200, 201)})
    edges = [(b, a) if a % 2 else (a, b) for a, b in edges]
    g = graph_of(spark, edges, vertices={v: "" for v in (*range(-30, 30), 100, 200, 201, 300)})
    lists, cells = (_map(pagerank.pagerank(g, 0.01, packed=p, partitions=9), "id", "pagerank") for p in (False, True))
    assert lists.keys() == cells.keys() and all(abs(lists[k] - cells[k]) < 1e-9 for k in lists)
    inv = g.symmetric().groupBy("src").agg((1 / F.count(F.lit(1))).alias("inv"))
    packed = pagerank.packed_cells(g.edges.select("src", "dst"), inv, 3).persist()
    assert sum(len(r["places"]) // 4 for r in packed.collect()) == 2 * len(edges)
    senders = spark.createDataFrame([(100, 0.15)], "id bigint, delta double")
    msgs = pagerank._packed_messages(senders, packed, 3)
    plan = msgs._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("- Exchange ") == 2 and "InMemoryTableScan" in plan and "Generate explode(dsts" not in plan
    got = _map(msgs, "id", "msg")
    assert set(got) == set(range(-30, 30)) and abs(sum(got.values()) - 0.15) < 1e-12
    packed.unpersist()
