"""Visited sets as bitmaps, rings without earlier rounds, ring sizes of all."""

import random

import numpy as np
import pytest

from conftest import graph_of
from coweave.operators import khop, sketches


def random_edges(seed, n, m):
    rnd = random.Random(seed)
    return sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)})


def exact_rings(edges, vertices, k):
    near = {v: set() for v in vertices}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for v in vertices:
        ball, frontier = {v}, {v}
        rings = []
        for _ in range(k):
            frontier = {y for x in frontier for y in near[x]} - ball
            ball |= frontier
            rings.append(frontier)
        out[v] = rings
    return out


def test_bits_of_any_id(spark):
    ids = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 10 ** 12, -1, -32768, -32769, 12345, 2 ** 62]
    others = [2, 6, 10, 32766, 32770, 65535, 10 ** 12 + 1, -2, -32767, 2 ** 62 + 1, 5 * 10 ** 9]
    df = spark.createDataFrame([(i,) for i in ids], "member bigint")
    visited = khop.Visited(df, "member")
    got = visited.new_of(spark.createDataFrame([(i,) for i in ids + others], "member bigint"))
    assert sorted(r["member"] for r in got.collect()) == sorted(others)
    visited.add(spark.createDataFrame([(i,) for i in others[:5]], "member bigint"))
    got = visited.new_of(spark.createDataFrame([(i,) for i in ids + others], "member bigint"))
    assert sorted(r["member"] for r in got.collect()) == sorted(others[5:])


def test_keys_have_sets_of_their_own(spark):
    rows = [(s, i) for s in (1, 2) for i in range(0, 100_000, 7 * s)]
    visited = khop.Visited(spark.createDataFrame(rows, "id bigint, other bigint"), "other", ["id"])
    asked = [(s, i) for s in (1, 2, 3) for i in range(0, 50)]
    got = visited.new_of(spark.createDataFrame(asked, "id bigint, other bigint"))
    assert {tuple(r) for r in got.collect()} == {(s, i) for s, i in asked if s == 3 or i % (7 * s)}


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_rings_equal_breadth_first_search(spark, k):
    edges = random_edges(2, 120, 160)
    want = exact_rings(edges, range(120), k)
    g = graph_of(spark, edges, vertices={i: f"v{i}" for i in range(120)})
    seeds = [0, 5, 50, 119]
    got = khop.khop_ring(g, spark.createDataFrame([(s,) for s in seeds], "id bigint"), k)
    assert sorted(tuple(r) for r in got.collect()) == sorted((s, o) for s in seeds for o in want[s][k - 1])


def test_a_round_reads_the_frontier_and_one_visited_table(spark):
    """However many rounds there were: the edges, the newest frontier, the bitmaps."""
    g = graph_of(spark, random_edges(3, 60, 80)).materialized(
        spark.createDataFrame([(i, "x") for i in range(60)], "id bigint, name string"))
    seeds = spark.createDataFrame([(1,)], "id bigint")
    scans = []
    for k in (2, 5):
        plan = khop.khop_ring(g, seeds, k)._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("Relation ["))
    assert scans[0] == scans[1] == 4        # both directions of the edges, the frontier, the bitmaps


def test_snowball_over_works_of_any_type(spark):
    rnd = random.Random(9)
    rows = [(w, m) for w in range(80) for m in rnd.sample(range(150), 3)]
    near = {}
    for w, m in rows:
        near.setdefault(w, set()).add(m)
    seen, frontier, works, want = {0}, {0}, set(), {0: 0}
    for r in range(1, 4):
        touched = {w for w, ms in near.items() if ms & frontier}
        works |= touched
        frontier = {m for w in touched for m in near[w]} - seen
        seen |= frontier
        want.update({m: r for m in frontier})
    seeds = spark.createDataFrame([(0,)], "member bigint")
    for kind, cast in (("bigint", int), ("string", str)):
        df = spark.createDataFrame([(cast(w), m) for w, m in rows], f"work_id {kind}, member bigint")
        found, collected = khop.snowball(df, seeds, 3)
        assert {r["member"]: r["round"] for r in found.collect()} == want
        assert sorted((int(r["work_id"]), r["member"]) for r in collected.collect()) == sorted(
            (w, m) for w, m in rows if w in works)


def test_ring_sizes_of_all_vertices_are_near_the_exact_ones(spark):
    n, k = 3000, 3
    edges = random_edges(5, n, 6000) + [(0, i) for i in range(2500, 3000)]        # 0 is a hub
    edges = sorted(set(edges))
    want = exact_rings(edges, range(n + 1), k)
    g = graph_of(spark, edges, vertices={i: f"v{i}" for i in range(n + 1)})        # n has no edge
    got = {r["id"]: [r[f"ring_{i}"] for i in range(1, k + 1)] for r in khop.ring_sizes(g, k).collect()}
    assert set(got) == set(want)
    errors = []
    for v, rings in want.items():
        ball = 1
        for exact, size in zip(map(len, rings), got[v]):
            ball += exact
            errors.append(abs(size - exact) / ball)
    assert max(errors) < 0.1 and sum(errors) / len(errors) < 0.02
    assert all(got[v][0] == len(rings[0]) for v, rings in want.items() if len(rings[0]) < 15)   # small ones are exact
    assert got[n] == [0, 0, 0]
    assert khop.ring_sizes(graph_of(spark, [(1, 2)]), 1).orderBy("id").collect()[0]["ring_1"] == 1


@pytest.mark.parametrize("grid", [(1, 8), (2, 16)])
def test_ring_sizes_do_not_depend_on_the_grid(spark, grid, monkeypatch):
    monkeypatch.setattr(sketches, "CHUNK_BYTES", 4096)       # receivers united in several chunks, a hub in parts
    n = 900
    edges = sorted(set(random_edges(7, n, 1500) + [(0, i) for i in range(500, 900)]))
    g = graph_of(spark, edges, vertices={i: f"v{i}" for i in range(n)})
    row = lambda r: (r["id"], r["ring_1"], r["ring_2"], r["ring_3"])
    got = {r["id"]: r for r in khop.ring_sizes(g, 3, grid=grid).collect()}
    want = exact_rings(edges, range(n), 3)
    assert set(got) == set(want)
    for v, rings in want.items():
        ball = 1
        for r, exact in enumerate(map(len, rings), 1):
            ball += exact
            size = got[v][f"ring_{r}"]
            assert abs(size - exact) < 0.12 * ball
            if ball < 100:           # a slice keeps coupons up to a quarter of its registers
                assert size == exact or ball > 60 and grid[1] > 8
    if grid == (2, 16):
        monkeypatch.undo()
        again = khop.ring_sizes(g, 3, grid=(1, 16))
        assert sorted(map(row, again.collect())) == sorted(map(row, got.values()))


def test_sketches_are_sent_once_per_block_and_not_along_every_edge(spark):
    """Every vertex beside every other: a sketch per edge would be 160,000."""
    n = 400
    ids = spark.range(n)
    into = spark.createDataFrame([(i, j) for i in range(n) for j in range(n)], "id bigint, via bigint")
    ball = sketches.singletons(ids, 12, 8)
    united = sketches.unite(into, ball, 2, 8, 12)
    plan = united._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange") == 2          # edges and sketches, dealt by cell
    united = united.cache()
    assert united.count() == n * 8
    size = {r["id"]: r["b1"] for r in sketches.sizes(united, 12, "b1").collect()}
    assert len(size) == n and len(set(size.values())) == 1 and size[0] == n


def test_rounds_of_a_slice_send_no_sketch_and_no_edge(spark):
    """One exchange in all, of what the slices counted per vertex."""
    n = 300
    ids = spark.range(n)
    into = spark.createDataFrame([(i, (i + d) % n) for i in range(n) for d in (0, 1, n - 1)], "id bigint, via bigint")
    found = sketches.balls(ids, into, 3, 4, 8, 12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CoGroup" not in plan and plan.count("Exchange") == 1
    assert {tuple(r) for r in found.collect()} == {(i, 3, 5, 7) for i in range(n)}


def test_unions_of_registers_and_coupons(monkeypatch):
    monkeypatch.setattr(sketches, "HUB", 40)
    rnd, width, n = np.random.default_rng(3), 64, 200
    sets = [np.unique(rnd.integers(1, 12, k) << sketches.ADDRESS_BITS | rnd.integers(0, width, k)).astype(np.int32)
            for k in rnd.choice([0, 1, 3, 200], n)]
    regs = sketches._registers(n, np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets), width)
    sparse = np.array([len(s) <= width // 4 for s in sets])
    lengths = np.array([len(s) if few else 0 for s, few in zip(sets, sparse)], np.int32)
    coupons = np.concatenate([s for s, few in zip(sets, sparse) if few])
    now = sketches._Slice(regs, sparse, np.cumsum(lengths) - lengths, lengths, coupons)
    counts = rnd.choice([1, 2, 5, 30, 90], 60)
    first, at = np.concatenate([[0], np.cumsum(counts)]), rnd.integers(0, n, counts.sum())
    at[:200] = rnd.choice(np.flatnonzero(sparse), 200)
    united, known, few = sketches._unite_rows(first, at, now, width)
    values = np.split(few, np.cumsum(np.maximum(known, 0)))
    for i in range(60):
        of = at[first[i]:first[i + 1]]
        assert (united[i] == regs[of].max(axis=0)).all()
        different = np.unique(np.concatenate([sets[s] for s in of]))
        if sparse[of].all() and len(different) <= width // 4:
            assert known[i] == len(different) and sorted(values[i]) == sorted(different)
        else:
            assert known[i] == -1
    assert (known >= 0).sum() > 5 and (known < 0).sum() > 5
