"""Membership rows → edges (J8, A4, A5, A1 pair-free, J9, A11, X1)."""

import itertools
import random

import pyarrow as pa
import pytest

from coweave.operators import cooccur


def _m(spark, rows):
    return spark.createDataFrame(rows, "work_id bigint, member bigint")


def _edges(df):
    return sorted(tuple(r) for r in df.select("src", "dst", "w").collect())


def test_one_work_three_members(spark):
    e = cooccur.cooccurrence_edges(_m(spark, [(1, 1), (1, 2), (1, 3)]))
    assert _edges(e) == [(1, 2, 1), (1, 3, 1), (2, 3, 1)]


def test_repeated_listings_count_each(spark):
    # works {1,2}, {2,1}, {1,2}: one pair of weight 3 (Q12)
    rows = [(10, 1), (10, 2), (11, 2), (11, 1), (12, 1), (12, 2)]
    assert _edges(cooccur.cooccurrence_edges(_m(spark, rows))) == [(1, 2, 3)]


def test_singletons_make_no_edge(spark):
    assert _edges(cooccur.cooccurrence_edges(_m(spark, [(1, 5), (2, 6)]))) == []


def _brute(rows):
    works = {}
    for w, m in rows:
        works.setdefault(w, set()).add(m)
    out = {}
    for ms in works.values():
        for a, b in itertools.combinations(sorted(ms), 2):
            out[(a, b)] = out.get((a, b), 0) + 1
    return sorted((a, b, w) for (a, b), w in out.items())


def test_hot_work_split_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = {(0, m) for m in range(60)}          # one hot work: 60 members
    rows |= {(w, rnd.randrange(80)) for w in range(1, 40) for _ in range(4)}
    rows = sorted(rows)
    df = _m(spark, rows)
    # block_rows=8 cuts the hot work into 8 hash blocks (64 block pairs)
    assert _edges(cooccur.cooccurrence_edges(df, block_rows=8)) == _brute(rows)
    assert _edges(cooccur.cooccurrence_edges(df)) == _brute(rows)


def test_pair_free_weighted_degree_equals_edge_sum(spark):
    rnd = random.Random(3)
    rows = sorted({(w, rnd.randrange(30)) for w in range(50) for _ in range(5)})
    df = _m(spark, rows)
    sym = cooccur.symmetrize(cooccur.cooccurrence_edges(df))
    by_edges = {r["src"]: r["s"] for r in sym.groupBy("src").agg({"w": "sum"})
                .withColumnRenamed("sum(w)", "s").collect()}
    pf = {r["id"]: r["coworks"] for r in cooccur.weighted_degree_from_memberships(df).collect()}
    assert pf == by_edges


def test_fold_symmetric(spark):
    df = spark.createDataFrame([(1, 2, 2), (2, 1, 3), (3, 3, 9), (4, 1, 1)],
                               "src bigint, dst bigint, w bigint")
    assert _edges(cooccur.fold_symmetric(df)) == [(1, 2, 5), (1, 4, 1)]


def test_check_membership_raises_on_unknown(spark):
    v = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    cooccur.check_membership(_m(spark, [(1, 1), (1, 2)]), v)
    with pytest.raises(ValueError):
        cooccur.check_membership(_m(spark, [(1, 1), (1, 7)]), v)


def test_count_works(spark):
    r = cooccur.count_works(_m(spark, [(1, 1), (1, 2), (2, 2)])).first()
    assert (r["works"], r["members"]) == (2, 2)


def _large_works(members=60, works=12, seed=11):
    rnd = random.Random(seed)
    return sorted({(w, rnd.randrange(members)) for w in range(works) for _ in range(50)})


def test_dense_works_shuffle_no_pairs(spark):
    """Many more pairs than rows: counted where two blocks of members meet."""
    rows = _large_works()
    df = _m(spark, rows)
    n, pairs = cooccur.pair_load(df)
    assert n == len(rows) and pairs == sum(
        k * (k - 1) // 2 for k in [sum(1 for w, _ in rows if w == x) for x in range(12)])
    e = cooccur.cooccurrence_edges(df, pairs_per_task=1000)
    assert cooccur.block_count(pairs, 1000) > 2 and _edges(e) == _brute(rows)
    plan = e._jdf.queryExecution().executedPlan().toString()
    # nothing is shuffled behind the join of the blocks
    assert "Exchange" not in plan[:plan.index("Join")]
    assert _edges(cooccur.dense_edges(df.union(_m(spark, [(None, 1), (1, None), (99, 5)])), 4)) == _brute(rows)


def test_pairs_of_a_cell_are_counted_in_parts(monkeypatch):
    """By a matrix or sorted, whole or a few pairs at a time: the same edges."""
    rnd = random.Random(1)
    rows = [([rnd.randrange(-50, 0) for _ in range(rnd.randrange(6))],
             [rnd.randrange(90) for _ in range(rnd.randrange(9))]) for _ in range(80)]
    for apart in (True, False):
        if not apart:
            rows = [(m, m) for _, m in rows]
        brute = {}
        for few, many in rows:
            for e in [(min(x, y), max(x, y)) for x in few for y in many if apart or x < y]:
                brute[e] = brute.get(e, 0) + 1
        ids = pa.list_(pa.int64())
        cell = pa.table({"apart": [apart] * len(rows), "few": pa.array([r[0] for r in rows], ids),
                         "many": pa.array([r[1] for r in rows], ids)})
        cell = pa.concat_tables([cell.slice(0, 30), cell.slice(30)])
        for places in (1 << 24, 0):
            for at_once in (1 << 20, 7):
                monkeypatch.setattr(cooccur, "MATRIX_PLACES", places)
                monkeypatch.setattr(cooccur, "PAIRS_AT_ONCE", at_once)
                got = [r for b in cooccur.count_pairs(cell) for r in b.to_pylist()]
                assert sorted(got, key=str) == sorted(
                    [{"src": x, "dst": y, "w": w} for (x, y), w in brute.items()], key=str)


def test_pairs_of_dense_works_are_no_rows(spark):
    e = cooccur.dense_edges(_m(spark, _large_works()), 4)
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan[:plan.index("Join")]


def test_sparse_pairs_are_dealt_by_their_number(spark, monkeypatch):
    rows = sorted({(w, random.Random(w).randrange(300)) for w in range(200)} | {(w, w) for w in range(200)})
    df = _m(spark, rows)
    _, pairs = cooccur.pair_load(df)
    assert cooccur.partitions_for(spark, pairs) is None
    assert cooccur.partitions_for(spark, 40, 5) == 8
    monkeypatch.setattr(cooccur.partitions_for, "__defaults__", (5,))
    e = cooccur.cooccurrence_edges(df)
    assert _edges(e) == _brute(rows)
    assert e.rdd.getNumPartitions() > 4        # the session's number


def test_no_list_of_large_works_where_none_is_large(spark):
    rows = sorted({(w, random.Random(w * 7 + n).randrange(300)) for w in range(60) for n in range(4)} | {(None, 3), (5, None)},
                  key=str)
    df = _m(spark, rows)
    brute = _brute([r for r in rows if None not in r])
    n, pairs, largest = cooccur.work_load(df)
    assert cooccur.pair_load(df) == (n, pairs) and 1 < largest <= 5
    e = cooccur.cooccurrence_edges(df)
    assert _edges(e) == brute
    # the sizes of the works are not looked up again: the pairs' join is the only one
    assert e._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    few = cooccur.cooccurrence_edges(df, block_rows=2)              # works are cut
    assert _edges(few) == brute
    assert _edges(cooccur.cooccurrence_edges(_m(spark, [(1, 2)]).limit(0))) == []


def test_endpoints_and_one_pass_need_no_second_pair_join(spark):
    rows = [(1, 1), (1, 2), (2, 3), (3, 4), (3, 4), (4, 5), (4, 6), (4, 7)]
    ends = {r["id"] for r in cooccur.endpoints(_m(spark, rows)).collect()}
    assert ends == {1, 2, 5, 6, 7}             # 4 is listed twice but alone
    e = cooccur.cooccurrence_edges(_m(spark, rows))
    assert _edges(cooccur.symmetrize(e, one_pass=True)) == _edges(cooccur.symmetrize(e))


def test_members_of_dense_works_travel_as_places(spark):
    """Two bytes a member; pairs that meet too seldom never leave their task."""
    rows = _large_works() + [(w, -10 ** 15 + w) for w in range(12)] + [(w, 10 ** 15) for w in range(4)]
    df, brute = _m(spark, rows), _brute(rows)
    for min_w in (1, 3, 100):
        e = cooccur.dense_edges(df, 4, min_w=min_w)
        assert _edges(e) == [x for x in brute if x[2] >= min_w]
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "as smallint" in plan and "Filter (w" not in plan
    assert _edges(cooccur.dense_edges(df.limit(0), 3)) == []
