"""Heavy edges by prefix-filtered overlap join; exact places; growing input."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from coweave.operators import cooccur, overlap, ranking
from coweave.operators.incremental import EdgeView, pairs_with_new, touched_works

ROWS = "work_id bigint, member bigint"


def skewed_rows(seed, works=150, members=60):
    """Works of 1 to 40 members; member 0 is in two thirds of them."""
    rnd = random.Random(seed)
    rows = set()
    for w in range(works):
        size = 40 if w < 6 else rnd.randint(1, 6)
        rows |= {(w, m) for m in rnd.sample(range(1, members), size)}
        if rnd.random() < 0.66:
            rows.add((w, 0))
    return sorted(rows)


def pair_counts(rows):
    works = {}
    for w, m in rows:
        if w is not None and m is not None:
            works.setdefault(w, set()).add(m)
    return Counter(p for ms in works.values() for p in combinations(sorted(ms), 2))


@pytest.mark.parametrize("min_w", [1, 2, 3, 10])
def test_heavy_overlaps_equal_counting_all_pairs(spark, min_w):
    rows = skewed_rows(7) + [(None, 3), (5, None)]
    df = spark.createDataFrame(rows, ROWS)
    want = {(a, b, n) for (a, b), n in pair_counts(rows).items() if n >= min_w}
    got = overlap.heavy_overlaps(df, min_w, block_rows=7)      # the large works are split
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


def test_large_works_are_counted_by_blocks_without_a_table_of_candidates(spark, monkeypatch):
    rnd = random.Random(3)
    rows = sorted({(w, rnd.randrange(60)) for w in range(12) for _ in range(50)})
    written = []
    keep = overlap.cut_lineage
    monkeypatch.setattr(overlap, "cut_lineage", lambda df: written.append(df.columns) or keep(df))
    got = overlap.heavy_overlaps(spark.createDataFrame(rows, ROWS), 3, pairs_per_task=5000)
    assert {tuple(r) for r in got.collect()} == {(a, b, n) for (a, b), n in pair_counts(rows).items() if n >= 3}
    assert written and all("src" not in columns for columns in written)      # no pair is written


def test_prefixes_make_far_fewer_candidates_than_pairs(spark):
    """Many members who share a few very large works and little else: the
    large works are the rest of every member, and pair nobody."""
    rnd = random.Random(1)
    rows = {(w, m) for w in range(3) for m in range(200)}
    rows |= {(100 + m // 2, m) for m in range(200)} | {(500 + rnd.randrange(400), m) for m in range(200)}
    df = spark.createDataFrame(sorted(rows), ROWS)
    ordered = overlap._ordered(df, 4, "work_id", "member")
    found = overlap.prefix_candidates(ordered, overlap._last_works(ordered, 4))
    pairs = cooccur.member_pairs(df).select("src", "dst").distinct().count()
    assert pairs == 200 * 199 // 2 and found.count() < pairs / 100
    assert {tuple(r) for r in overlap.heavy_overlaps(df, 4).collect()} == {
        (a, b, n) for (a, b), n in pair_counts(rows).items() if n >= 4}


def test_too_few_works_equal_members_and_no_rows(spark):
    same = [(w, m) for w in range(5) for m in (1, 2, 3)] + [(9, 4), (9, 1)]
    got = overlap.heavy_overlaps(spark.createDataFrame(same, ROWS), 5)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 5), (1, 3, 5), (2, 3, 5)}
    assert overlap.heavy_overlaps(spark.createDataFrame([], ROWS), 2).count() == 0
    with pytest.raises(ValueError):
        overlap.heavy_overlaps(spark.createDataFrame([], ROWS), 0)


def test_places_are_those_of_the_sorted_table(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", "é", "", None]), rnd.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, name string, value int").repartition(5)
    by_label = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0]))
    got = sorted(ranking.placed_by_label(df).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, 2001))
    assert [r["id"] for r in got] == [r[0] for r in by_label]
    by_value = sorted(rows, key=lambda r: (-r[2], r[1] is not None, (r[1] or "").encode(), r[0]))
    got = sorted(ranking.placed_by_value(df, "value").collect(), key=lambda r: r["place"])
    assert [r["id"] for r in got] == [r[0] for r in by_value]


def test_places_of_ties_are_all_different_and_one_key_holds_most_rows(spark):
    df = spark.range(3000).select(F.lit(1).alias("id"), F.when(F.col("id") < 2500, "x").otherwise("y").alias("name"),
                                  F.lit("kept").alias("_row"))
    got = ranking.placed_by_label(df)
    assert got.columns == ["id", "name", "_row", "place"]
    assert sorted(r["place"] for r in got.collect()) == list(range(1, 3001))
    assert got.where("name = 'y'").agg(F.min("place")).first()[0] == 2501
    assert ranking.placed_by_label(df.limit(0)).count() == 0


def test_no_window_runs_over_the_table(spark):
    """Only the row counts of the partitions meet in one task."""
    placed = ranking.placed_by_label(spark.range(50_000).select("id", F.col("id").cast("string").alias("name")))
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ["):]
    assert "Aggregate [" in window.split("\n")[1] + window.split("\n")[2]


def edges_of(view):
    return {(r["src"], r["dst"]): r["w"] for r in view.edges().collect()}


def test_appended_batches_give_the_edges_of_all(spark, tmp_dir):
    rows = skewed_rows(3)
    random.Random(4).shuffle(rows)
    parts = [rows[i::5] for i in range(5)]
    view = EdgeView(spark, tmp_dir, block_rows=7)
    assert edges_of(view) == {}
    for i, part in enumerate(parts):
        again = part + parts[0][:20] + [(None, 1), (1, None)] + part[:5]      # rows that are there already
        assert view.append(i, spark.createDataFrame(again, ROWS))
        if i in (1, 3):
            view.compact()
        assert edges_of(view) == dict(pair_counts(r for p in parts[:i + 1] for r in p))
    view.compact()
    view.compact()
    assert edges_of(view) == dict(pair_counts(rows))


def test_a_replayed_or_cut_off_batch_counts_once(spark, tmp_dir, monkeypatch):
    rows = skewed_rows(5, works=40)
    half = len(rows) // 2
    view = EdgeView(spark, tmp_dir)
    view.append(0, spark.createDataFrame(rows[:half], ROWS))
    with monkeypatch.context() as m:            # the writer dies after the rows, before the delta
        m.setattr("coweave.operators.incremental.pairs_with_new", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            view.append(1, spark.createDataFrame(rows[half:], ROWS))
    assert edges_of(view) == dict(pair_counts(rows[:half])) and view.batches() == [0]
    again = EdgeView(spark, tmp_dir)            # a new writer replays it
    assert again.append(1, spark.createDataFrame(rows[half:], ROWS))
    assert not again.append(1, spark.createDataFrame(rows[half:], ROWS))
    assert not again.append(0, spark.createDataFrame(rows[:half], ROWS))
    assert edges_of(again) == dict(pair_counts(rows))


def test_only_pairs_with_a_new_row_are_made(spark):
    rows = [(1, m, m >= 8) for m in range(10)] + [(2, 1, False), (2, 2, False)]
    got = pairs_with_new(spark.createDataFrame(rows, "work_id bigint, member bigint, new boolean"), block_rows=3)
    want = sorted({tuple(sorted((a, b))) for a in (8, 9) for b in range(10) if a != b})
    assert sorted(tuple(r) for r in got.collect()) == want


def test_a_batch_is_dealt_by_its_rows_and_pairs(spark, tmp_dir, monkeypatch):
    asked = []
    monkeypatch.setattr("coweave.operators.incremental.partitions_for", lambda _, n: asked.append(n) or 3)
    view = EdgeView(spark, tmp_dir)
    first, second = [(w, m) for w in range(20) for m in range(4)], [(w, 9) for w in range(5)]
    view.append(0, spark.createDataFrame(first, ROWS))
    view.append(1, spark.createDataFrame(second, ROWS))
    assert asked == [80, 20 * 6, 85, 5 * 4]
    assert edges_of(view) == dict(pair_counts(first + second))
    assert "RepartitionByExpression [src#" in view.edges()._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_touched_works(spark):
    rows = [(1, 5, True), (1, 5, True), (1, 6, True), (1, 6, False), (1, 7, False), (2, 5, False), (3, 8, False), (3, 8, True)]
    works = touched_works(spark.createDataFrame(rows, "work_id bigint, member bigint, new boolean"))
    assert [(r["work_id"], r["news"], sorted(r["olds"])) for r in works.collect()] == [(1, [5], [6, 7])]
    assert sorted(tuple(r) for r in pairs_with_new(None, works=works).collect()) == [(5, 6), (5, 7)]
