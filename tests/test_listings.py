"""Clustered listings: round trip, index, appends, one-member reads."""

import os
import random

from coweave.operators import cooccur
from coweave.plans import io_queries
from coweave.sources import listings, text

FIELDS = "member bigint, members array<bigint>"


def some_lines(seed, members=300, hot=2000):
    rnd = random.Random(seed)
    lines = [(m, sorted(rnd.sample(range(1000), rnd.randint(1, 6)))) for m in range(members) for _ in range(rnd.randint(1, 4))]
    return lines + [(7, sorted(rnd.sample(range(1000), 4))) for _ in range(hot)]


def as_set(df):
    return sorted((r["member"], tuple(r["members"])) for r in df.collect())


def test_round_trip_and_appends(spark, tmp_dir):
    first, second = some_lines(1), some_lines(2, hot=5) + [(-5, [1, 2]), (7, [])]
    listings.write_listings(spark.createDataFrame(first + [(None, [1]), (3, None)], FIELDS), tmp_dir)
    assert as_set(listings.read_listings(spark, tmp_dir)) == sorted((m, tuple(x)) for m, x in first)
    listings.write_listings(spark.createDataFrame(second, FIELDS), tmp_dir, append="two")
    listings.write_listings(spark.createDataFrame(second, FIELDS), tmp_dir, append="two")      # run again
    both = listings.read_listings(spark, tmp_dir)
    assert as_set(both) == sorted((m, tuple(x)) for m, x in first + second)
    ids = [(r["file"], r["line_no"]) for r in both.collect()]
    assert len(ids) == len(set(ids))                       # a listing has an identity of its own
    files = sum(f.endswith(".parquet") for _, _, fs in os.walk(tmp_dir) for f in fs)
    assert files < 60                                      # and not one per member


def test_one_member_opens_the_files_of_the_index(spark, tmp_dir):
    lines = some_lines(3, hot=0)
    df = spark.createDataFrame(lines, FIELDS)
    # four ranges, whatever the small size
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listings.write_listings(df, tmp_dir, append="a")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    whole = listings.read_listings(spark, tmp_dir)
    assert len(whole.inputFiles()) == 4
    index = {}
    for r in listings.index_of(spark, tmp_dir).collect():
        index.setdefault(r["member"], []).append(r)
    # ranges end between members, but for one that lies on a bound
    assert sum(len(rows) for rows in index.values()) <= len(index) + 3
    for member in (0, 100, 299):
        got = listings.read_member(spark, tmp_dir, member)
        assert as_set(got) == sorted((m, tuple(x)) for m, x in lines if m == member)
        assert len(got.inputFiles()) == len(index[member]) <= 2
        assert sum(r["rows"] for r in index[member]) == got.count()
    assert listings.read_member(spark, tmp_dir, 12345).count() == 0


def test_a_member_with_most_rows_is_spread(spark, tmp_dir):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listings.write_listings(spark.createDataFrame(some_lines(4), FIELDS), tmp_dir)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    got = listings.read_member(spark, tmp_dir, 7)
    assert len(got.inputFiles()) > 1
    assert as_set(got) == sorted((m, tuple(x)) for m, x in some_lines(4) if m == 7)


def test_pairs_of_the_store_equal_those_of_the_lines(spark, tmp_dir):
    lines = [(101, [101, 205, 309]), (101, [101, 205]), (205, [101, 205])]
    listings.write_listings(spark.createDataFrame(lines, FIELDS), tmp_dir)
    edges = cooccur.cooccurrence_edges(text.membership_rows(listings.read_listings(spark, tmp_dir)))
    assert sorted(tuple(r) for r in edges.collect()) == [(101, 205, 3), (101, 309, 1), (205, 309, 1)]


def test_nothing_written_and_an_append_cut_off(spark, tmp_dir):
    assert listings.read_listings(spark, tmp_dir).count() == 0
    listings.write_listings(spark.createDataFrame([], FIELDS), tmp_dir, append="none")
    listings.write_listings(spark.createDataFrame([(1, [1, 2])], FIELDS), tmp_dir, append="cut")
    os.remove(f"{tmp_dir}/index/append=cut/_SUCCESS")       # the writer died before its end
    assert listings.read_listings(spark, tmp_dir).count() == 0
    listings.write_listings(spark.createDataFrame([(1, [1, 2])], FIELDS), tmp_dir, append="cut")
    assert as_set(listings.read_listings(spark, tmp_dir)) == [(1, (1, 2))]


def test_listings_are_dealt_by_the_number_of_rows(spark, tmp_dir, monkeypatch):
    rows = [(n % 20, n * 7 % 31) for n in range(60)] * 2 + [(None, 4), (3, None)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_dir}/lineitem.parquet")
    plain = sorted(map(str, io_queries._listings(spark, tmp_dir).collect()))
    monkeypatch.setattr(cooccur.partitions_for, "__defaults__", (10,))
    dealt = io_queries._listings(spark, tmp_dir)
    assert dealt.rdd.getNumPartitions() == 13 and sorted(map(str, dealt.collect())) == plain
