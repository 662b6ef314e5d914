"""Exact dedup: the index against a dict, the job against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from coweave.llm import exact_dedup as ed

FIELDS = "doc_id bigint, text string, digest string, kept int, row_key string"


def _key(n):
    return hashlib.sha256(str(n).encode()).digest()


def test_index_inserts_deletes_grows_and_verifies():
    rnd, index, live = random.Random(3), ed.CuckooIndex(buckets=2), {}
    for _ in range(6000):
        k = _key(rnd.randrange(1500))
        if k in live and rnd.random() < 0.4:
            assert index.delete(k)
            del live[k]
        elif k not in live:
            index.insert(k, rnd.random())
            live[k] = index.get(k)
        assert index.size == len(live)
    assert index.resizes > 3
    assert {k: v for k, v in index.items()} == live
    assert all(index.get(k) == v for k, v in live.items())
    assert not index.delete(_key("absent")) and index.get(_key("absent")) is None


def test_false_positive_of_the_filter_is_no_hit():
    index, k = ed.CuckooIndex(), bytearray(_key(1))
    index.insert(bytes(k), "a")
    k[20] ^= 1                                     # same filter places, another key
    assert bytes(k) in index.filter and index.get(bytes(k)) is None


def _brute(rows):
    groups = {}
    for d, t in rows:
        text = (t or "").encode().lower()
        groups.setdefault(text, []).append(d)
    out = []
    for d, t in rows:
        ids = groups[(t or "").encode().lower()]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), hashlib.sha256((t or "").encode().lower()).hexdigest()))
    return sorted(out, key=str)


def test_job_against_brute_force(spark):
    rnd = random.Random(5)
    texts = ["Abc", "aBC", "", None, "É x", "é x", "long " * 30_000, "ABC ", "\n"]
    rows = [(rnd.choice([None, *range(30)]), rnd.choice(texts)) for _ in range(200)]
    rows += [(7, "same row")] * 3 + [(None, "no id")] * 2
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], FIELDS).repartition(5)
    got = ed.exact_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == _brute(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got})          # one row of each group
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    stay = ed.drop_exact_duplicates(df)
    assert stay.columns == df.columns and stay.count() == len(kept)


def test_empty_table(spark):
    df = spark.createDataFrame([], FIELDS)
    assert ed.exact_duplicates(df).count() == 0 and ed.drop_exact_duplicates(df).count() == 0


def test_texts_that_stay_pass_the_filter(spark):
    # 3,000 texts, 300 of them copies; most of what stays is not joined with the list
    df = spark.createDataFrame([(n, f"text {n % 2700}") for n in range(3000)], "doc_id bigint, text string")
    bits = ed.LISTED_BITS * 2048
    listed = df.where("doc_id < 300").select(F.col("doc_id").alias("listed_id"),
                                             F.unhex(F.sha2("text", 256)).alias("listed_digest"))
    maps = ed._filter_of(listed, bits)
    assert maps.count() == 1
    bit = ed._bit_of(F.col("doc_id"), F.unhex(F.sha2("text", 256)), bits)
    met = {r["doc_id"] for r in df.withColumn("bit", bit).crossJoin(maps).where(ed._may_be_listed("bit", "maps")).collect()}
    assert met >= set(range(300)) and len(met) < 450
    stay = ed.drop_exact_duplicates(df)
    assert sorted(r["doc_id"] for r in stay.collect()) == list(range(300, 3000)) and stay.columns == df.columns
    empty = ed._filter_of(listed.limit(0), 2 * ed.BITMAP_BITS)
    assert not df.withColumn("bit", bit).crossJoin(empty).where(ed._may_be_listed("bit", "maps")).count()


def test_only_texts_that_may_be_listed_are_joined_with_the_list(spark):
    df = spark.createDataFrame([(n, f"text {n % 2700}") for n in range(3000)], "doc_id bigint, text string")
    for docs in (df, df.unionByName(df.where("doc_id = 2999"))):      # without and with a row repeated exactly
        stay = ed.drop_exact_duplicates(docs)
        lines = stay._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins = [n for n, line in enumerate(lines) if "Join " in line and "listed_digest" in line]
        assert joins and not [line for line in lines if "LeftAnti" in line or "LeftSemi" in line]
        # the filter stands below the join, before any text is shuffled for it
        for n in joins:
            assert "shiftright" in next(line for line in lines[n + 1:] if "Filter" in line or "Join " in line)
        assert sorted(r["doc_id"] for r in stay.collect()) == list(range(300, 3000))
