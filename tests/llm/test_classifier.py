"""Importance resampling: held-out accuracy, exact top-k, odd inputs."""

import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from coweave.llm import classifier as cl

SF = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id bigint, text string, kept string, n int", "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen, unseen = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = cl.classify(docs, seen).join(unseen, "doc_id")
    rate = {(r["quality"], r["toxic"]): r["kept"] for r in got.groupBy("quality", "toxic").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1, 0] >= 0.97                      # clean documents stay
    assert rate[0, 0] <= 0.1                       # junk goes
    assert rate[1, 1] <= 0.9


def test_kth_largest_is_exact(spark):
    rnd = np.random.default_rng(1)
    for values in (rnd.normal(size=3000), np.repeat([1.0, 2.0, 5.0], [1, 500, 3]), [3.5], [-1e300, 0.0, 1e300, 1e-300]):
        values = sorted(map(float, values), reverse=True)
        df = spark.createDataFrame([(v,) for v in values], "key double")
        for k in {1, 2, len(values) // 2 or 1, len(values)}:
            if k <= len(values):
                assert cl._kth_largest(df, k) == values[k - 1]
    assert cl._kth_largest(df, 0) is None


def test_odd_rows_and_repeats(spark):
    good, junk = "plain words in a good sentence. ", "!!XX## "
    rows = [(i, good * 5) for i in range(40)] + [(100 + i, junk * 20) for i in range(10)]
    rows += [(200, None), (201, ""), (202, "x"), (None, good), (None, good), (3, good * 5), (204, good * 20_000)]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], DOCS).repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(30, 1, None), (None, 1, 0), (5, 0, 0), (31, None, None)]
                                   + [(100 + i, 0, 0) for i in range(4)] + [(6, 1, 0)], LABELS)
    got = cl.classify(df, labels).collect()
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        kept.setdefault(r["doc_id"], set()).add(r["kept"])
    assert all(len(v) == 1 for v in kept.values())             # repeats share a decision
    assert all(kept[i] == {True} for i in range(40)) and all(kept[100 + i] == {False} for i in range(10))
    assert kept[200] == kept[201] == {True} and len(kept[204]) == 1
    stay = cl.keep_target_like(df, labels)
    assert stay.columns == df.columns and stay.where("doc_id between 100 and 109").count() == 0


def test_no_labels_keep_all_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (2, None, "x", 1)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r["kept"] for r in cl.classify(df, none).collect()] == [True, True]
    some = spark.createDataFrame([(77, 1, 0)], LABELS)
    assert [r["kept"] for r in cl.classify(df, some).collect()] == [True, True]
    assert cl.classify(df.limit(0), none).count() == 0 and cl.classify(df.limit(0), some).count() == 0


def _spark_hash(doc_id, seed):
    """xxhash64(doc_id, seed) as Spark has it: chained, from seed 42, signed."""
    h = xxhash.xxh64_intdigest((doc_id % 2 ** 64).to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), h)


def _noise(doc_id, seed):
    u = ((_spark_hash(doc_id, seed) >> 11) + 0.5) / 2 ** 53
    return -math.log(-math.log(u))


def _buckets(text):
    b = b"\n" + text.encode() + b"\n"
    grams = [int.from_bytes(b[i:i + cl.NGRAM], "big") for i in range(len(b) - cl.NGRAM + 1)]
    return [g * 0x9E3779B97F4A7C15 % 2 ** 64 >> (64 - 18) for g in grams]


def _model(docs, target, seed):
    """(log_ratio, key, kept) of every document, one formula after the other."""
    signed = lambda h: h - 2 ** 64 if h >> 63 else h
    order = sorted(target, key=lambda d: (signed(_spark_hash(d, seed)), d))
    held = {d for n, d in enumerate(order) if n % cl.CALIBRATION == 0}
    raw, good = {}, {}
    for d, text in docs:
        for g in _buckets(text):
            raw[g] = raw.get(g, 0) + 1
            if d in set(order) - held:
                good[g] = good.get(g, 0) + 1
    logp = lambda c, g: math.log((c.get(g, 0) + cl.SMOOTHING) / (sum(c.values()) + cl.SMOOTHING * cl.BUCKETS))
    table = {g: logp(good, g) - logp(raw, g) for g in raw}
    total = {d: (sum(table[g] for g in _buckets(t)), len(_buckets(t))) for d, t in docs}
    mean = round(float(np.mean([total[d][0] / total[d][1] for d in held if total[d][1]])), 9)
    ratio = {d: (s + cl.SHRINK * mean) / (n + cl.SHRINK) for d, (s, n) in total.items()}
    key = {d: cl.SHARPNESS * r + _noise(d, seed) for d, r in ratio.items()}
    at = sorted(ratio[d] for d in held)
    least = at[max(0, math.ceil(cl.CLEAN_LOSS * len(at)) - 1)]
    k = sum(r >= least for r in ratio.values())
    cut = sorted(key.values(), reverse=True)[k - 1]
    return {d: (ratio[d], key[d], key[d] >= cut) for d in ratio}


def test_scores_and_draw_equal_a_plain_model(spark):
    rnd = random.Random(11)
    words = ["plain", "good", "words", "of", "a", "sentence", "and", "some", "more"]
    junk = ["!!", "xx9", "##", "q0", "zz"]
    docs = [(i, " ".join(rnd.choices(words if i % 3 else junk, k=rnd.randint(0, 40)))) for i in range(160)]
    target = [i for i in range(0, 160) if i % 3 and i % 2]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS).repartition(3)
    labels = spark.createDataFrame([(d, 1, 0) for d in target], LABELS)
    for seed in (42, 7, 2024):
        want = _model(docs, target, seed)
        got = cl.classify(df, labels, seed=seed).collect()
        assert len(got) == len(docs)
        for r in got:
            ratio, key, kept = want[r["doc_id"]]
            assert math.isclose(r["log_ratio"], ratio, rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(r["key"], key, rel_tol=1e-7, abs_tol=1e-7) and r["kept"] == kept


def test_the_noise_draws_in_proportion_to_the_weights(spark):
    """Of two kinds of documents, one e times as heavy, the k largest keys hold
    as many of each as draws without replacement do, whatever the seed."""
    n, k, shares = 6000, 1500, []
    df = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("double").alias("w"))
    for seed in (1, 2, 3, 4):
        top = df.withColumn("key", F.col("w") + cl.gumbel("doc_id", seed)).orderBy(F.desc("key")).limit(k)
        shares.append(top.agg(F.avg("w")).first()[0])
    rnd = np.random.default_rng(0)
    weight = np.exp(np.arange(n) % 2.0)
    drawn = [(rnd.choice(n, k, replace=False, p=weight / weight.sum()) % 2).mean() for _ in range(20)]
    assert abs(np.mean(shares) - np.mean(drawn)) < 0.02 and max(shares) - min(shares) < 0.08
