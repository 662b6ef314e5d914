"""SimHash: fingerprints and classes against brute force."""

import random
import re

import numpy as np
import xxhash

from coweave.llm import simhash
from coweave.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _fingerprint(text):
    words = WORD.findall(text.encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _classes(rows, max_bits):
    fps = [_fingerprint(t or "") for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_fingerprints():
    rnd = random.Random(1)
    texts = ["", " \t\n", "one", "Two words", "É \x1c é\xa0x y z", "a b c " * 40_000]
    texts += [" ".join(rnd.choices(["the", "Cat", "sat", "ON"], k=rnd.randint(0, 30))) for _ in range(100)]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [_fingerprint(t) for t in texts]


def _corpus(rnd):
    words = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for _ in range(25):
        base = rnd.choices(words, k=200)
        for _ in range(rnd.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((d, " ".join(copy)))
            d += 1
    return rows


def test_classes_against_all_pairs(spark):
    rnd = random.Random(8)
    rows = _corpus(rnd) + [(900, None), (901, ""), (902, "\n"), (903, "x"), (903, "x"), (None, "x"), (None, "lonely id")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t, 5, "c") for d, t in rows],
                               "doc_id bigint, text string, fp int, component_id string").repartition(4)
    for max_bits in (3, 1, 5):
        got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"])
                      for r in simhash.simhash_classes(df, 3, max_bits).collect()), key=str)
        assert got == _classes(rows, max_bits)
    kept = simhash.keep_class_representatives(df)
    want = {c for _, _, c in _classes(rows, 3)}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == df.columns


def test_hot_lists_lose_no_link(spark):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(12):
            f ^= 1 << rnd.randrange(64)            # chains of near prints
            fps.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")

    def roots(**kw):
        return {(r["node"], r["root"]) for r in components(simhash.near_links(df, 3, **kw)).collect()}
    plain = roots()
    assert plain and plain == roots(hot_list=1) == roots(hot_list=3)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (-5, -9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(300)}, -5: -9, -9: -9}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.simhash_classes(df).count() == 0


def test_a_row_stays_by_its_own_class(spark):
    """Rows that share a doc_id may be of different classes."""
    a, b = "one two three four five six seven", "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, "only without an id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, go_id int")
    got = simhash.keep_class_representatives(df, 3, 3)
    assert got.columns == df.columns
    assert sorted((tuple(r)[:2] for r in got.collect()), key=str) == sorted(
        [(1, a), (2, b), (None, "only without an id")], key=str)


def test_long_lists_are_linked_alike_by_neighbours_and_by_pairs(monkeypatch):
    """20,000 fingerprints that agree in five bytes, some of them near each other."""
    rnd = np.random.default_rng(2)
    fps = np.unique(rnd.integers(0, 1 << 24, 20_000, dtype=np.uint64) | np.uint64(0xABCDEF0123 << 24))
    rnd.shuffle(fps)

    def classes(links):
        forest = simhash._Forest(len(fps))
        for u, v in links:
            assert u < v and int(fps[u] ^ fps[v]).bit_count() <= 3
            forest.join(u, v)
        return [forest.find(i) for i in range(len(fps))]
    monkeypatch.setattr(simhash, "FLIP_COST", 0)
    by_neighbours = simhash.list_links(fps, 3)
    monkeypatch.setattr(simhash, "FLIP_COST", 1 << 40)
    by_pairs = simhash.list_links(fps[:6000], 3)
    monkeypatch.setattr(simhash, "FLIP_COST", 0)
    few = simhash.list_links(fps[:6000], 3)
    assert classes(few) == classes(by_pairs) and len(few) == len(by_pairs)
    assert len(by_neighbours) < len(fps)
    masks = simhash.flip_masks(fps, 3)
    assert len(masks) == 24 + 24 * 23 // 2 + 24 * 23 * 22 // 6 == simhash._flip_count(fps, 3)
