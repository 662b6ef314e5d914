"""Ranked search against a plain model that scores every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from coweave.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id bigint, text string, score int, term string", "item_id bigint, text string, rank int, block int"


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def model(docs, items, k):
    counts = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in wanted.items():
        found = []
        for doc_id, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(total, 1)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in query.items() if c[t])
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, n + 1, d, -s) for n, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k, **how):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS).repartition(9)        # as many blocks
    i = spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS)
    got = lexical.search(lexical.build_index(d), lexical.item_terms(i), k, **how)
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Straße", "日本", "İ", "a-b", "x_y", "42"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(rnd.randint(0, n), " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))) for _ in range(n)], rnd, words


def test_equals_scoring_every_document(spark):
    docs, rnd, words = corpus(3, 1500)
    docs += [(None, "w1 w2"), (5, None), (6, ""), (7, "--- !!"), (9, "w3 " * 50_000)] + docs[:20] * 5
    items = [(i, " ".join(rnd.sample(words, 12)) + " w0 W0, w1") for i in range(40)]
    items += [(3, "again w5"), (None, "w7 w8"), (90, None), (91, ""), (92, "unknownword"), (93, "w0 w0 w0")]
    assert run(spark, docs, items, 20) == model(docs, items, 20)
    assert run(spark, docs, items, 3, item_rows=7) == model(docs, items, 3)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(50, 0, -1)] + [(i, "other") for i in range(100, 160)]
    items = [(1, "same words")]
    got = run(spark, docs, items, 20)
    assert got == model(docs, items, 20) and {d for _, _, d, _ in got} == set(range(1, 21))


def test_empty_tables(spark):
    some = [(1, "a b")]
    assert run(spark, [], some, 5) == run(spark, some, [], 5) == run(spark, [(1, None)], some, 5) == []


def test_accumulators_stop_and_scores_stay_exact():
    """Rare terms decide: the common term's postings make no accumulators."""
    n = 5000
    block = lexical.Postings(list(range(n)), np.full(n, 20, np.int64), n, 20 * n)
    pack = lambda x: np.array(x, np.uint32).tobytes()
    rare = list(range(100, 130))
    block.add(b"rare", pack(rare), pack([3] * 30))
    block.add(b"other", pack(rare[:25]), pack([2] * 25))
    block.add(b"common", pack(range(n)), pack([1] * n))
    at, score, made = block.best([(b"rare", 8000), (b"other", 7000), (b"common", 10)], 20)
    assert made == 30
    share = {t: dict(zip(a.tolist(), s.tolist())) for t, (a, s, _) in block.of_term.items()}
    assert dict(zip(at.tolist(), score.tolist())) == {
        d: 8000 * share[b"rare"][d] + 7000 * share[b"other"][d] + 10 * share[b"common"][d] for d in rare[:25]}
