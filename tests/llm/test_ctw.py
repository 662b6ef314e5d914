"""Context-tree weighting against a plain recursion; unigram against counting."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from coweave.llm import ctw


def _log_kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Plain:
    """Context trees by dictionaries and recursion."""

    def __init__(self, texts):
        self.n, self.kids, self.memo = defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for t in texts:
            for ctx, node, bit in self.decisions(t):
                for d in range(ctw.DEPTH + 1):
                    self.n[ctx[:d], node][bit] += 1
                    if d < ctw.DEPTH:
                        self.kids[ctx[:d], node].add(ctx[:d + 1])

    @staticmethod
    def decisions(text):
        s = ctw.START + text.lower() + ctw.FINISH
        for i in range(ctw.DEPTH, len(s)):
            for level in range(8):
                yield s[i - ctw.DEPTH:i][::-1], (1 << level) | s[i] >> (8 - level), s[i] >> (7 - level) & 1

    def weighted(self, ctx, node):
        if (ctx, node) not in self.memo:
            own = _log_kt(*self.n.get((ctx, node), (0, 0)))
            below = sum(self.weighted(k, node) for k in self.kids.get((ctx, node), ()))
            self.memo[ctx, node] = own if len(ctx) == ctw.DEPTH else float(np.logaddexp(own, below)) - math.log(2)
        return self.memo[ctx, node]

    def one(self, ctx, node, d=0):
        a, b = self.n.get((ctx[:d], node), (0, 0))
        own = (b + .5) / (a + b + 1)
        if d == ctw.DEPTH:
            return own
        gap = sum(self.weighted(k, node) for k in self.kids.get((ctx[:d], node), ())) - _log_kt(a, b)
        w = 1 / (1 + math.exp(min(700, gap)))
        return w * own + (1 - w) * self.one(ctx, node, d + 1)

    def score(self, text):
        return sum(math.log10(p if bit else 1 - p) for ctx, node, bit in self.decisions(text)
                   for p in [self.one(ctx, node)])


def _held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1


def test_job_against_plain_models(spark):
    rnd = random.Random(3)
    words = ["The", "cat", "é", "sat,", "ON", "x\x00y", "mat"]
    rows = [(d, rnd.choice([" ", "\n "]).join(rnd.choices(words, k=rnd.randint(0, 12)))) for d in range(40)]
    rows += [(None, "no id"), (None, "no id"), (5, None), (6, ""), (6, ""), (41, "unseen Words zzz")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows],
                               "doc_id bigint, text string, block int, held_out string").repartition(3)
    train = [(t or "").encode() for d, t in rows if not _held_out(d)]
    counts = Counter(w for t in train for w in [*t.lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    plain = Plain(train)
    want = []
    for d, t in rows:
        t = (t or "").encode()
        tokens = [*t.lower().split(), b""]
        want.append((d, _held_out(d), len(tokens), sum(1 for w in tokens if counts[w]), n,
                     sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in tokens), plain.score(t)))
    for settings in ({}, {"block_bytes": 300, "bucket_bytes": 200}):
        got = [tuple(r) for r in ctw.score_documents(df, **settings).collect()]
        assert len(got) == len(want)
        for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-6)


def test_every_context_gives_a_distribution():
    texts = [b"abab abba", b"\xc3\xa9 b", b""]
    codes, n = ctw.block_codes(texts, [True] * 3)
    context = codes[0] >> np.uint64(8) << np.uint64(8)
    follow = np.sort(np.concatenate([codes, context | np.arange(256, dtype=np.uint64)]))
    follow = np.unique(follow)
    counts = np.where(np.isin(follow, codes), n[np.minimum(np.searchsorted(codes, follow), len(codes) - 1)], 0)
    top = ctw.TopOfTree(ctw.top_nodes(follow, counts))
    scores = top.code_lengths(follow, counts)
    mine = (follow >> np.uint64(8) << np.uint64(8)) == context
    assert mine.sum() == 256 and math.isclose((10 ** scores[mine]).sum(), 1.0, rel_tol=1e-9)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 1e3, 1e9])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_held_out_text_is_better_than_by_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = ctw.score_documents(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > r["b"]


def test_no_training_text_and_empty_table(spark):
    held = next(d for d in range(100) if _held_out(d))
    df = spark.createDataFrame([(held, "ab")], "doc_id bigint, text string")
    got = ctw.score_documents(df).first()
    assert (got["n_known"], got["train_tokens"]) == (0, 0)
    assert math.isclose(got["score"], 24 * math.log10(0.5), rel_tol=1e-6) and math.isclose(got["base_score"], 0.0, abs_tol=1e-9)
    assert ctw.score_documents(df.limit(0)).count() == 0


def test_one_common_ending(spark):
    # all contexts that matter end alike; blocks are summed in groups, and dealt by a third byte
    rnd = random.Random(5)
    rows = [(d, "".join(rnd.choice("abcd") + ". " for _ in range(30))) for d in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    plain = Plain([t.encode() for d, t in rows if not _held_out(d)])
    got = {r["doc_id"]: r["score"] for r in ctw.score_documents(
        df, block_bytes=200, bucket_bytes=300, sum_blocks=3, answer_blocks=4).collect()}
    assert len(got) == 30
    for d, t in rows:
        assert math.isclose(got[d], plain.score(t.encode()), rel_tol=1e-6)
    codes, _ = ctw.block_codes([t.encode() for _, t in rows], [True] * 30)
    tail = codes[codes >> np.uint64(32) == ord(" ") << 8 | ord(".")]
    assert len(set(ctw._bucket(tail, 1 << 20).tolist())) == 4


def test_rows_are_summed_as_they_come():
    rnd = np.random.default_rng(1)
    want, rows = Counter(), []
    for block in range(50):
        codes = np.unique(rnd.integers(0, 3000, 400).astype(np.uint64))
        n = rnd.integers(0, 9, len(codes))
        for c, k in zip(codes.tolist(), n.tolist()):
            want[c] += k
        rows.append((block, ctw.CONTEXTS, 7, ctw._pack_codes(codes), ctw._pack(n)))
    once = ctw._sum_contexts(ctw._side(rows[:20])).to_pylist() + ctw._sum_contexts(ctw._side(rows[20:])).to_pylist()
    codes, n = ctw._sum_codes(ctw._side([tuple(r.values()) for r in once]))
    assert dict(zip(codes.tolist(), n.tolist())) == want
