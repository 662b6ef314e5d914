"""Packing: tokens against the library, the plan against exhaustive search."""

import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from coweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def _reference_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_tokens_equal_the_library():
    texts = ["", "Hello, WORLD!! it's 12.5%", "a<|endoftext|>b <|startoftext|>", "ÀÉÎ ß İ Σς x́ ſ ª", "don't. U.S.A., x***",
             "tab\tline\n\x0bform\x0c nbsp em end \x1c\x1f", "日本語 テスト 😀😀 ok", "''' ,,, ... 're ll'", "word " * 5000]
    rnd = random.Random(1)
    alphabet = "aAbzÉß .,!*'\n\t09-éñ日"
    texts += ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(400)]
    got = packing.WordTokenizer(PATH, limit=50).packed([t.encode() for t in texts])
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == _reference_ids(texts)


def test_capitals_that_lowering_would_change():
    texts = ["<|ENDOFTEXT|> x<|StartOfText|>y <|endoftext|>Z A<|ENDOFTEXT|>", "J\u030c H\u0331 T\u0308 aJ\u030cB, W\u030a Y\u030a",
             "I\u0307 A\u030a \u00c5NGSTR\u00d6M \u00c9T\u00c9 caf\u00c9 Plain WORDS <| >| <|", "<|ENDOFTEXT| |> < |ENDOFTEXT|>"]
    rnd = random.Random(2)
    parts = ["<|", "ENDOFTEXT", "endoftext", "|>", "J", "T", "h", "\u030c", "\u0331", "\u0308", " ", "Ab,", "\u00c9"]
    texts += ["".join(rnd.choices(parts, k=rnd.randint(1, 12))) for _ in range(400)]
    got = packing.WordTokenizer(PATH, limit=50).packed([t.encode() for t in texts])
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == _reference_ids(texts)


def _check_plan(counts, plan, capacity):
    used = Counter()
    for n, items in plan:
        assert n > 0 and sum(w * k for w, k in items) <= capacity
        for w, k in items:
            used[w] += n * k
    assert used == Counter({w: n for w, n in counts.items() if n})


def _optimum(items, capacity):
    items = tuple(sorted(items, reverse=True))

    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        out = len(left)
        def fill(room, at, chosen):
            nonlocal out
            if at == len(rest):
                out = min(out, 1 + best(tuple(x for i, x in enumerate(rest) if i not in chosen)))
                return
            fill(room, at + 1, chosen)
            if rest[at] <= room:
                fill(room - rest[at], at + 1, chosen | {at})
        fill(capacity - first, 0, frozenset())
        return out
    return best(items)


def test_reduction_never_costs_a_sequence():
    rnd, fixed_some = random.Random(2), 0
    for _ in range(150):
        capacity = rnd.randint(5, 20)
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 8))]
        fixed, rest = packing.reduce_by_dominance(dict(Counter(items)), capacity)
        left = [w for w, n in rest.items() for _ in range(n)]
        _check_plan(Counter(items), fixed + [(1, ((w, 1),)) for w in left], capacity)
        n_fixed = sum(n for n, _ in fixed)
        fixed_some += n_fixed
        assert n_fixed + _optimum(left, capacity) == _optimum(items, capacity)
    assert fixed_some > 100


def test_best_fit_on_histograms_equals_piece_by_piece():
    rnd = random.Random(4)
    for _ in range(300):
        capacity = rnd.randint(3, 40)
        counts = Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60)))
        plan = packing.best_fit(dict(counts), capacity)
        _check_plan(counts, plan, capacity)
        rooms = []
        for w in sorted(counts.elements(), reverse=True):
            fit = [r for r in rooms if r >= w]
            room = min(fit) if fit else capacity
            if fit:
                rooms.remove(room)
            rooms.append(room - w)
        assert sum(n for n, _ in plan) == len(rooms)
        _check_plan(counts, packing.packing_plan(dict(counts), capacity), capacity)


def test_job_places_every_piece_once(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    rows = [(d, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for d in range(300)]
    rows += [(1000, "word " * 700), (None, None), (5, ""), (None, "x")] + [(9, "same row")] * 40
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows],
                               "doc_id bigint, text string, length int, sequence_id string").repartition(6)
    capacity = 64
    got = packing.pack_documents(df, PATH, capacity).collect()
    want = Counter()
    for (d, t), ids in zip(rows, _reference_ids([t or "" for _, t in rows])):
        ids = ids + [1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], np.uint32)
            want[d, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(places) <= 1.03 * total / capacity + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(df, PATH).count() == 0
