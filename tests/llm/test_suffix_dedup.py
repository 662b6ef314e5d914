"""Suffix-array dedup: the sorter against sorting, the job against brute force."""

import hashlib
import random

import numpy as np
import pytest

from coweave.llm import suffix_dedup as sd


def _symbols(strings):
    return np.concatenate([np.array([sd.PAD, *(x + sd.FIRST_BYTE if x >= 0 else sd.SEPARATOR for x in s), sd.SENTINEL],
                                    np.uint16) for s in strings])


def _sorted(sym):
    s = sym.tolist()
    pads = [i for i, x in enumerate(s) if x == sd.PAD] + [len(s)]
    return [i for a, b in zip(pads, pads[1:]) for i in sorted(range(a + 1, b), key=lambda i: s[i:b])]


def test_suffix_order():
    rnd = random.Random(1)
    for case in range(400):
        letters = [-1, 0, 1, 2][:rnd.randint(2, 4)]
        strings = [rnd.choices(letters, k=rnd.randint(0, 30)) for _ in range(rnd.randint(1, 5))]
        strings += [[0] * rnd.randint(0, 60), [0, 1] * rnd.randint(0, 20), [1, 0, 0] * rnd.randint(0, 9) + [1]]
        sym = _symbols(strings)
        assert sd.group_suffixes(sym).tolist() == _sorted(sym)


def test_equal_windows():
    rnd = random.Random(2)
    strings = [[bytes(rnd.choices(b"ab", k=rnd.randint(4, 40))) for _ in range(rnd.randint(1, 6))] for _ in range(30)]
    frag, offset, cls = sd.equal_windows(strings, 4)
    flat = [(n, f) for n, s in enumerate(strings) for f in s]
    seen = {}
    for f, o, c in zip(frag.tolist(), offset.tolist(), cls.tolist()):
        seen.setdefault(c, set()).add((flat[f][0], flat[f][1][o:o + 4]))
    assert all(len(v) == 1 for v in seen.values())
    assert len(seen) == len({(n, f[i:i + 4]) for n, f in flat for i in range(len(f) - 3)})
    assert len(frag) == sum(len(f) - 3 for _, f in flat)


def test_anchors_depend_on_the_window_alone():
    rnd = random.Random(3)
    text = bytes(rnd.choices(b"abc ", k=400))
    all_at_once = sd.window_anchors(text)
    assert [int(a) for a in all_at_once] == [int(sd.window_anchors(text[i:i + 50])[0]) for i in range(351)]
    anchors, first, last = sd.anchor_runs(text)
    assert (np.repeat(anchors, last - first) == all_at_once).all()
    assert len(sd.window_anchors(b"x" * 49)) == 0


def brute(rows, w):
    rank = lambda d: sd.NULL_ORD if d is None else d
    first = {}
    for d, t in rows:
        t = (t or "").encode()
        for i in range(len(t) - w + 1):
            first[t[i:i + w]] = min(rank(d), first.get(t[i:i + w], rank(d)))
    out = []
    for d, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if first[t[i:i + w]] < rank(d):
                gone[i:i + w] = b"\1" * w
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _corpus(rnd):
    words = ["the", "of", "thré", "ing", "ndsh", "über", "a", "tion,"]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(12, 40))) for _ in range(8)]
    rows = []
    for d in range(120):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(words, k=rnd.randint(1, 40)))
                 for _ in range(rnd.randint(0, 4))]
        rows.append((d, rnd.choice([" ", ""]).join(parts)))
    rows += [(200 + i, rows[5 + i % 3][1]) for i in range(9)]                # copies
    rows += [(300, "a" * 500), (301, "b" + "a" * 300), (302, "ab" * 200), (303, "ab" * 60), (304, "x" * 49), (305, "x" * 49)]
    rows += [(400, None), (401, ""), (None, passages[0] * 2), (None, passages[0] * 2), (7, passages[1]), (7, passages[1]),
             (402, passages[2] * 400)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 3000, "runs_per_string": 2}, {"block_bytes": 500, "runs_per_string": 1}])
def test_job_against_brute_force(spark, settings):
    rows = _corpus(random.Random(4))
    df = spark.createDataFrame([(d, t, "b", 3) for d, t in rows],
                               "doc_id bigint, text string, body string, block int").repartition(5)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                  for r in sd.remove_repeats(df, **settings).collect()), key=str)
    assert got == brute(rows, 50)


def test_other_window_lengths(spark):
    rows = _corpus(random.Random(5))[:80]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in sd.remove_repeats(df, 24).collect()), key=str)
    assert got == brute(rows, 24)
    with pytest.raises(ValueError):
        sd.remove_repeats(df, 23)


def test_documents_keep_their_columns(spark):
    passage = "é" * 40 + " shared passage of more than fifty bytes that repeats, é"
    df = spark.createDataFrame([(1, passage, "en", 5, [1]), (2, "own " + passage + " end", "de", 6, None), (3, None, None, 0, [])],
                               "doc_id bigint, text string, lang string, n_chars bigint, carried_0 array<int>")
    got = {r["doc_id"]: r for r in sd.drop_repeats(df).collect()}
    assert sd.drop_repeats(df).columns == df.columns
    assert got[1]["text"] == passage and got[1]["n_chars"] == len(passage)
    assert (got[2]["text"], got[2]["lang"], got[2]["carried_0"], got[2]["n_chars"]) == ("own  end", "de", None, 8)
    assert (got[3]["text"], got[3]["n_chars"], got[3]["carried_0"]) == ("", 0, [])


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
