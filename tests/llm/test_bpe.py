"""Byte-level BPE against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)
ours = bpe.RankArrayBpe(PATH)
parts = st.lists(st.one_of(st.text(max_size=6), st.sampled_from(
    [" ", "  ", "   ", "\n", "\n\n", "\t ", "\xa0", " ", "'s", "'LL", "<|endoftext|>", "<|endof", "word", " word", "123", "é", "日本", "😀", "\r\n"])),
    max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(parts)
def test_ids_and_text_equal_the_library(text):
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    packed = ours.encode_packed(text)
    assert np.frombuffer(packed, np.uint32).tolist() == ids
    assert ours.decode_packed(packed).decode("utf-8", "replace") == REFERENCE.decode(ids, skip_special_tokens=False)


def test_long_words_and_small_caches():
    small = bpe.RankArrayBpe(PATH)
    small.by_word.limit = small.by_chunk.limit = 3
    for text in ("a" * 3000, "ab" * 700 + " " * 50 + "z", "one two three four five six " * 30):
        assert np.frombuffer(small.encode_packed(text), np.uint32).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


def test_job(spark):
    rows = [(1, "Hello  world"), (2, None), (2, ""), (None, "<|endoftext|>x"), (3, "tie"), (3, "tie"), (4, "long words " * 30_000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, ids int, body string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in rows:
        ids = REFERENCE.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(np.array(ids, np.uint32).tobytes()),
                     sha(REFERENCE.decode(ids, skip_special_tokens=False).encode())))
    assert sorted((tuple(r) for r in bpe.round_trip_digests(df, PATH).collect()), key=str) == sorted(want, key=str)
    back = bpe.decode_documents(bpe.encode_documents(df, PATH), PATH)
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0


def test_words_of_any_length_in_seconds():
    """Both routes merge alike; a word of a megabyte takes seconds."""
    rnd = random.Random(6)
    kinds = [lambda n: "a" * n, lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n)),
             lambda n: "".join(rnd.choices("ACGT", k=n)), lambda n: "".join(rnd.choices("日本語の文字", k=n)),
             lambda n: "".join(rnd.choices("=+/Ab9", k=n)), lambda n: "ab" * (n // 2), lambda n: "1" * n]
    for kind in kinds:
        for n in (bpe.LONG_WORD // 2, bpe.LONG_WORD - 1, bpe.LONG_WORD, bpe.LONG_WORD + 1, 5000):
            text = kind(n)
            ids = np.frombuffer(ours.encode_packed(text), np.uint32).tolist()
            assert ids == REFERENCE.encode(text, add_special_tokens=False).ids
        word = kind(400).encode()
        assert ours.encode_word(word[:bpe.LONG_WORD]) == ours.encode_long_word(word[:bpe.LONG_WORD])
    for kind in kinds[:2]:
        text = kind(1_000_000)
        began = time.perf_counter()
        packed = ours.encode_packed(text)
        assert time.perf_counter() - began < 60
        assert ours.decode_packed(packed).decode() == text
        assert np.frombuffer(packed, np.uint32).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids
    assert all(len(k) <= bpe.CACHED_CHARS for k in [*ours.by_word, *ours.by_chunk])
