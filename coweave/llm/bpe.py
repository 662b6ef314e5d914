"""Byte-level BPE encoding and decoding on a contiguous rank array.

A word (one piece of the pre-tokenizer's split) is held as an array of part
boundaries and an equally long array of ranks, ``rank[i]`` being the merge
rank of part i with part i + 1.  The encoder scans the ranks for the minimum
(leftmost on ties), deletes that boundary and refreshes the ranks of the two
neighbours, until no pair can merge.

Words are short, so the scan beats a heap; the ids of words seen before come
from a bounded cache in each task.  The scan's cost is quadratic, though, and a
text may hold one "word" of a million letters: beyond ``LONG_WORD`` bytes the
parts are linked to their neighbours and a heap finds the minimum, with the same
merges in the same order.  Long words are not cached.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import BoundedCache, ids_and_texts, per_batch

# Fixed value: the split of this family of byte-level vocabularies.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NO_RANK = 1 << 60
LONG_WORD = 512          # bytes of the longest word whose ranks are scanned
CACHED_CHARS = 128       # longest chunk that is cached


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself
    where printable, else the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    out.update({chr(256 + n): b for n, b in enumerate(rest)})
    return out


class ShortCache(BoundedCache):
    """A cache that only keeps short texts, so its bytes are bounded, too."""

    def __missing__(self, key):
        return super().__missing__(key) if len(key) <= CACHED_CHARS else self.fill(key)


def pack(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class RankArrayBpe:
    """Encoder and decoder for a ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        # a pair of adjacent ids -> its rank (place in the merge list) with the
        # merged id in the low 16 bits, so the least code is the least rank
        self.merges: dict[int, int] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.merges.setdefault(self.ids[a] << 16 | self.ids[b], n << 16 | self.ids[a + b])
        self.of_byte = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: t for t, i in self.ids.items()}
        self.tokens.update({i: t.encode() for t, i in self.special.items()})
        self.split_special = (regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special else None)
        self.by_word = ShortCache(lambda w: pack(self.encode_word(w.encode())))
        self.by_chunk = ShortCache(lambda c: b"".join(
            map(self.by_word.__getitem__, WORDS.findall(c))))

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word.  Part i is ``word[start[i]:start[i + 1]]`` with the
        id ``part[i]``."""
        if len(word) > LONG_WORD:
            return self.encode_long_word(word)
        start = list(range(len(word) + 1))
        part = list(map(self.of_byte.__getitem__, word))
        code = self.merges.get
        rank = [code(a << 16 | b, NO_RANK) for a, b in zip(part, part[1:])]
        while rank:
            least = min(rank)
            if least == NO_RANK:
                break
            i = rank.index(least)
            part[i] = least & 0xFFFF
            del start[i + 1], part[i + 1], rank[i]
            if i < len(rank):
                rank[i] = code(part[i] << 16 | part[i + 1], NO_RANK)
            if i:
                rank[i - 1] = code(part[i - 1] << 16 | part[i], NO_RANK)
        return part

    def encode_long_word(self, word: bytes) -> list[int]:
        """Ids of a word of any length in n log n steps: the pairs wait in a
        heap by rank, then place (leftmost first).  A pair that has changed
        since is known by its code and passed over."""
        part = list(map(self.of_byte.__getitem__, word))
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        code = self.merges.get
        now = [code(a << 16 | b, NO_RANK) for a, b in zip(part, part[1:])] + [NO_RANK]
        heap = [(c, i) for i, c in enumerate(now) if c != NO_RANK]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            least, i = pop(heap)
            if now[i] != least:
                continue
            gone = after[i]
            part[i], part[gone] = least & 0xFFFF, -1
            now[gone] = NO_RANK
            after[i] = nxt = after[gone]
            if nxt < n:
                before[nxt] = i
                now[i] = c = code(part[i] << 16 | part[nxt], NO_RANK)
                if c != NO_RANK:
                    push(heap, (c, i))
            else:
                now[i] = NO_RANK
            prev = before[i]
            if prev >= 0:
                now[prev] = c = code(part[prev] << 16 | part[i], NO_RANK)
                if c != NO_RANK:
                    push(heap, (c, prev))
        return [p for p in part if p >= 0]

    def encode_packed(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if self.split_special is None:
            return self._ordinary(text)
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out.append(self._ordinary(part))
        return b"".join(out)

    def _ordinary(self, text: str) -> bytes:
        # Where no two white space characters meet, the split never crosses a
        # blank, so " " + the run up to the next blank is a unit of its own.
        if TWO_SPACES.search(text):
            return b"".join(map(self.by_word.__getitem__, WORDS.findall(text)))
        first, *rest = text.split(" ")
        get = self.by_chunk.__getitem__
        return (get(first) if first else b"") + b"".join(map(get, map(" ".__add__, rest)))

    def decode_packed(self, ids: bytes) -> bytes:
        """Bytes of the tokens, special ones included."""
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


TWO_SPACES = regex.compile(r"\s\s")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> RankArrayBpe:
    """The file's tokenizer, built once in each Python worker."""
    return RankArrayBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary) for every row of ``docs`` (doc_id, text): the
    token ids packed as little-endian unsigned 32-bit integers.

    Special tokens written out in a text become their id, nothing is added.
    Null text counts as empty (no ids); null, repeated or tied doc_ids are
    carried as they are; an empty table gives an empty result.
    """
    @per_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path)
        ids = [bpe.encode_packed(t.decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())],
                                          names=["doc_id", "ids"])
    return ids_and_texts(docs).mapInArrow(run, "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) back from (doc_id, ids); bytes that are not UTF-8 become
    the replacement character.  A null list of ids gives an empty text."""
    @per_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path)
        texts = [bpe.decode_packed(i or b"").decode("utf-8", "replace")
                 for i in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                          names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and
    decoded again in one task, so that ids never leave it."""
    @per_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path)
        n, ids_sha, text_sha = [], [], []
        for t in batch.column(1).to_pylist():
            ids = bpe.encode_packed(t.decode("utf-8", "replace"))
            back = bpe.decode_packed(ids).decode("utf-8", "replace").encode()
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(back).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return ids_and_texts(docs).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
