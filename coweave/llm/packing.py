"""Best-fit packing of token sequences after a Martello-Toth reduction.

Lengths are whole numbers up to the capacity, so an instance of any size is
its histogram: at most ``capacity`` rows, the one thing that reaches the
driver.  There

1. the reduction permanently fixes small sets that dominate every other way
   to fill a sequence: a piece that nothing fits beside, a piece and its best
   partner where only one more fits or the two fill the sequence exactly, or
   where the best partner is at least as long as any two that fit instead;
2. what remains is packed best-fit decreasing, a whole class of equal
   sequences at a time.

The plan is a list of patterns ("so many sequences of these lengths").  The
pieces of each length are numbered without a global order (counts per salt,
prefix sums of those, row numbers within a salt), so a length that a third of
all rows share is still numbered by many tasks; the number picks the place.
"""

from __future__ import annotations

import functools
import os
import re
import string
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BoundedCache, ids_and_texts, per_batch

SALTS = 256
MARKS = string.punctuation.encode()
# opening of a special token, or a character from U+0100 on, in UTF-8
AS_WRITTEN = re.compile(rb"<\||[\xc4-\xff]")
# letters that are one character each in lower case and composed form
PLAIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


# --------------------------------------------------------------------------
# tokens

class WordTokenizer:
    """``tokenizers`` file that drops white space and never merges across it:
    a text is encoded chunk by chunk (split at ASCII blanks), and each chunk
    once while the cache holds it.  Chunks not yet known are gathered over
    some documents, and plain words encoded together in one call."""

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        vocabulary = self.encoder.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.limit = limit

    def _encode(self, text: str):
        return self.encoder.encode_batch_fast([text], add_special_tokens=False)[0]

    def _chunk(self, chunk: bytes) -> bytes:
        return np.array(self._encode(chunk.decode("utf-8", "replace")).ids, np.uint32).tobytes()

    def _words(self, words: list[bytes]) -> None:
        """Learn plain words: each is one piece of the split, so it ends at the
        next token that ends a word."""
        for at in range(0, len(words), 2_000):
            part = words[at:at + 2_000]
            ids = np.array(self._encode(b" ".join(part).decode()).ids, np.uint32)
            cuts = [0, *(np.flatnonzero(self.ends_word[ids]) + 1).tolist()]
            if len(cuts) != len(part) + 1:
                raise ValueError("the tokenizer splits plain words")
            self.cache.update(zip(part, (ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:]))))

    def _learn(self, chunks: set[bytes]) -> None:
        marked, words, others = [], set(), []
        for chunk in chunks:
            # letters are split from the marks behind them anyway
            word = chunk.rstrip(MARKS)
            if PLAIN.fullmatch(word.decode("utf-8", "replace")):
                if word not in self.cache:
                    words.add(word)
                if word != chunk:
                    marked.append((chunk, word))
            else:
                others.append(chunk)
        self._words(list(words))
        get = BoundedCache(self._chunk).__getitem__      # marks
        self.cache.update((chunk, self.cache[word] + get(chunk[len(word):])) for chunk, word in marked)
        self.cache.update((chunk, self._chunk(chunk)) for chunk in others)

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers.  The
        vocabulary is lower case, so A-Z may be lowered beforehand where that
        changes nothing else: in chunks of characters below U+0100, which nothing
        composes with (composing comes before lowering), without the opening of
        a special token (those are matched as written)."""
        out = []
        for at in range(0, len(texts), 256):
            chunks = [[c if AS_WRITTEN.search(c) else c.lower() for c in t.split()]
                      if AS_WRITTEN.search(t) else t.lower().split() for t in texts[at:at + 256]]
            if len(self.cache) > self.limit:
                self.cache.clear()
            self._learn(set().union(*chunks).difference(self.cache))
            out += [b"".join(map(self.cache.__getitem__, c)) for c in chunks]
        return out


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1,
                 with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the ids of every
    document and one end id, cut into pieces of at most ``capacity``.

    Null text counts as empty and leaves the end id alone.  Repeated rows give
    repeated pieces; an empty table gives none.
    """
    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    names = [f.split()[0] for f in fields.split(", ")] + ["ids"] * with_ids
    end = int(end_id).to_bytes(4, "little")

    @per_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names]
        packed = tokenizer(path).packed(batch.column(1).to_pylist())
        for doc_id, ids in zip(batch.column(0).to_pylist(), packed):
            ids += end
            for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                row = (doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), part)
                for c, v in zip(cols, row):
                    c.append(v)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
    return ids_and_texts(docs).mapInArrow(run, fields + ", ids binary" * with_ids)


# --------------------------------------------------------------------------
# the plan: (number of equal sequences, ((length, how many), ...))

Pattern = tuple[int, tuple[tuple[int, int], ...]]


class _Sizes:
    """Histogram with its lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, w: int, t: int) -> None:
        self.n[w] -= t
        if not self.n[w]:
            del self.n[w]
            self.order.pop(bisect_left(self.order, w))

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for w in self.order[:k]:
            out += [w] * min(self.n[w], k - len(out))
            if len(out) == k:
                break
        return out

    def largest_up_to(self, room: int) -> int | None:
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def best_pair(self, room: int) -> int:
        """Largest sum of two pieces that is at most ``room`` (0: none fits)."""
        lo, hi, best = 0, bisect_right(self.order, room) - 1, 0
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if a + b > room or (lo == hi and self.n[a] < 2):
                hi -= 1
            else:
                best = max(best, a + b)
                lo += 1
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sets fixed for good, and the histogram that is left.

    Each rule is the dominance criterion: any other set that holds the piece
    can be exchanged for the fixed one without needing another sequence.  A
    rule that holds once goes on to hold while both lengths last, since taking
    pieces away only shrinks the alternatives, so equal sets are fixed together.
    """
    sizes, fixed = _Sizes(counts), []
    again = True
    while again:
        again = False
        for w in list(reversed(sizes.order)):
            while sizes.n.get(w):
                room = capacity - w
                sizes.n[w] -= 1                      # the piece itself, set aside
                if not sizes.n[w]:
                    sizes.take(w, 0)
                few, mate = sizes.smallest(3), sizes.largest_up_to(room)
                pair = sizes.best_pair(room) if mate and len(few) > 2 and sum(few) > room else 0
                if w in sizes.n:
                    sizes.n[w] += 1
                else:
                    sizes.n[w] = 1
                    insort(sizes.order, w)
                if mate is None:
                    t = sizes.n[w]
                    fixed.append((t, ((w, 1),)))
                    sizes.take(w, t)
                    again = True
                    break
                only_one = len(few) < 2 or few[0] + few[1] > room
                two_at_most = len(few) < 3 or sum(few) > room
                if len(few) == 2 and not only_one:
                    pair = sum(few)
                if not (mate == room or only_one or (two_at_most and mate >= pair)):
                    break
                if mate == w:
                    t = sizes.n[w] // 2
                    fixed.append((t, ((w, 2),)))
                    sizes.take(w, 2 * t)
                else:
                    t = min(sizes.n[w], sizes.n[mate])
                    fixed.append((t, ((w, 1), (mate, 1))))
                    sizes.take(w, t)
                    sizes.take(mate, t)
                again = True
    return fixed, sizes.n


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram.  Equal pieces fill the fullest
    sequence they fit into until none fits, then the next, so a class of
    equal sequences is filled in one step."""
    by_room: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, items: tuple) -> None:
        if n:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((n, items))

    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            k = bisect_left(rooms, w)
            if k == len(rooms):
                room, bins, items = capacity, left, ()
            else:
                room = rooms[k]
                bins, items = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[k]
            each = room // w
            full = min(bins, left // each)
            put(room - each * w, full, (*items, (w, each)))
            left -= full * each
            bins -= full
            if bins and 0 < left < each:
                put(room - left * w, 1, (*items, (w, left)))
                bins, left = bins - 1, 0
            if items:
                put(room, bins, items)
    return [p for group in by_room.values() for p in group]


def packing_plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(plan: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Per length, ranges of piece numbers that share one rule: sorted keys
    (length << 50 | first number), pieces a sequence, first sequence, offset."""
    used: dict[int, int] = {}
    rows, first_seq = [], 0
    for n, items in plan:
        offset = 0
        for w, each in items:
            rows.append((w << 50 | used.get(w, 0), each, first_seq, offset))
            used[w] = used.get(w, 0) + n * each
            offset += w * each
        first_seq += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T.copy())


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` with a column ``length`` (1 to ``capacity``) and any others,
    plus sequence_id and offset (columns of these names are replaced).  Best
    given a written table: it is read twice."""
    pieces = pieces.drop("sequence_id", "offset", "_salt", "_rank", "_first")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(SALTS)).cast("int"))
    per_salt = cut_lineage(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")))
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in
              per_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if any(not 0 < w <= capacity for w in counts if w is not None) or None in counts:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    keys, each, first_seq, offset = _places(packing_plan(counts, capacity))

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(
        Window.unboundedPreceding, -1)
    firsts = per_salt.select("length", "_salt",
                             F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy(*pieces.columns)
    numbered = (salted.withColumn("_rank", F.row_number().over(within))
                .join(firsts, ["length", "_salt"])
                .select(*pieces.columns, (F.col("_first") + F.col("_rank") - 1).alias("_rank")))

    @per_batch
    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
        rank = batch.column("_rank").to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, w << 50 | rank, side="right") - 1
        n = rank - (keys[at] & ((1 << 50) - 1))
        cols = batch.columns[:-1] + [pa.array(first_seq[at] + n // each[at]),
                                     pa.array(offset[at] + n % each[at] * w)]
        return pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1] + ["sequence_id", "offset"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every document of (doc_id, text) packed into sequences of at most
    ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.  Texts are encoded once; the pieces (no texts) are written."""
    return pack_pieces(cut_lineage(token_pieces(docs, path, capacity, end_id)), capacity)
