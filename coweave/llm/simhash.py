"""SimHash near-dedup with a byte-position inverted index.

A 64-bit fingerprint is eight bytes at eight positions.  Two fingerprints
that differ in at most ``max_bits`` bits share at least ``8 - max_bits``
positional bytes (five for three bits), which is the count filter's
guaranteed minimum.  Tallying single bytes would read lists of n / 256
entries, so the index is keyed by groups of positions chosen such that every
possible set of enough shared positions holds one whole group: the
candidates of a list share a group for certain, the tally of their shared
bytes decides who goes on, the bit distance verifies.

Texts meet as distinct fingerprints.  A list only emits links that join
fingerprints not yet connected inside it (a spanning forest), never all its
pairs; lists above ``hot_list`` are first split by longer groups, and what is
still long is linked by looking up the neighbours of its fingerprints.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ids_and_texts, per_batch, text_bytes
from .components import components

POSITIONS = 8
HOT_LIST = 512
FLIP_COST = 8             # a looked-up neighbour against a tallied pair
HASHES_AT_ONCE = 1 << 15


def fingerprint(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    """SimHash of a text: words are runs without ASCII white space after
    lower-casing A-Z, shingles are joined by a blank, repeats count, and a bit
    is set if more than half the shingles' XXH64 have it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in
                          zip(starts[:n].tolist(), ends[shingle_words - 1:].tolist())),
                         np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = hashes[at:at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp bigint, digest): the fingerprint's 64 bits as a signed
    number and the SHA-256 of the text, one row per row of ``docs``.  Null and
    wordless texts have fingerprint zero."""
    @per_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        fps = np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64)
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), digests],
                                          names=["doc_id", "fp", "digest"])
    return ids_and_texts(docs).mapInArrow(run, "doc_id bigint, fp bigint, digest binary")


def position_groups(max_bits: int) -> list[tuple[int, ...]]:
    """Groups of positions such that any ``8 - max_bits`` positions contain a
    whole group: the triples inside each half of the bytes while five or more
    are shared, else every set of that many positions."""
    shared = POSITIONS - max_bits
    if shared < 1:
        raise ValueError("max_bits must be below 8 for bytes to be shared for certain")
    if shared >= 5:
        half = POSITIONS // 2
        return [*combinations(range(half), 3), *combinations(range(half, POSITIONS), 3)]
    return list(combinations(range(POSITIONS), shared))


def _mask(group: tuple[int, ...]) -> int:
    """Signed 64-bit mask of the group's bytes."""
    m = sum(0xFF << 8 * p for p in group)
    return m - (1 << 64) if m >> 63 else m


def _key(groups: list[tuple[int, ...]]) -> Column:
    """Array of list keys of a fingerprint: the group's number and bytes."""
    return F.array(*[F.struct(F.lit(n).alias("grp"),
                              F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("val"))
                     for n, g in enumerate(groups)])


class _Forest:
    """Union-find over the places of one list."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def flip_masks(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """All differences of at most ``max_bits`` bits that two of the fingerprints
    can have: those of the bits in which any two of them differ."""
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [1 << b for b in range(64) if varying >> b & 1]
    return np.array([sum(c) for n in range(1, max_bits + 1) for c in combinations(bits, n)], np.uint64)


def _flip_count(fps: np.ndarray, max_bits: int) -> int:
    bits = int(np.bitwise_or.reduce(fps ^ fps[0])).bit_count()
    return sum(math.comb(bits, n) for n in range(1, max_bits + 1))


def list_links(fps: np.ndarray, max_bits: int, block: int = 1024) -> list[tuple[int, int]]:
    """Spanning links of one list of different fingerprints: pairs that share
    enough positional bytes (tallied) and differ in at most ``max_bits`` bits
    (verified), reduced to a forest.

    All pairs are tallied, block by block, while that is less work than looking
    up every neighbour of every fingerprint, which the list's varying bits
    bound: a list that agrees in five bytes has 2,324 neighbours a fingerprint
    at most, so a list of any length costs in proportion to it.
    """
    forest, out = _Forest(len(fps)), []
    if _flip_count(fps, max_bits) * FLIP_COST < len(fps):
        order = np.argsort(fps)
        ranked = fps[order]
        for mask in flip_masks(fps, max_bits):
            other = ranked ^ mask
            at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
            hit = (ranked[at] == other) & (ranked < other)
            if hit.any():
                a, b = order[np.flatnonzero(hit)], order[at[hit]]
                # few bits differ, but the count filter is the operator's: five of eight bytes
                x = (fps[a] ^ fps[b]).view(np.uint8).reshape(-1, POSITIONS)
                near = (x == 0).sum(axis=1) >= POSITIONS - max_bits
                for u, v in zip(a[near].tolist(), b[near].tolist()):
                    if forest.join(u, v):
                        out.append((min(u, v), max(u, v)))
        return out
    as_bytes = fps.view(np.uint8).reshape(-1, POSITIONS)
    for i in range(0, len(fps), block):
        for j in range(i, len(fps), block):
            x = fps[i:i + block, None] ^ fps[None, j:j + block]
            shared = np.zeros(x.shape, np.uint8)
            for p in range(POSITIONS):
                shared += as_bytes[i:i + block, None, p] == as_bytes[None, j:j + block, p]
            a, b = np.nonzero(shared >= POSITIONS - max_bits)
            near = np.bitwise_count(x[a, b]) <= max_bits
            for u, v in zip((a[near] + i).tolist(), (b[near] + j).tolist()):
                if u < v and forest.join(u, v):
                    out.append((u, v))
    return out


def near_links(distinct: DataFrame, max_bits: int = 3, hot_list: int = HOT_LIST) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` exactly as
    all pairs within ``max_bits`` would."""
    groups = position_groups(max_bits)
    shared = POSITIONS - max_bits
    finer = list(combinations(range(POSITIONS), shared))
    posts = distinct.select("fp", F.explode(_key(groups)).alias("k")).select("fp", "k.grp", "k.val")
    sizes = posts.groupBy("grp", "val").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > hot_list).select("grp", "val", F.lit(True).alias("hot"))
    marked = posts.join(hot, ["grp", "val"], "left")
    # a pair of a hot list shares ``shared`` positions that hold the group's
    by_group = F.array(*[F.array(*[
        F.struct(F.lit(len(groups) + n).alias("grp"),
                 F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("val"))
        for n, s in enumerate(finer) if set(g) <= set(s)]) for g in groups])
    cold = marked.where("hot is null").select("fp", "grp", "val")
    split = (marked.where("hot").select("fp", F.explode(F.get(by_group, F.col("grp"))).alias("k"))
             .select("fp", "k.grp", "k.val").distinct())
    lists = cold.unionByName(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []                # the list that may go on
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            fp = np.concatenate(parts)
            if len(fp) > 1:
                for u, v in list_links(fp.view(np.uint64), max_bits):
                    a.append(int(fp[u]))
                    b.append(int(fp[v]))

        def found() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a.clear()
            b.clear()
            return out

        for batch in batches:
            fp, grp, val = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (val[1:] != val[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            for lo, hi in zip(bounds, bounds[1:]):
                if hi == lo:
                    continue
                if (grp[lo], val[lo]) != key:
                    if parts:
                        close()
                    key, parts = (grp[lo], val[lo]), []
                parts.append(fp[lo:hi])
            if a:
                yield found()
        if parts:
            close()
        if a:
            yield found()

    return (lists.repartition("grp", "val").sortWithinPartitions("grp", "val", "fp")
            .select("fp", "grp", "val").mapInArrow(run, "a bigint, b bigint"))


def simhash_classes(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex
    digits), component_id (smallest doc_id reachable over links of at most
    ``max_bits`` differing bits, itself included).

    Null text is empty; wordless texts have fingerprint zero and link like any
    other.  A row without doc_id links others but is no candidate for the
    smallest id (null if its class has none).  Repeated rows and ties share a
    class; an empty table gives an empty result.
    """
    return (_classed(docs, shingle_words, max_bits)
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def _classed(docs: DataFrame, shingle_words: int, max_bits: int) -> DataFrame:
    """(doc_id, fp, digest, component_id), one row per row of ``docs``."""
    prints = cut_lineage(fingerprints(docs, shingle_words))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(distinct.select("fp"), max_bits))
    rooted = cut_lineage(distinct.join(roots, F.col("fp") == F.col("node"), "left")
                         .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # written, so that the join below is one of plain exchanges: AQE can then
    # split a class that holds a large part of all fingerprints
    least = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_print = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp")


def keep_class_representatives(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their own class;
    rows without doc_id stay where their class has no id at all.

    A row is known by its doc_id and the digest of its text, so of rows that
    share a doc_id only those of the class it represents stay.  The rows that
    go are listed and written: the planner sends a small list to the texts.
    """
    go = cut_lineage(_classed(docs, shingle_words, max_bits)
                     .where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
                     .select(F.col("doc_id").alias("go_id"), F.col("digest").alias("go_digest")).distinct())
    digest = F.unhex(F.sha2(text_bytes(), 256))
    return docs.join(go, docs["doc_id"].cast("bigint").eqNullSafe(go["go_id"])
                     & (digest == go["go_digest"]), "left_anti")
