"""Exact dedup with a cuckoo-filter index.

``CuckooIndex`` is a set of live digests.  A lookup first asks a cuckoo
filter (16-bit fingerprints, four slots a bucket, two candidate buckets); a
hit is verified against the full key in a content bucket, so a false positive
of the filter never merges two texts.  Digests can be inserted and deleted,
and an insertion that overflows makes the filter grow to twice its size and
refill from the stored keys.

The job runs the index twice, as a combine and a reduce: every input
partition folds its own documents into live entries (a group of copies that
holds a third of all rows leaves one entry per partition), those entries are
shuffled by digest, and the index of each digest range folds them into the
final entry.  A join by digest then tells every document which row stays; its
hot side is a plain shuffled join that AQE splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ASCII_LOWER, ASCII_UPPER, fresh_name, ids_and_texts, per_batch

SLOTS = 4
MAX_KICKS = 200
LISTED_BITS = 16             # bits of the filter a listed row gets
FILTER_BITS = 1 << 26        # of them at most; a longer list passes more texts on to the join
BITMAP_BITS = 1 << 15        # of Spark's bitmaps


class CuckooFilter:
    """Fingerprints of 16 bits; an entry may live in either of two buckets
    that are found from each other and the fingerprint alone."""

    def __init__(self, buckets: int = 64):
        self.mask = buckets - 1              # buckets is a power of two
        self.table: list[list[int]] = [[] for _ in range(buckets)]

    def _place(self, key: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(key[8:10], "little") or 1
        i = int.from_bytes(key[:8], "little") & self.mask
        return fp, i, self._other(i, fp)

    def _other(self, i: int, fp: int) -> int:
        return i ^ ((fp * 0x9E3779B1 >> 7) & self.mask)

    def __contains__(self, key: bytes) -> bool:
        fp, i, j = self._place(key)
        return fp in self.table[i] or fp in self.table[j]

    def insert(self, key: bytes) -> bool:
        """False when no room was found; the filter then lost one entry and
        has to be rebuilt from the stored keys."""
        fp, i, j = self._place(key)
        for b in (i, j):
            if len(self.table[b]) < SLOTS:
                self.table[b].append(fp)
                return True
        for kick in range(MAX_KICKS):
            bucket = self.table[i]
            slot = kick % SLOTS
            fp, bucket[slot] = bucket[slot], fp
            i = self._other(i, fp)
            if len(self.table[i]) < SLOTS:
                self.table[i].append(fp)
                return True
        return False

    def delete(self, key: bytes) -> None:
        fp, i, j = self._place(key)
        for b in (i, j):
            if fp in self.table[b]:
                self.table[b].remove(fp)
                return


class CuckooIndex:
    """Live digests with a value each: filter in front, content buckets behind."""

    def __init__(self, buckets: int = 64):
        self.filter = CuckooFilter(buckets)
        self.content: dict[bytes, list[list]] = {}   # 4-byte bucket -> [key, value]
        self.size = 0
        self.resizes = 0

    def get(self, key: bytes):
        if key not in self.filter:
            return None
        for k, value in self.content.get(key[10:14], ()):
            if k == key:
                return value
        return None                                   # the filter's false positive

    def insert(self, key: bytes, value) -> None:
        """Add a key that is not live."""
        self.content.setdefault(key[10:14], []).append([key, value])
        self.size += 1
        if not self.filter.insert(key):
            self._grow()

    def delete(self, key: bytes) -> bool:
        """Take a live key out; False when it is not there."""
        bucket = self.content.get(key[10:14], [])
        for n, (k, _) in enumerate(bucket):
            if k == key:
                del bucket[n]
                if not bucket:
                    del self.content[key[10:14]]
                self.filter.delete(key)
                self.size -= 1
                return True
        return False

    def _grow(self) -> None:
        buckets = (self.filter.mask + 1) * 2
        while True:
            self.resizes += 1
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(k) for k, _ in self.items()):
                return
            buckets *= 2

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.content.values():
            yield from bucket


def _order(doc_id, uid):
    return (doc_id is not None, doc_id or 0, uid)     # a null id ranks lowest


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, keep_id, keep_uid, group_size) -> one row per digest.  A
    larger row supersedes the live one: that entry is deleted, the new one
    inserted."""
    index = CuckooIndex()
    schema = None
    for batch in batches:
        schema = batch.schema
        for key, doc_id, uid, n in zip(*(c.to_pylist() for c in batch.columns)):
            live = index.get(key)
            if live is None:
                index.insert(key, (doc_id, uid, n))
            elif _order(doc_id, uid) > _order(*live[:2]):
                index.delete(key)
                index.insert(key, (doc_id, uid, n + live[2]))
            else:
                live_id, live_uid, m = live
                index.delete(key)
                index.insert(key, (live_id, live_uid, n + m))
    if index.size:
        rows = [(k, *v) for k, v in index.items()]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows[at:at + 50_000]), schema.types)],
                schema=schema)


@per_batch
def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    doc_id, body, uid = batch.columns
    digests = [hashlib.sha256(t.lower()).digest() for t in body.to_pylist()]
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), doc_id, uid],
                                      names=["digest", "doc_id", "uid"])


def text_digests(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, uid): SHA-256 of every text with A-Z lower-cased.
    Written once, so that ``uid`` tells repeated rows apart for good."""
    rows = ids_and_texts(docs, F.monotonically_increasing_id().alias("uid"))
    return cut_lineage(rows.mapInArrow(_digest, "digest binary, doc_id bigint, uid bigint"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id,
    group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty, and empty texts are copies of each other.  Of equal texts the row
    with the largest doc_id stays; a null doc_id ranks below all others, and
    of rows that repeat the largest doc_id exactly one stays.  An empty table
    gives an empty result; other columns are not read.
    """
    digests = text_digests(docs)
    fields = "digest binary, keep_id bigint, keep_uid bigint, group_size bigint"
    entries = digests.select("digest", F.col("doc_id").alias("keep_id"),
                             F.col("uid").alias("keep_uid"),
                             F.lit(1).cast("bigint").alias("group_size"))
    live = (entries.mapInArrow(_fold, fields)
            .repartition("digest").mapInArrow(_fold, fields))
    return (digests.join(live, "digest")
            .select("doc_id", "keep_id", "group_size",
                    (F.col("uid") == F.col("keep_uid")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def _bit_of(doc_id: Column, digest: Column, bits: int) -> Column:
    """The bit of a filter of ``bits`` bits that stands for a row, from 1."""
    return F.pmod(F.xxhash64(doc_id.cast("bigint"), digest), F.lit(bits)) + 1


def _filter_of(listed: DataFrame, bits: int) -> DataFrame:
    """One row with the filter of the listed rows, as one binary per bitmap."""
    bit = _bit_of(F.col("listed_id"), F.col("listed_digest"), bits)
    maps = (listed.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("id"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")))
    every = listed.sparkSession.range(1, 1 + bits // BITMAP_BITS)
    return every.join(maps, "id", "left").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("map", F.unhex(F.lit("")))))),
        lambda x: x["col2"]).alias("maps"))


def _may_be_listed(bit: str, maps: str) -> Column:
    """Whether the bit is set in the filter; so it is for every listed row."""
    at = f"bitmap_bit_position({bit})"
    byte = (f"cast(conv(hex(substring(element_at({maps}, cast(bitmap_bucket_number({bit}) as int)), "
            f"cast({at} div 8 as int) + 1, 1)), 16, 10) as int)")
    return F.expr(f"coalesce(shiftright({byte}, cast({at} % 8 as int)) & 1, 0) = 1")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is known by its doc_id and digest.  Only what must go is listed, and
    the list is written, so the planner knows its size.  A filter of a few bits a
    listed row, one row that is sent to the texts, lets all but a small part of
    the texts that stay pass at once; the others are held against the list by a
    join, which shuffles them where the list is not small.  Keys that are
    repeated exactly are thinned to one row; that second join is only planned
    where there are any.
    """
    rows = exact_duplicates(docs).groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    listed = cut_lineage(rows.where(~F.col("stays") | (F.col("n") > 1)).select(
        F.col("doc_id").alias("listed_id"), F.unhex("text_sha256").alias("listed_digest"), "stays"))
    size = min(FILTER_BITS, LISTED_BITS * listed.count())
    bits = BITMAP_BITS * max(1, -(-size // BITMAP_BITS))
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    key, bit, maps = (fresh_name(docs, name) for name in ("row_digest", "row_bit", "row_maps"))
    keyed = (docs.withColumn(key, F.unhex(F.sha2(lowered, 256)))
             .withColumn(bit, _bit_of(F.col("doc_id"), F.col(key), bits))
             .crossJoin(F.broadcast(_filter_of(listed, bits).withColumnRenamed("maps", maps))))
    may = _may_be_listed(bit, maps)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    free = keyed.where(~may).select(*columns)
    met = keyed.where(may).select(*columns, key)
    same = met["doc_id"].eqNullSafe(listed["listed_id"]) & (met[key] == listed["listed_digest"])
    # a key is listed once.  An anti-join or semi-join would be planned below the
    # filter, where it shuffles every text; an outer or inner join stays above it
    stays = free.unionByName(met.join(listed, same, "left").where(F.col("listed_digest").isNull()).select(*columns))
    if listed.where("stays").limit(1).count():
        thinned = met.join(listed.where("stays"), same).dropDuplicates(["doc_id", key])
        stays = stays.unionByName(thinned.select(*columns))
    return stays
