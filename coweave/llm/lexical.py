"""Ranked lexical search, term at a time with limited accumulators.

Index: documents are taken in blocks of bounded size; a block leaves one row
per term with its postings (place of the document, times the term occurs) and
one row with its documents and their lengths.  The index is written once.

Search: an item's terms come rarest first.  Every document of a term's postings
gets an accumulator for its partial score, until what the remaining terms can
add at most (the largest share in this block, summed) is less than the k-th
best partial score: a document first met later cannot be among the k best any
more, so no accumulators are created from there on, while those that exist are
updated by all remaining terms and end up exact.

Every block is searched on its own, for blocks of items; its k best of every
item are merged by a window.  A block of the index only meets the postings of
terms that an item has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ASCII_LOWER, ASCII_UPPER, ids_and_texts

# Fixed value: what a term is made of, on UTF-8 bytes (every byte of a
# character beyond ASCII is one of a term).
TERMS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
NOT_OF_TERMS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

BLOCK_DOCS = 8_192
BLOCK_BYTES = 8 << 20
ITEM_ROWS = 1_024        # items of one block
SCALE, TF_SCALE, LENGTH_SHARE, LENGTH_BASE = 1_000_000_000, 1_000, 25, 75

INDEX_FIELDS = "block bigint, term binary, docs binary, tfs binary, doc_ids array<bigint>, sizes binary"
INDEX_SCHEMA = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("docs", pa.binary()),
                          ("tfs", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary())])
FLUSH_ROWS = 20_000


def _rows_of_block(block: int, ids: list, vocabulary: dict[bytes, int], codes: list[np.ndarray],
                   counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The index rows of one block: ``codes`` and ``counts`` hold the terms
    and their occurrences of every document."""
    sizes = np.array([c.sum() for c in counts], np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array([None], pa.binary()), pa.array([None], pa.binary()),
         pa.array([None], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tobytes()])],
        schema=INDEX_SCHEMA)
    term = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    if not len(term):
        return
    doc = np.repeat(np.arange(len(codes), dtype=np.uint32), [len(c) for c in codes])
    tf = np.concatenate(counts).astype(np.uint32)
    o = np.argsort(term, kind="stable")
    doc, tf = doc[o], tf[o]
    bounds = np.searchsorted(term[o], np.arange(len(vocabulary) + 1))
    words = list(vocabulary)
    for lo in range(0, len(words), FLUSH_ROWS):
        some = range(lo, min(lo + FLUSH_ROWS, len(words)))
        a, b = bounds[some.start], bounds[some.stop]
        offsets = pa.array((bounds[some.start:some.stop + 1] - a) * 4, pa.int32())
        packed = lambda x: pa.Array.from_buffers(pa.binary(), len(some), [
            None, offsets.buffers()[1], pa.py_buffer(x[a:b].tobytes())])
        none = pa.nulls(len(some), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), block)), pa.array(words[lo:some.stop], pa.binary()), packed(doc),
             packed(tf), none, pa.nulls(len(some), pa.binary())], schema=INDEX_SCHEMA)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> index rows of blocks of at most ``BLOCK_DOCS`` documents
    (and about ``BLOCK_BYTES`` of text)."""
    block = TaskContext.get().partitionId() << 32
    ids, codes, counts, held = [], [], [], 0
    vocabulary: dict[bytes, int] = {}
    for batch in batches:
        for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            terms = [vocabulary.setdefault(t, len(vocabulary)) for t in TERMS.findall(body.lower())]
            code, count = np.unique(np.array(terms, np.int32), return_counts=True)
            ids.append(doc_id), codes.append(code), counts.append(count)
            held += len(body)
            if len(ids) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                yield from _rows_of_block(block, ids, vocabulary, codes, counts)
                block, ids, codes, counts, held, vocabulary = block + 1, [], [], [], 0, {}
    if ids:
        yield from _rows_of_block(block, ids, vocabulary, codes, counts)


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of ``docs`` (doc_id, text): rows with a term hold its
    postings in a block, those without one the block's doc_ids and lengths."""
    return cut_lineage(ids_and_texts(docs).mapInArrow(_index, INDEX_FIELDS))


def item_terms(items: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, term, qtf): the terms of every item, with their repeats."""
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    return (items.select(F.col(item).cast("bigint").alias("item"), F.explode(F.split(lowered, NOT_OF_TERMS)).alias("t"))
            .where(F.col("t") != "").groupBy("item", F.col("t").cast("binary").alias("term"))
            .agg(F.count(F.lit(1)).alias("qtf")))


class Postings:
    """A block's documents and the shares of score that its terms add."""

    def __init__(self, doc_ids: list, sizes: np.ndarray, n_docs: int, n_terms: int):
        self.doc_ids = doc_ids
        # lengths only matter where a document has a term, so n_terms > 0 then
        self.m = LENGTH_BASE + (LENGTH_SHARE * sizes * n_docs) // max(n_terms, 1)
        self.of_term: dict[bytes, tuple[np.ndarray, np.ndarray, int]] = {}

    def add(self, term: bytes, docs: bytes, tfs: bytes) -> None:
        at = np.frombuffer(docs, np.uint32).astype(np.int64)
        tf = np.frombuffer(tfs, np.uint32).astype(np.int64)
        share = (SCALE * tf) // (TF_SCALE * tf + 12 * self.m[at])
        self.of_term[term] = at, share, int(share.max())

    def best(self, terms: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and exact scores of the ``k`` best documents (more where
        scores tie with the k-th), and how many accumulators were made.

        ``terms``: (term, weight times repeats), rarest first.
        """
        known = [(w, *self.of_term[t]) for t, w in terms if t in self.of_term and w > 0]
        # togo[n]: what terms n and later can add to a document at most
        togo = np.cumsum([0] + [w * top for w, _, _, top in reversed(known)])[::-1].tolist()
        score = np.zeros(len(self.m), np.int64)
        has = np.zeros(len(self.m), bool)
        made, grows = 0, True
        for n, (weight, at, share, _) in enumerate(known):
            # no partial score is above togo[0] - togo[n], so look from the middle on
            if grows and made >= k and togo[0] - togo[n] > togo[n]:
                some = score[has]
                # on a tie with the k-th a smaller doc_id could still come in
                grows = int(np.partition(some, made - k)[made - k]) <= togo[n]
            if grows:
                has[at] = True
                made = int(has.sum())
                score[at] += weight * share
            else:
                met = has[at]
                score[at[met]] += weight * share[met]
        found = np.flatnonzero(score)
        if len(found) > k:
            kth = np.partition(score[found], len(found) - k)[len(found) - k]
            found = found[score[found] >= kth]
        return found, score[found], made


FOUND_FIELDS = "item bigint, doc_id bigint, score bigint"


def search(index: DataFrame, terms: DataFrame, k: int = 20, item_rows: int = ITEM_ROWS) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of a written
    ``index`` for every item of ``terms`` (item, term, qtf), score above 0,
    ties to the smaller doc_id (nulls first)."""
    postings, heads = index.where(F.col("term").isNotNull()), index.where(F.col("term").isNull())
    # three numbers of the whole table: blocks, documents with a term, all their terms
    n_blocks, n_docs, n_terms = (heads.select("sizes").mapInArrow(_sum_sizes, "n bigint, l bigint")
                                 .agg(F.count(F.lit(1)), F.sum("n"), F.sum("l")).first())
    if not n_terms:
        return index.sparkSession.createDataFrame([], "item bigint, rank int, doc_id bigint, score bigint")
    item_blocks = 1 + terms.select("item").distinct().count() // item_rows

    df = (postings.join(terms.select("term").distinct(), "term")
          .groupBy("term").agg(F.sum((F.length("docs") / 4).cast("bigint")).alias("df")))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("bigint")
    known = cut_lineage(                        # read by both sides below
        terms.join(df.withColumn("w", weight), "term")
        .withColumn("items", F.pmod(F.xxhash64("item"), F.lit(item_blocks)).cast("int")).groupBy("items", "item")
        .agg(F.array_sort(F.collect_list(F.struct("df", "term", "w", "qtf"))).alias("terms")))

    shard = F.pmod(F.xxhash64("block"), F.lit(n_blocks)).cast("int").alias("shard")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = known.select(F.col("items").alias("some"), "item", "terms", every(n_blocks).alias("place"))
    row = ["items", "shard", "block", "term", "docs", "tfs", "doc_ids", "sizes"]
    right = (postings.join(known.select("items", F.explode("terms.term").alias("term")).distinct(), "term")
             .withColumn("shard", shard).select(row)
             .unionByName(heads.select("*", every(item_blocks).alias("items"), shard).select(row)))

    def run(items: pa.Table, rows: pa.Table) -> pa.Table:
        blocks: dict[int, Postings] = {}
        out: list[tuple] = []
        is_head = pc.is_null(rows["term"])
        for r in rows.filter(is_head).select(["block", "doc_ids", "sizes"]).to_pylist():
            blocks[r["block"]] = Postings(r["doc_ids"], np.frombuffer(r["sizes"], np.int64), n_docs, n_terms)
        for r in rows.filter(pc.invert(is_head)).select(["block", "term", "docs", "tfs"]).to_pylist():
            blocks[r["block"]].add(r["term"], r["docs"], r["tfs"])
        for item, wanted in zip(items["item"].to_pylist(), items["terms"].to_pylist()):
            query = [(t["term"], t["w"] * t["qtf"]) for t in wanted]
            for block in blocks.values():
                at, score, _ = block.best(query, k)
                ids = [block.doc_ids[i] for i in at.tolist()]
                # ties at the k-th place: the smaller ids, null first
                best = sorted(zip((-score).tolist(), [(i is not None, i or 0) for i in ids], ids))[:k]
                out += [(item, i, -s) for s, _, i in best]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item", "doc_id", "score"), cols)})

    found = left.groupBy("some", "place").cogroup(right.groupBy("items", "shard")).applyInArrow(run, FOUND_FIELDS)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def _sum_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [np.frombuffer(s, np.int64) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int((s > 0).sum()) for s in sizes], pa.int64()),
             pa.array([int(s.sum()) for s in sizes], pa.int64())], names=["n", "l"])


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for every item of ``items`` (item_id,
    text) the ``k`` documents of ``docs`` (doc_id, text) with the highest score.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased.  Null and empty texts have none; an item without a term that
    a document has, and an empty table, give no rows.  Every row of ``docs`` is
    a document, also where doc_ids repeat or are null; rows that share an
    item_id are one item with the terms of all.  Equal scores go by doc_id,
    null first.  Other columns are ignored.
    """
    return search(build_index(docs), item_terms(items), k).withColumnRenamed("item", "item_id")
