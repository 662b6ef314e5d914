"""Language-model scoring with context-tree weighting.

The model predicts the bytes of a text one after the other, each byte as
eight binary decisions (a walk down a binary tree of 255 nodes).  Every
decision node has a context tree over the preceding bytes, up to ``DEPTH`` of
them; each context of each depth holds a Krichevsky-Trofimov estimate, and
the weighting mixes all depths: P_w = 1/2 P_kt + 1/2 product of the longer
contexts' P_w.  What the tree learnt gives, for every context, the weight of
each depth and so the code length of the next byte.  A text starts after line
feeds and ends with a NUL byte, which is predicted too.

Beside it stands a smoothed unigram model of words.

Both models grow with the corpus, so neither is ever gathered.  Documents are
dealt into blocks of bounded size, packed.  A block asks for what its own texts
need: its different words, and its different contexts with the byte that
follows, with the counts of its training texts.  Questions are packed arrays,
words dealt by word, contexts by their last three bytes, so that a task holds
whole trees below depth three.  Equal contexts are first summed over groups of
blocks, so that the task of a common ending holds its different contexts, not
every block's.  The depths above are summed over all tasks by Spark and mixed on
the driver: a row per decision node of the two-byte contexts there are, at most
65,536 x 255.  The answers are co-grouped with the block.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ids_and_texts, per_batch

DEPTH = 5                      # a context and the next byte fit 48 bits
START, FINISH = b"\n" * DEPTH, b"\0"
CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20        # of text, for each bucket of questions
SUM_BLOCKS = 64                # summed together first
ANSWER_BLOCKS = 1024           # answered by one task of a bucket
TOP = 3                        # bytes of context that choose the bucket
END_WORD = b""                 # no word is empty
_U = np.uint64


# --------------------------------------------------------------------------
# contexts of texts

def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size >= CHUNK_BYTES or len(chunk) == 1 << 16:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def context_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte of the texts and their ends: the bytes before it, last
    one first, and the byte itself as one number; and the text it is in."""
    raw = np.frombuffer(b"".join(START + t + FINISH for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes + DEPTH)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[ends - sizes] += 1
    inside[ends] -= 1
    wide = raw.astype(_U)
    code = wide.copy()
    for d in range(1, DEPTH + 1):
        code[DEPTH:] |= wide[DEPTH - d:-d] << _U(8 * (DEPTH - d + 1))
    return code[np.cumsum(inside[:-1]).astype(bool)], np.repeat(np.arange(len(texts)), sizes)


def _heads(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _sum_runs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their n."""
    o = np.argsort(keys)
    keys, n = keys[o], n[o]
    heads = _heads(keys)
    return keys[heads], np.add.reduceat(n, heads) if len(heads) else n


def block_codes(texts: list[bytes], train: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of the texts, sorted, and how often the training
    texts have them."""
    keys, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for learn in (True, False):
        for chunk in _chunks([t for t, x in zip(texts, train) if x == learn]):
            code = np.sort(context_codes(chunk)[0])
            heads = _heads(code)
            keys.append(code[heads])
            counts.append(np.diff(np.append(heads, len(code))) * learn)
    return _sum_runs(np.concatenate(keys), np.concatenate(counts))


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """By the last bytes of the context."""
    return ((codes >> _U(8 * (DEPTH + 1 - TOP))) * _U(0x9E3779B97F4A7C15) >> _U(33)) % _U(buckets)


# --------------------------------------------------------------------------
# the weighting

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0: shifted Stirling series."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return ((y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi)
            + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
            - 1 / (1680 * y ** 7) + 1 / (1188 * y ** 9)) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    out = np.zeros_like(zeros)
    seen = (zeros + ones) > 0
    a, b = zeros[seen], ones[seen]
    out[seen] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)
    return out


def _mix(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
    """ln P_w, the weight of the own estimate, and the estimate of a one."""
    own = log_kt(zeros, ones)
    return (np.logaddexp(own, below) - np.log(2),
            1 / (1 + np.exp(np.clip(below - own, -700, 700))),
            (ones + 0.5) / (zeros + ones + 1))


def trees(codes: np.ndarray, counts: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each of the eight levels of decisions, of the trees below contexts
    of ``top`` bytes: (bit of each code, its probability of a one, and of the
    topmost nodes: key, zeros, ones, ln P_w).  ``codes`` sorted and distinct;
    a node's key is its context, then the bits decided."""
    counts = counts.astype(np.float64)
    following = codes & _U(255)
    for level in range(8):
        decided = following >> _U(8 - level)
        bit = (following >> _U(7 - level) & _U(1)).astype(bool)
        key = codes >> _U(8) << _U(level) | decided
        heads = _heads(key)
        key, path = key[heads], np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(key))))
        zeros = np.bincount(path, weights=counts * ~bit, minlength=len(key))
        ones = np.bincount(path, weights=counts * bit, minlength=len(key))
        weighted, p = log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
        up = np.arange(len(key))                    # from the deepest nodes to this depth's
        for _ in range(DEPTH - top):
            key, parent = np.unique(key >> _U(level + 8) << _U(level) | key & _U((1 << level) - 1),
                                    return_inverse=True)
            zeros, ones, below = (np.bincount(parent, weights=x) for x in (zeros, ones, weighted))
            weighted, own_weight, own = _mix(zeros, ones, below)
            up = parent[up]
            p = own_weight[up] * own[up] + (1 - own_weight[up]) * p
        yield bit, p[path], key, zeros, ones, weighted


def top_nodes(codes: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Per two last bytes and decision node: zeros, ones and the ln P_w of the
    contexts of three bytes, summed over the codes given."""
    out = []
    for level, (_, _, key, zeros, ones, weighted) in enumerate(trees(codes, counts, TOP)):
        node = (key >> _U(level + 8) << _U(8)) | _U(1 << level) | key & _U((1 << level) - 1)
        found, at = np.unique(node, return_inverse=True)
        out.append([found.astype(np.int32)] + [np.bincount(at, weights=x) for x in (zeros, ones, weighted)])
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["node", "zeros", "ones", "below"])


class TopOfTree:
    """Depths zero to two of all decision nodes: weights and estimates."""

    def __init__(self, nodes: pa.Table):
        nodes = nodes.sort_by("node")
        self.node2 = nodes["node"].to_numpy()
        zeros, ones, below = (nodes[c].to_numpy() for c in ("zeros", "ones", "below"))
        weighted, self.weight2, self.own2 = _mix(zeros, ones, below)
        at = self.node2 >> 16 << 8 | self.node2 & 255
        zeros, ones, below = (np.bincount(at, weights=x, minlength=1 << 16).astype(np.float64).reshape(256, 256)
                              for x in (zeros, ones, weighted))
        weighted, self.weight1, self.own1 = _mix(zeros, ones, below)
        _, self.weight0, self.own0 = _mix(zeros.sum(axis=0), ones.sum(axis=0), weighted.sum(axis=0))

    def code_lengths(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each code's byte after its context."""
        last_two = (codes >> _U(8 * (DEPTH - 1))).astype(np.int32)
        following = (codes & _U(255)).astype(np.int32)
        out = np.zeros(len(codes))
        for level, (bit, p, *_) in enumerate(trees(codes, counts, TOP)):
            node = (1 << level) | following >> (8 - level)
            at = np.searchsorted(self.node2, last_two << 8 | node)
            w2, w1, w0 = self.weight2[at], self.weight1[last_two >> 8, node], self.weight0[node]
            p = w2 * self.own2[at] + (1 - w2) * p
            p = w1 * self.own1[last_two >> 8, node] + (1 - w1) * p
            p = w0 * self.own0[node] + (1 - w0) * p
            out += np.log10(np.where(bit, p, 1 - p))
        return out


def text_scores(texts: list[bytes], codes: np.ndarray, scores: np.ndarray) -> list[float]:
    """Sum of the scores of every text's codes; ``codes`` sorted, holding all
    of them."""
    out = []
    for chunk in _chunks(texts):
        code, text = context_codes(chunk)
        both = np.sort(code << _U(16) | text.astype(_U))
        code, text = both >> _U(16), (both & _U(0xFFFF)).astype(np.int64)
        heads = _heads(code)
        each = np.repeat(scores[np.searchsorted(codes, code[heads])],
                         np.diff(np.append(heads, len(code))))
        out += np.bincount(text, weights=each, minlength=len(chunk)).tolist()
    return out


# --------------------------------------------------------------------------
# jobs.  A side row is (block, kind, bucket, keys, counts): a question when it
# goes to its bucket, an answer when it comes back with values for counts.

SIDE = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()),
                  ("keys", pa.binary()), ("counts", pa.binary())])
SIDE_SQL = "block int, kind int, bucket int, keys binary, counts binary"
WORDS, CONTEXTS, TOTALS = 0, 1, 2


def _pack(data: bytes | np.ndarray) -> bytes:
    return zstandard.compress(data.tobytes() if isinstance(data, np.ndarray) else data, 1)


def _unpack(data: bytes, dtype=None):
    data = zstandard.decompress(data)
    return data if dtype is None else np.frombuffer(data, dtype)


def _pack_codes(codes: np.ndarray) -> bytes:
    """Sorted codes as their differences."""
    return _pack(np.diff(codes, prepend=_U(0)))


def _unpack_codes(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, _U), dtype=_U)


def _side(rows: list[tuple]) -> pa.Table:
    cols = zip(*rows) if rows else [[]] * len(SIDE)
    return pa.table([pa.array(c, t) for c, t in zip(cols, SIDE.types)], schema=SIDE)


PACKED_SQL = "block int, ids binary, flags binary, sizes binary, texts binary"


@per_batch
def _pack_documents(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Documents -> one row per block: ids, flags (1: has an id, 2: held out),
    sizes and the lower-cased texts."""
    doc_id, body, held_out, block = batch.columns
    blocks = block.to_numpy()
    texts = body.to_pylist()
    flags = doc_id.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
    flags |= held_out.to_numpy(zero_copy_only=False).astype(np.uint8) << 1
    ids = doc_id.fill_null(0).to_numpy()
    o = np.argsort(blocks, kind="stable")
    cuts = _heads(blocks[o])
    rows = []
    for at in (o[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(o)))):
        part = [texts[i].lower() for i in at.tolist()]
        rows.append((int(blocks[at[0]]), _pack(ids[at]), _pack(flags[at]),
                     _pack(np.array([len(t) for t in part], np.int64)), _pack(b"".join(part))))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 4)],
        names=["block", "ids", "flags", "sizes", "texts"])


def _unpack_documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids, flags, texts = [], [], []
    for _, i, f, n, t in zip(*(c.to_pylist() for c in table.columns)):
        ids.append(_unpack(i, np.int64))
        flags.append(_unpack(f, np.uint8))
        data, at = _unpack(t), 0
        for size in _unpack(n, np.int64).tolist():
            texts.append(data[at:at + size])
            at += size
    return np.concatenate(ids), np.concatenate(flags), texts


def _ask(buckets: int):
    """Block -> its words and contexts with their training counts."""
    def run(table: pa.Table) -> pa.Table:
        _, flags, texts = _unpack_documents(table)
        train = (flags & 2 == 0).tolist()
        block, rows = table["block"][0].as_py(), []

        seen: Counter = Counter()
        for text, learn in zip(texts, train):
            words = text.split()
            words.append(END_WORD)
            if learn:
                seen.update(words)
            else:
                for w in words:
                    seen.setdefault(w, 0)
        dealt: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in seen:
            dealt[zlib.crc32(w) % buckets].append(w)
        for n, words in enumerate(dealt):
            if words:
                rows.append((block, WORDS, n, _pack(b"\n".join(words)),
                             _pack(np.array([seen[w] for w in words], np.int64))))

        codes, counts = block_codes(texts, train)
        bucket = _bucket(codes, buckets)
        o = np.argsort(bucket, kind="stable")
        cuts = _heads(bucket[o])
        for at in (o[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(o)))):
            rows.append((block, CONTEXTS, int(bucket[at[0]]), _pack_codes(codes[at]), _pack(counts[at])))
        return _side(rows)
    return run


def _answer_words(table: pa.Table) -> pa.Table:
    """Bucket -> every block's words with their counts over all blocks, and
    the bucket's tokens and vocabulary."""
    total: Counter = Counter()
    asked = []
    for block, keys, counts in zip(table["block"].to_pylist(), table["keys"].to_pylist(),
                                   table["counts"].to_pylist()):
        asked.append((block, keys))
        for w, n in zip(_unpack(keys).split(b"\n"), _unpack(counts, np.int64).tolist()):
            total[w] += n
    rows = [(block, WORDS, None, keys, _pack(np.array([total[w] for w in _unpack(keys).split(b"\n")], np.int64)))
            for block, keys in asked]
    known = np.array([sum(total.values()), sum(1 for n in total.values() if n)], np.int64)
    return _side([*rows, (-1, TOTALS, None, b"", _pack(known))])


def _sum_codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All different codes of the rows with their counts.  Rows are unpacked
    one by one, and summed whenever they outgrow the sum."""
    keys, n, held = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
    for packed_keys, packed_n in zip(table["keys"], table["counts"]):
        keys.append(_unpack_codes(packed_keys.as_py()))
        n.append(_unpack(packed_n.as_py(), np.int64))
        held += len(keys[-1])
        if held >= max(1 << 20, len(keys[0])):
            codes, total = _sum_runs(np.concatenate(keys), np.concatenate(n))
            keys, n, held = [codes], [total], 0
    return _sum_runs(np.concatenate(keys), np.concatenate(n))


def _sum_contexts(table: pa.Table) -> pa.Table:
    """Rows of one bucket -> one row with the sums."""
    codes, n = _sum_codes(table)
    return _side([(None, CONTEXTS, table["bucket"][0].as_py(), _pack_codes(codes), _pack(n))])


def _top_of_bucket(table: pa.Table) -> pa.Table:
    return top_nodes(*_sum_codes(table))


def _score_contexts(top: TopOfTree):
    """Sums of a bucket -> the score of each of its codes."""
    def run(table: pa.Table) -> pa.Table:
        codes, n = _sum_codes(table)
        scores = top.code_lengths(codes, n).astype(np.float32)
        return _side([(None, CONTEXTS, table["bucket"][0].as_py(), _pack_codes(codes), scores.tobytes())])
    return run


def _answer_contexts(asked: pa.Table, scored: pa.Table) -> pa.Table:
    """Blocks' questions and the scores of their bucket -> answers."""
    if not asked.num_rows:
        return _side([])
    codes = _unpack_codes(scored["keys"][0].as_py())
    scores = np.frombuffer(scored["counts"][0].as_py(), np.float32)
    rows = []
    for block, keys in zip(asked["block"].to_pylist(), asked["keys"]):
        keys = keys.as_py()
        rows.append((block, CONTEXTS, None, keys, scores[np.searchsorted(codes, _unpack_codes(keys))].tobytes()))
    return _side(rows)


def score_documents(docs: DataFrame, folds: int = 5, held_out_fold: int = 1,
                    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
                    sum_blocks: int = SUM_BLOCKS, answer_blocks: int = ANSWER_BLOCKS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score (unigram), score (context-tree
    weighting); both log10 probabilities of the text with A-Z lower-cased.

    A document is held out if crc32 of its doc_id as text leaves
    ``held_out_fold`` modulo ``folds``; a null doc_id counts as the empty text
    (remainder 0).  Null text is empty: its only token is the end.  Without
    any training text the estimates are those of no counts.  Repeated rows
    are scored, and learnt from, each; an empty table gives an empty result.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % folds
    rows = ids_and_texts(docs, (fold == held_out_fold).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    blocks, buckets = 1 + size // block_bytes, 1 + size // bucket_bytes
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("body")), F.lit(blocks)).cast("int")
    packed = (rows.withColumn("block", block).mapInArrow(_pack_documents, PACKED_SQL)
              .groupBy("block"))

    asked = cut_lineage(packed.applyInArrow(_ask(buckets), SIDE_SQL))
    words = cut_lineage(asked.where(F.col("kind") == WORDS).groupBy("bucket")
                        .applyInArrow(_answer_words, SIDE_SQL))
    # a row per bucket
    known = [_unpack(r["counts"], np.int64) for r in words.where(F.col("kind") == TOTALS).collect()]
    train_tokens, vocabulary = (int(sum(k[i] for k in known)) for i in (0, 1))
    each = float(np.log10(train_tokens + 0.5 * (vocabulary + 1)))

    contexts = asked.where(F.col("kind") == CONTEXTS)
    part = lambda n: F.floor(F.col("block") / n).cast("int").alias("part")
    summed = cut_lineage(contexts.groupBy("bucket", part(sum_blocks)).applyInArrow(_sum_contexts, SIDE_SQL)
                         .groupBy("bucket").applyInArrow(_sum_contexts, SIDE_SQL)).groupBy("bucket")
    # a row per decision node of the two-byte contexts
    top = TopOfTree(summed.applyInArrow(_top_of_bucket, "node int, zeros double, ones double, below double")
                    .groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow())
    every = F.explode(F.sequence(F.lit(0), F.lit(int((blocks - 1) // answer_blocks)))).alias("part")
    scored = summed.applyInArrow(_score_contexts(top), SIDE_SQL).select("bucket", "keys", "counts", every)

    def score(table: pa.Table, side: pa.Table) -> pa.Table:
        ids, flags, texts = _unpack_documents(table)
        value: dict[bytes, float] = {}
        codes, scores = [], []
        for kind, keys, counts in zip(side["kind"].to_pylist(), side["keys"].to_pylist(),
                                      side["counts"].to_pylist()):
            if kind == WORDS:
                value.update(zip(_unpack(keys).split(b"\n"),
                                 np.log10(_unpack(counts, np.int64) + 0.5).tolist()))
            else:
                codes.append(_unpack_codes(keys))
                scores.append(np.frombuffer(counts, np.float32))
        codes, scores = np.concatenate(codes), np.concatenate(scores)
        o = np.argsort(codes)
        codes, scores = codes[o], scores[o].astype(np.float64)
        n_tokens, n_known, base = [], [], []
        for t in texts:
            tokens = t.split()
            tokens.append(END_WORD)
            logs = np.fromiter(map(value.__getitem__, tokens), np.float64, len(tokens))
            n_tokens.append(len(tokens))
            n_known.append(int((logs > 0).sum()))      # log10(0.5) < 0 < log10(1.5)
            base.append(float(logs.sum()) - len(tokens) * each)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=flags & 1 == 0),
            "held_out": pa.array(flags & 2 != 0),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([train_tokens] * len(texts), pa.int64()),
            "base_score": pa.array(base, pa.float64()),
            "score": pa.array(text_scores(texts, codes, scores), pa.float64())})

    answers = (words.where(F.col("kind") == WORDS)
               .unionByName(contexts.select("block", "bucket", "keys", part(answer_blocks)).groupBy("bucket", "part")
                            .cogroup(scored.groupBy("bucket", "part")).applyInArrow(_answer_contexts, SIDE_SQL)))
    return packed.cogroup(answers.groupBy("block")).applyInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
               "train_tokens bigint, base_score double, score double")
