"""Distinct-count sketches of sets of ids (HyperLogLog), sent along edges and
united per vertex.

An id is a coupon: 26 bits of its hash, the lowest of which are a register's
number, and the number of leading zeros of the other bits plus one.  A sketch is
cut into slices of registers.  Of every slice there are either the coupons
themselves, which are counted exactly, or, once there are more than a quarter as
many as registers, the registers: the largest zero count met, a byte each.

Slices never meet, so all rounds of one are made in one task (``balls``): it holds
its slice of all sketches and goes through the edges, which are written once as
places of vertices, block by block of receivers.  Neither a sketch nor an edge is
sent anywhere in a round; a task sends on what it counted per vertex.

``unite`` is one round over a grid of cells (block of receivers, slice), for
sketches that are a table: a cell has the edges into its block and its slice of
all sketches, and every sketch comes once per block of receivers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package, written_files

ADDRESS_BITS = 26
MOST_ZEROS = 31             # a coupon has 31 bits
LEAST_SLICES = 8            # so that small graphs make several tasks, too
STATE_BYTES = 96 << 20      # registers of a slice, of all vertices
EDGES_PER_BLOCK = 2_000_000
LEAST_TASKS = 16
CHUNK_BYTES = 4 << 20       # registers united at once
HUB = 4096                  # edges into a vertex that is united by itself

STATE = "id bigint, slice int, known int, zeros int, power double, coupons array<int>, regs binary"


def grid_for(vertices: int, edges: int, lg_k: int) -> tuple[int, int]:
    """(blocks of receivers, slices) that bound what one task holds."""
    slices = LEAST_SLICES
    while slices < 2 ** lg_k // 16 and (vertices << lg_k) > slices * STATE_BYTES:
        slices *= 2
    return max(1, -(-edges // EDGES_PER_BLOCK)), slices


def coupon(col: str) -> Column:
    h = F.xxhash64(F.col(col).cast("bigint"))
    rest = F.shiftrightunsigned(h, ADDRESS_BITS)
    zeros = 64 - ADDRESS_BITS + 1 - F.when(rest == 0, 0).otherwise(F.length(F.bin(rest)))
    address = h.bitwiseAND(F.lit((1 << ADDRESS_BITS) - 1))
    return (F.least(zeros, F.lit(MOST_ZEROS)) * F.lit(1 << ADDRESS_BITS) + address).cast("int")


def _slice(c: Column, lg_k: int, slices: int) -> Column:
    return (c.bitwiseAND(F.lit(2 ** lg_k - 1)) / F.lit(2 ** lg_k // slices)).cast("int")


def singletons(ids: DataFrame, lg_k: int, slices: int) -> DataFrame:
    """(id, slice, coupons, regs): the sketch of the set {id} of every ``id``."""
    c = ids.select("id", coupon("id").alias("c"))
    return c.select("id", _slice(F.col("c"), lg_k, slices).alias("slice"), F.array("c").alias("coupons"),
                    F.lit(None).cast("binary").alias("regs"))


def unite(edges: DataFrame, sketches: DataFrame, blocks: int, slices: int, lg_k: int, keep: bool = True) -> DataFrame:
    """``STATE`` rows: for every ``id`` of ``edges`` (id, via) and every slice the
    union of the sketches of its ``via``.  ``known`` is the number of coupons, -1
    where registers are kept; ``zeros`` counts empty registers, ``power`` sums
    2^-register.  Without ``keep`` the sketches themselves are left out."""
    ship_package(edges.sparkSession)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    cells = blocks * slices
    left = (edges.select("id", "via", block.alias("j"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"))
            .select("id", "via", (F.col("j") * slices + F.col("s")).alias("cell")).repartitionById(cells, "cell"))
    right = (sketches.select("id", "slice", "coupons", "regs", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
             .select("id", "coupons", "regs", (F.col("j") * slices + F.col("slice")).alias("cell"))
             .repartitionById(cells, "cell"))
    width = 2 ** lg_k // slices

    def cell(key: tuple, into: pa.Table, sent: pa.Table) -> pa.Table:
        return _unite_cell(into, sent, key[0].as_py() % slices, width, keep)

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(cell, STATE)


def sizes(united: DataFrame, lg_k: int, name: str) -> DataFrame:
    """(id, ``name``): ``_size`` of whole sketches."""
    return united.groupBy("id").agg(_size("power", "zeros", "known", lg_k).alias(name))


def _size(power: str, zeros: str, known: str, lg_k: int) -> Column:
    """Aggregate of a vertex's slices: exact where all are coupons, else the estimate of
    O. Ertl (2017) from the sum over the registers and the number of empty ones."""
    m = float(2 ** lg_k)
    x = F.sum(zeros) / m
    sigma = x
    for k in range(1, lg_k + 7):
        sigma = sigma + F.pow(x, F.lit(float(2 ** k))) * float(2 ** (k - 1))
    estimate = F.lit(m * m / (2 * np.log(2))) / (m * sigma + F.sum(power) - F.sum(zeros))
    return F.when(F.min(known) >= 0, F.sum(known)).otherwise(F.round(estimate)).cast("bigint")


# --------------------------------------------------------------------------
# all rounds, slice by slice

def balls(ids: DataFrame, into: DataFrame, rounds: int, blocks: int, slices: int, lg_k: int) -> DataFrame:
    """(id, b1 ... b``rounds``): of every ``id`` of ``ids`` the number of ids that
    it reaches in so many steps along ``into`` (id, via), which holds (id, id), too.

    The edges are written as places in the sorted ids, in ``blocks`` of receivers,
    under ``spark.checkpoint.dir``; every task reads them there once a round and slice.
    """
    spark = into.sparkSession
    ship_package(spark)
    path, tasks = scratch_path(spark), min(slices, max(LEAST_TASKS, spark.sparkContext.defaultParallelism))
    every = (into.select("id", F.lit(False).alias("own")).unionByName(ids.select("id", F.lit(True).alias("own")))
             .groupBy("id").agg(F.max("own").alias("own")))
    every.select("id", "own", coupon("id").alias("c")).write.parquet(f"{path}/ids")
    (into.select("id", "via", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
     .repartitionById(blocks, "block").groupBy("block")
     .applyInArrow(lambda rows: _edge_block(rows, f"{path}/ids"), "receivers binary, counts binary, via binary")
     .write.option("parquet.block.size", str(8 << 20)).parquet(f"{path}/edges"))
    width, kept = 2 ** lg_k // slices, [f"{c}{r}" for r in range(1, rounds + 1) for c in ("power", "zeros", "known")]
    kind = {"power": "double", "zeros": "int", "known": "int"}

    def run(numbers: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in numbers:
            for t in batch.column(0).to_pylist():
                yield from _all_rounds(path, range(t, slices, tasks), width, rounds)

    found = spark.range(0, tasks, 1, tasks).mapInArrow(
        run, ", ".join(["id bigint", *(f"{c} {kind[c[:5]]}" for c in kept)]))
    return found.groupBy("id").agg(*[_size(f"power{r}", f"zeros{r}", f"known{r}", lg_k).alias(f"b{r}")
                                     for r in range(1, rounds + 1)])


@functools.lru_cache(maxsize=1)
def _vertices(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids in order, whether they are asked for, coupons) of a written table."""
    parts = [f.read(["id", "own", "c"]) for f in written_files(path)]
    table = pa.concat_tables(parts)
    ids, own, c = (table[name].to_numpy() for name in ("id", "own", "c"))
    order = np.argsort(ids)
    return ids[order], own[order], c[order]


def _edge_block(rows: pa.Table, path: str) -> pa.Table:
    """The edges into one block as int32 places: receivers by falling number of
    edges, these numbers, and the senders receiver by receiver."""
    ids = _vertices(path)[0]
    to, via = (np.searchsorted(ids, rows[c].to_numpy()).astype(np.int32) for c in ("id", "via"))
    receivers, to, counts = np.unique(to, return_inverse=True, return_counts=True)
    fewest = np.argsort(-counts, kind="stable")
    place = np.empty(len(fewest), np.int64)
    place[fewest] = np.arange(len(fewest))
    via = via[np.argsort(place[to], kind="stable")]
    columns = (receivers[fewest], counts[fewest].astype(np.int32), via)
    return pa.table([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["receivers", "counts", "via"])


def _edge_blocks(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(receivers, first edge of each and the end, senders) of every block."""
    for file in written_files(path):
        for batch in file.iter_batches(batch_size=1):
            receivers, counts, via = (np.frombuffer(c[0].as_buffer(), np.int32) for c in batch.columns)
            yield receivers, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), via


class _Slice:
    """One slice of all sketches: registers, and coupons of those that are listed."""

    def __init__(self, regs: np.ndarray, sparse: np.ndarray, starts: np.ndarray, lengths: np.ndarray, coupons: np.ndarray):
        self.regs, self.sparse, self.starts, self.lengths, self.coupons = regs, sparse, starts, lengths, coupons
        self.full = not sparse.all()

    @classmethod
    def of_vertices(cls, own: np.ndarray, coupons: np.ndarray, number: int, width: int, slices_width: int) -> "_Slice":
        mine = own & ((coupons & (slices_width - 1)) // width == number)
        lengths = mine.astype(np.int32)
        return cls(_registers(len(own), np.flatnonzero(mine), coupons[mine], width), np.ones(len(own), bool),
                   np.cumsum(lengths) - lengths, lengths, coupons[mine])


def _all_rounds(path: str, numbers: range, width: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Per asked id and round what the slices of these numbers count, added up."""
    ids, own, coupons = _vertices(f"{path}/ids")
    n, registers = len(ids), width * numbers.stop
    power, zeros, known = np.zeros((rounds, n)), np.zeros((rounds, n), np.int16), np.zeros((rounds, n), np.int16)
    powers = np.ldexp(1.0, -np.arange(256))
    for number in numbers:
        now = _Slice.of_vertices(own, coupons, number, width, registers)
        for r in range(rounds):
            last = r == rounds - 1
            regs = None if last else np.zeros((n, width), np.uint8)
            sparse, lengths, starts, values, listed = np.ones(n, bool), np.zeros(n, np.int32), np.zeros(n, np.int64), [], 0
            for receivers, first, at in _edge_blocks(f"{path}/edges"):
                for a, b in _chunks(first, width):
                    to = receivers[a:b]
                    united, count, few = _unite_rows(first[a:b + 1], at, now, width)
                    power[r, to] += powers[united].sum(axis=1)
                    zeros[r, to] += (united == 0).sum(axis=1).astype(np.int16)
                    known[r, to] = np.where((known[r, to] < 0) | (count < 0), -1, known[r, to] + count)
                    if not last:
                        regs[to], sparse[to], lengths[to] = united, count >= 0, np.maximum(count, 0)
                        starts[to] = listed + np.cumsum(lengths[to]) - lengths[to]
                        values.append(few)
                        listed += len(few)
            if not last:
                now = _Slice(regs, sparse, starts, lengths, np.concatenate(values))
                del regs
    for at in range(0, n, 1 << 17):
        some = np.flatnonzero(own[at:at + (1 << 17)]) + at
        columns = [pa.array(ids[some])]
        for r in range(rounds):
            columns += [pa.array(power[r, some]), pa.array(zeros[r, some].astype(np.int32)),
                        pa.array(known[r, some].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", *(f"{c}{r}" for r in range(1, rounds + 1)
                                                                for c in ("power", "zeros", "known"))])


def _chunks(first: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Receivers at a time: an eighth of CHUNK_BYTES of registers, 16 times as many edges as fill it, at most."""
    a, n = 0, len(first) - 1
    while a < n:
        b = int(np.searchsorted(first, first[a] + 16 * CHUNK_BYTES // width, "right")) - 1
        b = min(max(a + 1, b), a + max(1, CHUNK_BYTES // (8 * width)), n)
        yield a, b
        a = b


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every span, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _registers(rows: int, owner: np.ndarray, coupons: np.ndarray, width: int) -> np.ndarray:
    """rows × width registers of coupons."""
    regs = np.zeros((rows, width), np.uint8)
    zeros = coupons >> ADDRESS_BITS
    order = np.argsort(zeros, kind="stable")          # of equal places the last, largest, stays
    regs[owner[order], coupons[order] & (width - 1)] = zeros[order]
    return regs


def _unite_cell(into: pa.Table, sent: pa.Table, number: int, width: int, keep: bool) -> pa.Table:
    ids = sent["id"].to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    # a list's own values, whatever chunks and slices the column is in
    lists = sent["coupons"].combine_chunks().take(pa.array(order)) if len(order) else pa.array([], pa.list_(pa.int32()))
    sparse = lists.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(sparse, np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
    coupons = lists.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    regs = _registers(len(ids), np.repeat(np.arange(len(ids)), lengths), coupons, width)
    if not sparse.all():
        full = sent["regs"].combine_chunks().take(pa.array(order[~sparse]))
        regs[~sparse] = np.frombuffer(b"".join(full.to_pylist()), np.uint8).reshape(-1, width)
        del full

    # edges by receiver, those whose sender has nothing in this slice left out
    receivers, to = np.unique(into["id"].to_numpy(), return_inverse=True)
    via = into["via"].to_numpy()
    del into, sent
    at = np.searchsorted(ids, via)
    met = (at < len(ids)) & (ids[np.minimum(at, max(len(ids) - 1, 0))] == via) if len(ids) else np.zeros(len(via), bool)
    to, at = to[met].astype(np.int32), at[met].astype(np.int32)
    order = np.argsort(to, kind="stable")
    to, at = to[order], at[order]
    first = np.searchsorted(to, np.arange(len(receivers) + 1))

    now = _Slice(regs, sparse, starts, lengths, coupons)
    powers = np.ldexp(1.0, -np.arange(256))
    out = []
    for a, b in _chunks(first, width):
        united, known, few = _unite_rows(first[a:b + 1], at, now, width)
        ends = np.concatenate([[0], np.cumsum(np.maximum(known, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(few), mask=pa.array(known < 0))
        full = pa.array([None if k >= 0 else row.tobytes() for k, row in zip(known.tolist(), united)], pa.binary()) if keep else None
        n = b - a
        out.append(pa.table({
            "id": pa.array(receivers[a:b], pa.int64()), "slice": pa.array(np.full(n, number, np.int32)),
            "known": pa.array(known), "zeros": pa.array((united == 0).sum(axis=1).astype(np.int32)),
            "power": pa.array(powers[united].sum(axis=1)),
            "coupons": lists if keep else pa.nulls(n, pa.list_(pa.int32())),
            "regs": full if keep else pa.nulls(n, pa.binary())}))
    return pa.concat_tables(out)


def _unite_rows(first: np.ndarray, at: np.ndarray, now: _Slice, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(registers, number of coupons or -1, coupons of those that have them) of the
    unions of the sketches at places ``at``, from first[i] to first[i + 1] each."""
    n, begin = len(first) - 1, first - first[0]
    part = at[first[0]:first[-1]]
    sums = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[begin])
    total = sums(now.lengths[part])
    listed = sums(~now.sparse[part]) == 0 if now.full else np.ones(n, bool)
    # few coupons are listed only; of others, registers in use are as many as different coupons, at most
    thin = listed & (total <= width)
    united = np.zeros((n, width), np.uint8)
    thick = np.flatnonzero(~thin)
    if len(thick):
        united[thick] = _unite_registers(first[thick], np.diff(first)[thick], at, now.regs)
        listed[thick] &= (united[thick] != 0).sum(axis=1) <= width // 4
    few = np.flatnonzero(listed)
    edges = _spans(begin[few], np.diff(begin)[few])
    whose = np.repeat(np.arange(len(few)), np.diff(begin)[few])
    some = now.lengths[part[edges]] > 0
    edges, whose = part[edges[some]], whose[some]
    step = max(1, 8 * CHUNK_BYTES // width)
    key = np.zeros(0, np.int64)
    for e in range(0, len(edges), step):              # of an edge a quarter of ``width`` coupons at most
        sent = edges[e:e + step]
        own = np.repeat(whose[e:e + step], now.lengths[sent]).astype(np.int64)
        key = np.unique(np.concatenate([key, (own << 32) | now.coupons[_spans(now.starts[sent], now.lengths[sent])]]))
    owner, values = key >> 32, (key & 0xffffffff).astype(np.int32)
    count = np.bincount(owner, minlength=len(few))
    known = np.full(n, -1, np.int32)
    known[few] = np.where(count <= width // 4, count, -1)
    mine = thin[few][owner]
    united[thin] = _registers(n, few[owner[mine]], values[mine], width)[thin]
    return united, known, values[known[few][owner] >= 0]


def _unite_registers(first: np.ndarray, counts: np.ndarray, at: np.ndarray, regs: np.ndarray) -> np.ndarray:
    """The largest registers of the rows at[first], at[first + 1], ... (``counts`` of them)."""
    out = np.zeros((len(first), regs.shape[1]), np.uint8)
    for i in np.flatnonzero(counts > HUB):
        for e in range(0, counts[i], HUB):
            np.maximum(out[i], regs[at[first[i] + e:first[i] + min(e + HUB, counts[i])]].max(axis=0), out=out[i])
    # the others together: one edge of each at a time, those with most edges first
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] <= HUB]
    if len(order):
        start, falling = first[order], -counts[order]
        best, sent = np.zeros((len(order), regs.shape[1]), np.uint8), np.empty((len(order), regs.shape[1]), np.uint8)
        for k in range(-falling[0]):
            m = int(np.searchsorted(falling, -k, "left"))    # have more than k edges
            np.take(regs, at[start[:m] + k], axis=0, out=sent[:m], mode="clip")
            np.maximum(best[:m], sent[:m], out=best[:m])
        out[order] = best
    return out
