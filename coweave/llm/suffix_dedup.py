"""Suffix-array dedup: remove byte strings that an earlier document has too.

A byte goes if a string of ``min_bytes`` bytes covers it that also starts in
a document with a smaller doc_id.

**Suffix arrays by linear grouping.**  ``group_suffixes`` sorts suffixes
without recursive renaming.  Suffixes are grouped by their longest Lyndon
prefix known so far, starting with the first byte.  Groups are processed in
descending order: every member points at the nearest place before it in a
lower group (its previous smaller one, found along earlier pointers), and the
places pointed at move behind the rest of their group, by how many members
point at them, since the processed prefix extends theirs that many times.
Then groups are emitted in ascending order: members follow the order of the
suffix behind their Lyndon prefix, which has its rank already.  Many strings
are sorted side by side, one group of each at a time, with array operations.

**The job.**  All strings of ``min_bytes`` bytes that are equal have the same
smallest hash of their 24-byte substrings, their anchor.  A text falls into
runs of strings with one anchor (about 14 in a run).

1. Copies of a whole text are found by digest; the smallest doc_id goes on.
2. Documents are dealt into blocks.  Every block asks which of its anchors
   occur in another document as well; questions are packed arrays, dealt by
   anchor, each anchor once per block.
3. Runs with a shared anchor are cut out (each different one once per block)
   and dealt by anchor.  Where an anchor has very many different runs, these
   are cut further by the anchors that other hash functions give, and dealt
   by all of them.  The different runs dealt together are put behind each
   other and suffix-sorted; neighbours that share ``min_bytes`` bytes form
   classes, and a class removes all but its smallest doc_id.
4. Every block removes the strings found from its texts.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_bytes

MIN_BYTES = 50
ANCHOR_BYTES = 24          # a multiple of eight
BLOCK_BYTES = 8 << 20
ASKS_PER_BUCKET = 1 << 20
RUNS_PER_STRING = 512
MAX_CUTS = 3
# strings up to so many bytes are sorted in batches of so many
BATCHES = ((1 << 10, 1 << 18), (1 << 13, 1 << 20), (1 << 62, 1 << 22))

PAD, SENTINEL, SEPARATOR, FIRST_BYTE = 0, 1, 2, 3


# --------------------------------------------------------------------------
# suffix arrays

def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... (n[0] of them), lo[1], ..."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def group_suffixes(sym: np.ndarray) -> np.ndarray:
    """Places of ``sym`` in suffix order, string after string.  Each string is
    PAD, its symbols, SENTINEL; PAD places are not in the result."""
    n_places = len(sym)
    string = np.cumsum(sym == PAD)
    places = np.flatnonzero(sym != PAD)
    # members of a group come in any order at first
    sa = places[np.argsort(string[places] * 512 + sym[places])].astype(np.int32)
    isa = np.full(n_places, -1, np.int32)
    isa[sa] = np.arange(len(sa))
    key = string[sa] * 512 + sym[sa]
    heads = _starts(key)
    size = np.zeros(len(sa), np.int32)
    size[heads] = np.diff(np.append(heads, len(sa)))
    length = np.ones(len(sa), np.int32)             # of the group's Lyndon prefix
    group = np.full(n_places, -1, np.int32)         # of a place: where its group starts in sa
    group[sa] = np.repeat(heads, size[heads])
    prev = np.zeros(n_places, np.int32)
    moving = np.zeros(n_places, bool)
    first = _starts(string[sa])
    end = np.append(first, len(sa))[1:].copy()

    active = np.flatnonzero(end > first + 1)
    while len(active):
        hi = end[active]
        lo = group[sa[hi - 1]]
        count = hi - lo
        members = sa[_ranges(lo, count)]
        floor = np.repeat(lo, count)
        # previous smaller place, along the pointers known so far
        prev[members] = p = members - 1
        todo = np.flatnonzero(group[p] >= floor)
        while len(todo):
            p[todo] = prev[p[todo]]
            prev[members[todo]] = p[todo]
            todo = todo[group[p[todo]] >= floor[todo]]
        found = group[p] >= 0
        if found.any():
            p, prefix = p[found], np.repeat(length[lo], count)[found]
            by_place = np.argsort(p, kind="stable")
            p, prefix = p[by_place], prefix[by_place]
            heads = _starts(p)
            times = np.diff(np.append(heads, len(p)))
            p, prefix = p[heads], prefix[heads]
            own = group[p]
            by_group = np.lexsort((times, own))
            p, prefix, own, times = p[by_group], prefix[by_group], own[by_group], times[by_group]
            heads = _starts(own)
            n_moved = np.diff(np.append(heads, len(own)))
            from_group = own[heads]
            tail = from_group + size[from_group] - n_moved
            slots = _ranges(tail, n_moved)
            now = isa[p]
            moving[p] = True
            stays = sa[slots]
            stays = stays[~moving[stays]]           # they make room for those that move
            room = now[now < np.repeat(tail, n_moved)]
            moving[p] = False
            sa[room], isa[stays] = stays, room
            sa[slots], isa[p] = p, slots
            new = _starts(own * np.int64(len(sym) + 1) + times)
            n_new = np.diff(np.append(new, len(own)))
            longer = length[own[new]] + times[new] * prefix[new]
            size[from_group] -= n_moved
            at = slots[new]
            size[at], length[at] = n_new, longer
            group[p] = np.repeat(at, n_new)
        end[active] = lo
        active = active[lo > first[active] + 1]

    # emit: members of a group in the order of the suffixes behind their prefix
    behind = places + length[group[places]]
    follow = np.zeros(n_places, np.int32)
    follow[places] = np.minimum(behind, n_places - 1)
    rank = np.full(n_places, -1, np.int32)
    alone = size[group[places]] == 1
    rank[places[alone]] = group[places[alone]]
    heads = np.flatnonzero(size > 1)
    if len(heads):
        of = string[sa[heads]]
        begin = _starts(of)
        turn = np.arange(len(heads)) - np.repeat(begin, np.diff(np.append(begin, len(heads))))
        by_turn = np.argsort(turn, kind="stable")
        heads, turn = heads[by_turn], turn[by_turn]
        cuts = np.append(_starts(turn), len(heads))
        for a, b in zip(cuts, cuts[1:]):
            lo = heads[a:b]
            members = sa[_ranges(lo, size[lo])]
            front = np.zeros(b - a, np.int64) + lo
            which = np.repeat(np.arange(b - a), size[lo])
            while len(members):
                known = rank[follow[members]]
                ready = known >= 0
                m, w = members[ready], which[ready]
                o = np.lexsort((known[ready], w))
                m, w = m[o], w[o]
                begin = _starts(w)
                n = np.diff(np.append(begin, len(w)))
                rank[m] = _ranges(front[w[begin]], n)
                front[w[begin]] += n
                members, which = members[~ready], which[~ready]
        sa[rank[places]] = places
    return sa


def equal_windows(strings: list[list[bytes]], width: int) -> tuple[np.ndarray, ...]:
    """Classes of equal ``width``-byte windows within each string, which is
    given as its fragments: (fragment, offset, class) arrays of all windows,
    classes in suffix order.  Fragments count through all strings."""
    frag_n = np.array([len(f) for s in strings for f in s])
    per_string = np.array([len(s) for s in strings])
    raw = np.frombuffer(b"".join(b"\0" + b"\0".join(s) + b"\0" for s in strings), np.uint8)
    last = np.cumsum(per_string) - 1                  # last fragment of each string
    first = last - per_string + 1
    before = np.cumsum(frag_n + 1) - frag_n           # the byte before, of fragments without PADs
    frag_at = before + np.repeat(np.arange(len(strings)), per_string)
    sym = raw.astype(np.uint16) + np.uint16(FIRST_BYTE)
    sym[frag_at - 1] = SEPARATOR
    sym[frag_at[first] - 1] = PAD
    sym[(frag_at + frag_n)[last]] = SENTINEL
    sa = group_suffixes(sym)
    windows = np.maximum(frag_n - width + 1, 0)
    starts = np.zeros(len(sym), bool)
    starts[_ranges(frag_at, windows)] = True
    string = np.cumsum(sym == PAD)
    a, b = sa[:-1], sa[1:]
    same = np.flatnonzero(starts[a] & starts[b] & (string[a] == string[b]))
    # neighbours that share a whole window, compared eight bytes at a time
    step = min(8, width)
    code = raw.astype(np.uint64)
    for k in range(1, step):
        code[:-k] |= raw[k:].astype(np.uint64) << np.uint64(8 * k)
    for k in (*range(0, width - step, step), width - step):
        same = same[code[a[same] + k] == code[b[same] + k]]
    new = np.ones(len(sa), bool)
    new[same + 1] = False
    cls = np.cumsum(new) - 1
    keep = starts[sa]
    place, cls = sa[keep], cls[keep]
    fragment = np.searchsorted(frag_at, place, side="right") - 1
    return fragment, place - frag_at[fragment], cls


# --------------------------------------------------------------------------
# anchors

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _substring_hashes(text: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """From each place on, the next eight bytes as a number and the hash of
    the next ANCHOR_BYTES."""
    c = np.frombuffer(text, np.uint8).astype(np.uint64)
    for step in (1, 2, 4):
        c = c[:-step] | c[step:] << np.uint64(8 * step)
    n = len(text) - ANCHOR_BYTES + 1
    h = np.full(n, seed, np.uint64)
    for at in range(0, ANCHOR_BYTES, 8):
        h ^= c[at:at + n]
        h *= _K1
        h ^= h >> np.uint64(29)
    h *= _K2
    h ^= h >> np.uint64(32)
    return c, h


def window_anchors(text: bytes, width: int = MIN_BYTES, seed: int = 0) -> np.ndarray:
    """Anchor of every window of a text: the smallest hash of its substrings of
    ANCHOR_BYTES.  ``width`` must be that or more; ``seed`` picks the hash."""
    if len(text) < width:
        return np.zeros(0, np.uint64)
    h = _substring_hashes(text, seed)[1]
    span, step = width - ANCHOR_BYTES + 1, 1
    while step * 2 <= span:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if step < span:
        h = np.minimum(h[:len(h) - (span - step)], h[span - step:])
    return h


def anchor_runs(text: bytes, width: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor, first window, last window + 1."""
    h = window_anchors(text, width)
    first = _starts(h)
    return h[first], first, np.append(first[1:], len(h)).astype(np.int64)


@functools.lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    return np.cumprod(np.full(n, _K1)), np.cumprod(np.full(n, np.uint64(pow(int(_K1), -1, 1 << 64))))


def run_contents(text: bytes, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """A number for the bytes of each run, equal for equal bytes (and seldom
    otherwise: it serves to count different runs)."""
    n = len(text)
    power, inverse = _powers(1 << n.bit_length())
    power = power[:n]
    total = np.append(np.uint64(0), np.cumsum((np.frombuffer(text, np.uint8) + np.uint64(1)) * power))
    return (total[last + width - 1] - total[first]) * inverse[first] + (last - first).astype(np.uint64)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of [start, end) spans, maximal runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# --------------------------------------------------------------------------
# the job.  ``ord`` is the doc_id that decides (a null one ranks last), ``uid``
# tells texts of one doc_id apart.  Side rows (block, kind, a, b) carry what a
# block is told: which uids are copies, which anchors are shared, which spans
# of which uid go.

SIDE = "block int, kind int, a binary, b binary"
COPY, SHARED, SPANS = 0, 1, 2
NULL_ORD = (1 << 63) - 1


def _side(block, kind: int, a: list[bytes], b: list[bytes]) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int32()), "kind": pa.array([kind] * len(a), pa.int32()),
                     "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _told(side: pa.Table, kind: int) -> tuple[bytes, bytes]:
    rows = [(a, b) for k, a, b in zip(side["kind"].to_pylist(), side["a"].to_pylist(),
                                      side["b"].to_pylist()) if k == kind]
    return b"".join(a for a, _ in rows), b"".join(b or b"" for _, b in rows)


def _documents(table: pa.Table, side: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """(ord, uid, text) of a block's rows that are not copies."""
    copies = set(np.frombuffer(_told(side, COPY)[0], np.int64).tolist())
    for order, uid, body in zip(table["ord"].to_pylist(), table["uid"].to_pylist(),
                                table["body"].to_pylist()):
        if uid not in copies:
            yield order, uid, body


def _pack(data: np.ndarray) -> bytes:
    return zstandard.compress(data.tobytes(), 1)


def _unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype)


def _pack_sorted(numbers: np.ndarray) -> bytes:
    return _pack(np.diff(numbers, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _ask(width: int, buckets: int):
    """Block -> its anchors, how many different runs have them and whether two
    of its own documents do, packed by bucket."""
    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        found, owner, content = [], [], []
        for order, _, body in _documents(table, side):
            anchors, first, last = anchor_runs(body, width)
            if len(anchors):
                found.append(anchors)
                owner.append(np.full(len(anchors), order, np.int64))
                content.append(run_contents(body, first, last, width))
        if not found:
            return ASK_SCHEMA.empty_table()
        anchors, owner, content = np.concatenate(found), np.concatenate(owner), np.concatenate(content)
        pair = anchors * _K1 ^ content              # one sort each for runs and anchors
        o = np.argsort(pair)
        different = np.sort(anchors[o][_starts(pair[o])])
        o = np.argsort(anchors)
        anchors, owner = anchors[o], owner[o]
        heads = _starts(anchors)
        n = np.diff(np.append(_starts(different), len(different)))
        two = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
        anchors = anchors[heads]
        # the top bits of the least of many hashes are mostly zero
        bucket = (anchors * _K2 >> np.uint64(20)) % np.uint64(buckets)
        o = np.argsort(bucket, kind="stable")
        cuts = _starts(bucket[o])
        block = table["block"][0].as_py()
        packed = [o[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(o)))]
        return pa.table({
            "bucket": pa.array([int(bucket[p[0]]) for p in packed], pa.int32()),
            "block": pa.array([block] * len(packed), pa.int32()),
            "anchors": pa.array([_pack_sorted(anchors[p]) for p in packed], pa.binary()),
            "runs": pa.array([_pack(n[p] << 1 | two[p]) for p in packed], pa.binary())})
    return run


ASK_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int32()),
                        ("anchors", pa.binary()), ("runs", pa.binary())])


def _answer(runs_per_string: int):
    """Bucket -> per block, the anchors that two documents have, and how many
    more anchors their runs are cut by."""
    def run(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_pylist()
        anchors = [_unpack_sorted(x) for x in table["anchors"].to_pylist()]
        runs = [_unpack(x, np.int64) for x in table["runs"].to_pylist()]
        from_row = np.repeat(np.arange(len(blocks)), list(map(len, anchors)))
        a, r = np.concatenate(anchors), np.concatenate(runs)
        o = np.argsort(a)
        heads = _starts(a[o])
        n = np.diff(np.append(heads, len(o)))
        shared = (n > 1) | np.bitwise_or.reduceat(r[o] & 1, heads).astype(bool)
        runs_of = np.add.reduceat(r[o] >> 1, heads)
        # one more for each factor of 16 above the bound
        more = np.searchsorted(runs_per_string * 16 ** np.arange(MAX_CUTS), runs_of, side="left")
        keep = np.repeat(shared, n)
        rows, more = o[keep], np.repeat(more, n)[keep]
        back = np.lexsort((a[rows], from_row[rows]))
        rows, more = rows[back], more[back]
        cuts = _starts(from_row[rows])
        packed = [(rows[x:y], more[x:y]) for x, y in zip(cuts, np.append(cuts[1:], len(rows)))]
        return _side([blocks[from_row[p[0]]] for p, _ in packed], SHARED,
                     [a[p].tobytes() for p, _ in packed],
                     [m.astype(np.int32).tobytes() for _, m in packed])
    return run


FRAGMENT = pa.schema([("anchor", pa.int64()), ("deal", pa.int64()), ("fragment", pa.binary()),
                      ("ord", pa.int64()), ("uid", pa.int64()), ("block", pa.int32()),
                      ("at", pa.binary())])
FRAGMENT_SQL = ("anchor bigint, deal bigint, fragment binary, ord bigint, uid bigint, block int, at binary")


def _finer(text: bytes, width: int, levels: int) -> list[np.ndarray]:
    """Per window, the anchors by the first one, two, ... other hashes as one
    positive number each."""
    out, key = [], np.uint64(0)
    for seed in range(1, levels + 1):
        key = (key ^ window_anchors(text, width, seed)) * _K1
        out.append((key >> np.uint64(1)).view(np.int64))
    return out


def _cut(width: int):
    """Block -> its different runs with a shared anchor.  Of equal runs, the
    one with the smallest doc_id is sent; the others hold nothing else, so
    they are answered at once (deal -1; dealt ones are 0 or above)."""
    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        anchors, more = _told(side, SHARED)
        anchors = np.frombuffer(anchors, np.uint64)
        o = np.argsort(anchors)
        anchors, more = anchors[o], np.frombuffer(more, np.int32)[o]
        block = table["block"][0].as_py() if table.num_rows else 0
        least: dict[tuple, list] = {}               # run -> [ord, {uid: [places]}]
        gone: dict[int, list[int]] = {}             # uid -> [start, end, ...]
        if not len(anchors):
            return FRAGMENT.empty_table()

        def note(key: tuple, n: int, order: int, uid: int, at: int):
            entry = least.get(key)
            if entry is None:
                least[key] = [order, {uid: [at]}]
            elif order == entry[0]:
                entry[1].setdefault(uid, []).append(at)
            elif order > entry[0]:
                gone.setdefault(uid, []).extend((at, at + n))
            else:
                for other, places in entry[1].items():
                    for x in places:
                        gone.setdefault(other, []).extend((x, x + n))
                least[key] = [order, {uid: [at]}]

        for order, uid, body in _documents(table, side):
            found, first, last = anchor_runs(body, width)
            if not len(found):
                continue
            at = np.minimum(np.searchsorted(anchors, found), len(anchors) - 1)
            hit = np.flatnonzero(anchors[at] == found)
            cuts = more[at[hit]]
            finer = _finer(body, width, int(cuts.max(initial=0)))
            for anchor, cut, a, b in zip(found[hit].view(np.int64).tolist(), cuts.tolist(),
                                         first[hit].tolist(), last[hit].tolist()):
                if not cut:
                    note((anchor, 0, body[a:b + width - 1]), b + width - 1 - a, order, uid, a)
                    continue
                keys = finer[cut - 1][a:b]
                heads = _starts(keys)
                for x, y, deal in zip((heads + a).tolist(), [*(heads[1:] + a).tolist(), b], keys[heads].tolist()):
                    note((anchor, deal, body[x:y + width - 1]), y + width - 1 - x, order, uid, x)
        rows = [(*key, order, uid, array("i", places).tobytes())
                for key, (order, uids) in least.items() for uid, places in uids.items()]
        rows += [(0, -1, b"", 0, uid, array("i", spans).tobytes()) for uid, spans in gone.items()]
        cols = list(zip(*rows)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(
            [*cols[:5], [block] * len(rows), cols[5]], FRAGMENT.types)], schema=FRAGMENT)
    return run


def _trim(strings: list[tuple[int, list]], width: int) -> list[list[tuple]]:
    """Fragments (bytes, ord, owners) of each (anchor, fragments) as (bytes,
    ord, owners, first byte kept), without what no two fragments can share.

    A shared window holds the anchor and reaches ``half`` bytes beyond it to
    one side at least.  A fragment whose ``half`` bytes on a side no other
    fragment of the string has needs less than that on this side; one alone
    on both sides is left out.  Contexts are compared by a number that equal
    bytes share, so nothing that could match is lost.  Strings in which the
    anchor occurs twice in a fragment stay as they are.
    """
    half = (width - ANCHOR_BYTES) // 2
    frags = [f for _, s in strings for f in s]
    size = np.array([len(f[0]) for f in frags])
    if half < 8:
        return [[(*f, 0) for f in s] for _, s in strings]
    string = np.repeat(np.arange(len(strings)), [len(s) for _, s in strings])
    anchor = np.array([a for a, _ in strings], np.int64).view(np.uint64)[string]
    end = np.cumsum(size)
    start = end - size
    text = b"".join(f[0] for f in frags)
    code, h = _substring_hashes(text + bytes(8), 0)
    h = h[:len(text) - ANCHOR_BYTES + 1]
    of = np.repeat(np.arange(len(frags)), size)[:len(h)]
    hit = np.flatnonzero((h == anchor[of]) & (np.arange(len(h)) + ANCHOR_BYTES <= end[of]))
    first = np.zeros(len(frags), np.int64)
    first[of[hit[::-1]]] = hit[::-1]
    times = np.bincount(of[hit], minlength=len(frags))
    plain = ~np.isin(string, string[times != 1])
    last = first + ANCHOR_BYTES

    def shared(has: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.zeros(len(frags), bool)
        who = np.flatnonzero(has & plain)
        number = code[one[who]] * _K1 ^ code[two[who]] * _K2
        o = np.lexsort((number, string[who]))
        who, number = who[o], number[o]
        same = (string[who][1:] == string[who][:-1]) & (number[1:] == number[:-1])
        out[who[1:][same]] = out[who[:-1][same]] = True
        return out
    left = shared(first - start >= half, first - half, first - 8)
    right = shared(end - last >= half, last, last + half - 8)
    lo = np.where(left | ~plain, start, np.maximum(start, first - half + 1))
    hi = np.where(right | ~plain, end, np.minimum(end, last + half - 1))
    out: list[list[tuple]] = [[] for _ in strings]
    for n in np.flatnonzero(hi - lo >= width).tolist():
        out[string[n]].append((text[lo[n]:hi[n]], *frags[n][1:], int(lo[n] - start[n])))
    return [s for s in out if len(s) > 1]


def _resolve(width: int):
    """Sorted runs -> spans that go, as side rows.  Equal runs meet first: all
    but the smallest doc_id's go whole.  Different runs of one string are
    suffix-sorted, many strings at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # strings of [(fragment, ord, [(block, uid, at)])], waiting by size: a
        # batch takes as many steps as its longest string needs
        waiting: list[list] = [[] for _ in BATCHES]
        pending = [0] * len(BATCHES)
        current: list[tuple] = []
        key = None
        out: dict[tuple[int, int], array] = {}      # (block, uid) -> start, end, ...

        def go(owners: list[tuple], start: int, end: int):
            """the span goes at every place of the owners"""
            for block, uid, places in owners:
                spans = out.get((block, uid))
                if spans is None:
                    spans = out[block, uid] = array("i")
                for at in array("i", places):
                    spans.append(at + start)
                    spans.append(at + end)

        def add():
            if len(current) > 1:
                size = sum(len(f[0]) + 1 for f in current)
                n = next(n for n, (most, _) in enumerate(BATCHES) if size <= most)
                waiting[n].append((key[0], current))
                pending[n] += size
                if pending[n] >= BATCHES[n][1]:
                    sort(n)

        def sort(n: int):
            strings = _trim(waiting[n], width)
            waiting[n].clear()
            pending[n] = 0
            if not strings:
                return
            frags = [f for s in strings for f in s]
            ords = np.array([f[1] for f in frags])
            frag, offset, cls = equal_windows([[f[0] for f in s] for s in strings], width)
            if len(frag):
                heads = _starts(cls)
                n = np.diff(np.append(heads, len(cls)))
                least = np.repeat(np.minimum.reduceat(ords[frag], heads), n)
                late = ords[frag] > least
                frag, offset = frag[late], offset[late]
            if len(frag):
                o = np.lexsort((offset, frag))
                frag, offset = frag[o], offset[o]
                # windows that follow each other in a fragment make one span
                new = _starts(frag * (1 << 32) + offset - np.arange(len(frag)))
                ends = np.append(new[1:], len(frag)) - 1
                for f, a, b in zip(frag[new].tolist(), offset[new].tolist(), offset[ends].tolist()):
                    go(frags[f][2], frags[f][3] + a, frags[f][3] + b + width)

        def flush():
            """a row per block: uids, and per uid the number of spans and these"""
            by_block: dict[int, tuple[array, array]] = {}
            for (block, uid), spans in out.items():
                uids, data = by_block.setdefault(block, (array("q"), array("i")))
                uids.append(uid)
                data.append(len(spans) // 2)
                data.extend(spans)
            out.clear()
            return _side(list(by_block), SPANS, [u.tobytes() for u, _ in by_block.values()],
                         [d.tobytes() for _, d in by_block.values()]).combine_chunks().to_batches()

        for batch in batches:
            for anchor, deal, fragment, order, uid, block, at in zip(*(c.to_pylist() for c in batch.columns)):
                if deal < 0:
                    out.setdefault((block, uid), array("i")).frombytes(at)
                    continue
                if (anchor, deal) != key:
                    add()
                    key, current = (anchor, deal), []
                if not current or fragment != current[-1][0]:
                    current.append((fragment, order, [(block, uid, at)]))
                elif order == current[-1][1]:
                    current[-1][2].append((block, uid, at))
                else:
                    go([(block, uid, at)], 0, len(fragment))
            if len(out) >= 50_000:
                yield from flush()
        add()
        for n in range(len(BATCHES)):
            if waiting[n]:
                sort(n)
        if out:
            yield from flush()
    return run


def _remove(width: int, carried: list[str], with_text: bool):
    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        copies = set(np.frombuffer(_told(side, COPY)[0], np.int64).tolist())
        spans: dict[int, list[tuple[int, int]]] = {}
        for kind, a, b in zip(side["kind"].to_pylist(), side["a"].to_pylist(), side["b"].to_pylist()):
            if kind == SPANS:
                data, at = np.frombuffer(b, np.int32).tolist(), 0
                for uid in np.frombuffer(a, np.int64).tolist():
                    stop = at + 1 + 2 * data[at]
                    spans.setdefault(uid, []).extend(zip(data[at + 1:stop:2], data[at + 2:stop:2]))
                    at = stop
        n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
        for uid, body in zip(table["uid"].to_pylist(), table["body"].to_pylist()):
            if uid in copies and len(body) >= width:
                runs = [(0, len(body))]
            else:
                runs = _merge(spans.get(uid, []))
            cuts = [0, *(x for r in runs for x in r), len(body)]
            rest = b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            n_bytes.append(len(body))
            n_removed.append(len(body) - len(rest))
            n_spans.append(len(runs))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        out = {"doc_id": table["doc_id"], "n_bytes": pa.array(n_bytes, pa.int64()),
               "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
               "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            # a span may cut a character; its other half goes with it
            out["kept"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.table(out | {c: table[c] for c in carried})
    return run


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, with_text: bool = False,
                   carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES,
                   runs_per_string: int = RUNS_PER_STRING) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed,
    n_spans, kept_sha256, with ``with_text`` also kept (the text that is left,
    without characters that were cut in two), and the columns in ``carry``
    (from ``docs``, as ``carried_<place>``).

    Texts are UTF-8 bytes, null is empty.  Matches never cross documents and
    are judged on the input.  Rows that share a doc_id don't remove each
    other's strings; a null doc_id counts as larger than all others, rows
    without one don't remove each other's.  Texts below ``min_bytes`` are kept
    whole; an empty table gives an empty result.
    """
    if min_bytes < ANCHOR_BYTES:
        raise ValueError(f"min_bytes must be at least {ANCHOR_BYTES}")
    body = text_bytes()
    carried = [f"carried_{n}" for n in range(len(carry))]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("body"),
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ORD)).alias("ord"),
                       F.xxhash64(F.col("doc_id").cast("bigint"), body).alias("uid"),
                       *[F.col(c).alias(n) for c, n in zip(carry, carried)])
    digests = cut_lineage(rows.select("ord", "uid", F.sha2("body", 256).alias("digest"),
                                      F.octet_length("body").alias("n")))
    size = digests.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = 1 + size // block_bytes
    buckets = 1 + size // 20 // ASKS_PER_BUCKET
    block = F.pmod(F.col("uid"), F.lit(blocks)).cast("int").alias("block")
    rows = rows.withColumn("block", block)

    # written, so that the join below is one of plain exchanges, which AQE
    # splits where one text has very many copies
    least = cut_lineage(digests.groupBy("digest").agg(F.min("ord").alias("least")))
    copies = cut_lineage(digests.join(least, "digest").where(F.col("ord") != F.col("least"))
                         .select(block, F.lit(COPY).alias("kind"), _little_endian("uid").alias("a"),
                                 F.lit(None).cast("binary").alias("b")))

    asks = (rows.groupBy("block").cogroup(copies.groupBy("block"))
            .applyInArrow(_ask(min_bytes, buckets), "bucket int, block int, anchors binary, runs binary"))
    shared = asks.groupBy("bucket").applyInArrow(_answer(runs_per_string), SIDE)
    runs = (rows.groupBy("block").cogroup(shared.unionByName(copies).groupBy("block"))
            .applyInArrow(_cut(min_bytes), FRAGMENT_SQL))
    spread = F.when(F.col("deal") < 0, F.col("uid")).otherwise(F.col("anchor"))
    gone = (runs.withColumn("spread", F.xxhash64(spread, "deal")).repartition("spread")
            .sortWithinPartitions("anchor", "deal", "fragment", "ord", "uid")
            .drop("spread").mapInArrow(_resolve(min_bytes), SIDE))
    fields = ["doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"]
    fields += ["kept string"] * with_text
    fields += [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, carried)]
    return (rows.groupBy("block").cogroup(gone.unionByName(copies).groupBy("block"))
            .applyInArrow(_remove(min_bytes, carried, with_text), ", ".join(fields)))


def _little_endian(col: str):
    """Eight bytes of a number, least first, as numpy reads them."""
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(col), 16, "0"), at, 2) for at in range(15, 0, -2)]))


def drop_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with its columns, ``text`` without what an earlier document
    has too and ``n_chars`` of what is left.  Every row stays."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = remove_repeats(docs, min_bytes, with_text=True, carry=carry)
    names = {c: f"carried_{n}" for n, c in enumerate(carry)}
    return out.select(*[
        F.col("kept").alias("text") if c == "text"
        else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(names.get(c, c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
