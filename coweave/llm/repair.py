"""Conversation structure repair by iterative-deepening A*.

A conversation's turns should read ``(s?(ua)+)?`` by the initials of their
roles (system, user, assistant).  Four edits mend one that does not: Delete a
turn, Insert an empty user or assistant turn, Keep, or Rerole to user or
assistant.  The place in that pattern is one of four states, and a state
leaves one role only that an inserted or rerolled turn can have, so a string
of edits (the audit) says everything.

The cheapest audit comes from a depth-first search that tries the edits in
ASCII order (D, I, K, R) under a cost bound, raised to the least estimate that
went over it until a path is accepted.  The estimate adds to the cost so far
what the remaining turns cost at the least: forced deletes, truncated turns,
and disjoint faults of single turns or neighbours.  A table of failed states
(with the cost that was left) cuts repeated work.  The first accepting path is
the cheapest one, and of those the first in ASCII order.

Turns are dealt by range in conversation order, and cut into segments of
``SEGMENT`` turns, so that a conversation of any length is searched by many
tasks.  A conversation of one segment is searched to its end; a segment of a
longer one is searched from every state to every state, and the best way
through all its segments is found by two passes over these costs alone.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh_name

SEGMENT = 64             # turns searched at a time
SEGMENT_CHARS = 4 << 20  # a segment ends beyond so much text, too
SPACE = " \t\n\x0b\f\r"

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
GIVEN = (USER, USER, ASSISTANT, USER)       # by an inserted or rerolled turn
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPT = (START, ASSISTANT)
#: inserts that end a conversation from each state, and what they cost
TAIL = ("", "II", "I", "")
GOOD_PAIRS = ("su", "ua", "au")

DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3    # CUT: a truncated turn that stays
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"
NO_WAY = -1


def least_costs(letters: str, faults: str, system_may_stay: bool) -> list[int]:
    """For every place, a lower bound of what the turns from there on cost.

    A turn that must go costs a Delete, a truncated one at least ``CUT``.  Of
    the turns that may stay, one with a role that cannot stay costs an edit
    more, and so do two neighbours that cannot follow each other; faults that
    share no turn add up, the largest sum is taken from the right.
    """
    n = len(letters)
    certain, faulty = [0] * (n + 2), [0] * (n + 2)
    ahead: list[int] = []                      # turns to the right that may stay, last first
    best = [0]                                 # best[k]: over the last k of them
    more = lambda i: DELETE - CUT if faults[i] == TRUNCATED else REROLE
    for i in range(n - 1, -1, -1):
        fault = faults[i]
        if fault in (BLANK, DUPLICATE):
            certain[i], faulty[i] = certain[i + 1] + DELETE, faulty[i + 1]
            continue
        certain[i] = certain[i + 1] + (CUT if fault == TRUNCATED else 0)
        stays = letters[i] in ("sua" if system_may_stay else "ua")
        top = best[-1] + (0 if stays else more(i))
        if ahead and letters[i] + letters[ahead[-1]] not in GOOD_PAIRS:
            top = max(top, best[-2] + min(more(i), more(ahead[-1])))
        ahead.append(i)
        best.append(top)
        faulty[i] = top
    return [a + b for a, b in zip(certain, faulty)]


def _estimates(letters: str, faults: str, exits: tuple[int, ...]) -> list[list[int]]:
    """``least_costs`` for each state.  An exit at the start takes a Delete of
    every turn, one after a system turn of all but that; no edit leads back."""
    n = len(letters)
    if exits in ((START,), (SYSTEM,)):
        all_go = [DELETE * (n - i) for i in range(n + 1)]
        one_stays = [max(0, c - DELETE) for c in all_go]
        never = [DELETE * (n + 1) * 2] * (n + 1)
        return [all_go, never, never, never] if exits == (START,) else [one_stays, all_go, never, never]
    later = least_costs(letters, faults, False)
    return [least_costs(letters, faults, True), later, later, later]


@functools.lru_cache(maxsize=100_000)
def cheapest(letters: str, faults: str, entry: int, exits: tuple[int, ...],
             to_the_end: bool) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that lead from state ``entry`` over
    all turns to one of ``exits``, the first in ASCII order of equal ones;
    None where there is no way.  Inserts after the last turn are allowed
    ``to_the_end`` only: they belong to the next segment otherwise."""
    n = len(letters)
    if not to_the_end:
        reached = {USER, ASSISTANT} if n else set()
        if entry in (START, SYSTEM):
            reached.add(entry)
        if entry == START and any(c == "s" and f in (SOUND, TRUNCATED) for c, f in zip(letters, faults)):
            reached.add(SYSTEM)
        if not reached & set(exits):
            return None
    at_least = _estimates(letters, faults, exits)
    bound = at_least[entry][0]
    while True:
        failed: dict[tuple[int, int], int] = {}
        over = None

        def visit(i: int, state: int, spent: int) -> str | None:
            nonlocal over
            estimate = spent + at_least[state][i]
            if estimate > bound:
                over = estimate if over is None else min(over, estimate)
                return None
            if failed.get((i, state), NO_WAY) >= bound - spent:
                return None
            if i == n and state in exits:
                return ""
            if i < n:
                rest = visit(i + 1, state, spent + DELETE)
                if rest is not None:
                    return "D" + rest
            if i < n or to_the_end:
                rest = visit(i, GIVEN[state], spent + INSERT)
                if rest is not None:
                    return "I" + rest
            if i < n and faults[i] in (SOUND, TRUNCATED):
                stays = spent + (CUT if faults[i] == TRUNCATED else 0)
                if letters[i] in KEPT[state]:
                    rest = visit(i + 1, KEPT[state][letters[i]], stays)
                    if rest is not None:
                        return "K" + rest
                rest = visit(i + 1, GIVEN[state], stays + REROLE)
                if rest is not None:
                    return "R" + rest
            failed[i, state] = bound - spent
            return None

        audit = visit(0, entry, 0)
        if audit is not None:
            return bound, audit
        bound = over


def apply_audit(audit: str, entry: int, letters: str, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired turns (role, text)."""
    out, state, i = [], entry, 0
    for edit in audit:
        if edit == "K":
            out.append(turns[i])
            state = KEPT[state][letters[i]]
        elif edit in "IR":
            state = GIVEN[state]
            out.append((ROLE[state], "" if edit == "I" else turns[i][1]))
        i += edit != "I"
    return out


def classified(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault): nulls of role and text are one
    space; the first fault of a row counts: blank (b), a role and text of the
    conversation met earlier (d), truncated (t), else ``-``.

    Rows that repeat within one turn are told apart later, where equal rows
    meet in order; here a row is a repeat where an earlier turn has it.
    """
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    # nulls first: (has a turn, turn) in ascending order
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    firsts = (rows.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .where(F.col("first") < F.col("last")))
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                    & (F.col("digest") == F.col("d")), "left")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    return met.select(
        "conv_id", "turn", "role", "text",
        F.when(trimmed == "", BLANK).when(F.col("first") < place, DUPLICATE)
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND).alias("fault"))


SEGMENT_FIELDS = ("conv_id bigint, part int, seg bigint, whole boolean, turns array<bigint>, letters string, "
                  "faults string, costs array<int>, audits array<string>, roles array<string>, texts array<string>")
SEGMENT_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int64()), ("whole", pa.bool_()),
    ("turns", pa.list_(pa.int64())), ("letters", pa.string()), ("faults", pa.string()),
    ("costs", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def _ways(letters: str, faults: str, starts: bool) -> tuple[list[int], list[str]]:
    """Costs and audits from every state to every state (row by row)."""
    costs, audits = [], []
    for entry in STATES:
        for leave in STATES:
            way = None if starts and entry != START else cheapest(letters, faults, entry, (leave,), False)
            costs.append(way[0] if way else NO_WAY)
            audits.append(way[1] if way else "")
    return costs, audits


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order -> segments with the costs of their ways."""
    part, seg = TaskContext.get().partitionId(), 0
    done: list[tuple] = []
    turns: list[tuple] = []
    chars, run, first_run, first_seg, last = 0, None, True, True, None

    def segment(ends: bool) -> None:
        """Close the segment; ``ends``: its conversation has no more turns."""
        nonlocal seg, turns, chars, first_seg
        letters = "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for _, r, _, _ in turns)
        faults = "".join(f for *_, f in turns)
        whole = ends and first_seg and not first_run
        if whole:
            cost, audit = cheapest(letters, faults, START, ACCEPT, True)
            costs, audits = [cost], [audit]
        else:
            costs, audits = _ways(letters, faults, first_seg and not first_run)
        done.append((run[0], part, seg, whole, [t for t, *_ in turns], letters, faults, costs, audits,
                     [r for _, r, _, _ in turns], [t for _, _, t, _ in turns]))
        seg, turns, chars, first_seg = seg + 1, [], 0, False

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), SEGMENT_SCHEMA)],
                                         schema=SEGMENT_SCHEMA)
        done.clear()
        return out

    held = 0
    for batch in batches:
        for conv_id, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if run is None or run[0] != conv_id:
                if run is not None:
                    segment(ends=True)
                    first_run = False
                run, first_seg, last = (conv_id,), True, None
            elif len(turns) >= SEGMENT or chars >= SEGMENT_CHARS:
                segment(ends=False)
            if fault in (SOUND, TRUNCATED) and last == (turn, role, text):
                fault = DUPLICATE
            last = (turn, role, text)
            turns.append((turn, role, text, fault))
            chars += len(text)
            held += len(text)
            if held >= 8 * SEGMENT_CHARS and done:
                yield flush()
                held = 0
        if len(done) >= 5_000:
            yield flush()
    if run is not None:
        segment(ends=False)                    # the next task may have more of it
    if done:
        yield flush()


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments, last first -> what is still to be paid after each, by state."""
    run, togo = None, None
    for batch in batches:
        parts, segs, out = [], [], []
        for conv_id, part, seg, costs in zip(*(c.to_pylist() for c in batch.columns)):
            if run is None or run[0] != conv_id:
                run, togo = (conv_id,), [INSERT * len(t) for t in TAIL]
            parts.append(part), segs.append(seg), out.append(togo)
            ways = [[costs[4 * e + x] + togo[x] for x in STATES
                     if costs[4 * e + x] != NO_WAY and togo[x] != NO_WAY] for e in STATES]
            togo = [min(w) if w else NO_WAY for w in ways]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(segs, pa.int64()),
                                          pa.array(out, pa.list_(pa.int32()))], names=["p", "s", "togo"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order -> the state each is entered in and its edits."""
    run, state, waiting = None, START, None
    done: list[tuple] = []

    def close(last: bool) -> None:
        """The waiting segment is complete; the last one of a conversation
        has the inserts at its end, too."""
        part, seg, entry, cost, audit, leave = waiting
        done.append((part, seg, entry, cost + last * INSERT * len(TAIL[leave]), audit + last * TAIL[leave]))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*done)) or [[]] * 5
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()))],
            names=["p", "s", "entry", "cost", "audit"])

    for batch in batches:
        for conv_id, part, seg, costs, audits, togo in zip(*(c.to_pylist() for c in batch.columns)):
            fresh = run is None or run[0] != conv_id
            if waiting:
                close(last=fresh)
            if fresh:
                run, state = (conv_id,), START
            ways = [(costs[4 * state + x] + togo[x], audits[4 * state + x], x) for x in STATES
                    if costs[4 * state + x] != NO_WAY and togo[x] != NO_WAY]
            _, audit, leave = min(ways)
            waiting = (part, seg, state, costs[4 * state + leave], audit, leave)
            state = leave
        yield flush()
    if waiting:
        close(last=True)
        yield flush()


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, part, seg, turns, letters, faults, entry, cost, audit, roles, texts = batch.columns
        mended = [apply_audit(a, e, ls, list(zip(rs, ts))) for a, e, ls, rs, ts in zip(
            audit.to_pylist(), entry.to_pylist(), letters.to_pylist(), roles.to_pylist(), texts.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [conv, part, seg, turns, letters, faults, cost, audit,
             pa.array([[r for r, _ in m] for m in mended], pa.list_(pa.string())),
             pa.array([[t for _, t in m] for m in mended], pa.list_(pa.string()))],
            names=["conv_id", "part", "seg", "turns", "letters", "faults", "cost", "audit", "roles", "texts"])


def repaired_segments(rows: DataFrame) -> DataFrame:
    """Repaired conversations of ``rows`` (conv_id, turn, role, text), in
    segments: conv_id, part and seg (their order), the turns, letters (role
    initials) and faults of the given rows, the cost and audit of the edits,
    roles and texts of the repaired turns.

    Rows are taken by turn (nulls first), then role, then text.  A null role or
    text is one space, a null conv_id a conversation of its own.  Roles that do
    not start with s, u or a cannot stay.  Repeated rows are duplicates of the
    first; an empty table gives no segments; other columns are ignored.
    """
    order = ["conv_id", "turn", "role", "text"]
    # bounds of the ranges come to the driver, so long strings take part by their beginning
    key: list[Column] = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 32), F.substring("text", 1, 32)]
    dealt = classified(rows).repartitionByRange(*key).sortWithinPartitions(*order)
    segments = cut_lineage(dealt.select(*order, "fault").mapInArrow(_search, SEGMENT_FIELDS))
    cut = segments.where(~F.col("whole"))
    togo = (cut.select("conv_id", "part", "seg", "costs").repartition("conv_id")
            .sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
            .mapInArrow(_backward, "p int, s bigint, togo array<int>"))
    chosen = (cut.join(togo, (F.col("part") == F.col("p")) & (F.col("seg") == F.col("s")))
              .select("conv_id", "part", "seg", "costs", "audits", "togo").repartition("conv_id")
              .sortWithinPartitions("conv_id", "part", "seg")
              .mapInArrow(_forward, "p int, s bigint, entry int, cost int, audit string"))
    full = segments.join(chosen, (F.col("part") == F.col("p")) & (F.col("seg") == F.col("s")), "left")
    full = full.select(
        "conv_id", "part", "seg", "turns", "letters", "faults",
        F.coalesce("entry", F.lit(START)).alias("entry"),
        F.coalesce("cost", F.element_at("costs", 1)).alias("cost"),
        F.coalesce("audit", F.element_at("audits", 1)).alias("audit"), "roles", "texts")
    return full.mapInArrow(_apply, "conv_id bigint, part int, seg bigint, turns array<bigint>, letters string, "
                                   "faults string, cost int, audit string, roles array<string>, texts array<string>")


REPORT_FIELDS = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                 "cost bigint, audit string, repaired_sha256 string")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order -> one row per conversation, one segment in memory."""
    names = [f.split()[0] for f in REPORT_FIELDS.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    done: list[tuple] = []
    run = None

    def close() -> None:
        gaps = run["turn"] - run["least"] + 1 - run["distinct"] if run["distinct"] else 0
        done.append((run["conv_id"], gaps, run[BLANK], run[DUPLICATE], run[TRUNCATED], run["illegal"],
                     run["cost"], "".join(run["audit"]), run["sha"].hexdigest()))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        done.clear()
        return out

    for batch in batches:
        for conv_id, turns, letters, faults, cost, audit, roles, texts in zip(
                *(c.to_pylist() for c in batch.columns)):
            if run is None or run["conv_id"] != conv_id:
                if run is not None:
                    close()
                run = {"conv_id": conv_id, "turn": None, "least": None, "distinct": 0, BLANK: 0, DUPLICATE: 0,
                       TRUNCATED: 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(),
                       "letter": "", "any": False}
            for turn in turns:                  # in order, nulls first
                if turn is not None and turn != run["turn"]:
                    run["least"] = turn if run["least"] is None else run["least"]
                    run["distinct"] += 1
                    run["turn"] = turn
            met = run["letter"] + letters
            run["illegal"] += sum(a + b not in GOOD_PAIRS for a, b in zip(met, met[1:]))
            run["letter"] = met[-1:]
            for fault in (BLANK, DUPLICATE, TRUNCATED):
                run[fault] += faults.count(fault)
            run["cost"] += cost
            run["audit"].append(audit)
            for role, text in zip(roles, texts):
                run["sha"].update(f"{chr(10) if run['any'] else ''}{role}:{text}".encode())
                run["any"] = True
        if len(done) >= 20_000:
            yield flush()
    if run is not None:
        close()
    if done:
        yield flush()


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``: what ``rows`` (what is
    left of them) need and how they read when repaired.

    gaps: turn numbers missing between the least and the greatest (nulls
    ignored); blank, duplicate, truncated: rows by their first fault; illegal:
    neighbours whose role initials are not su, ua or au; cost and audit of the
    cheapest edits; repaired_sha256 of ``role:text`` lines.  A conversation
    without rows has zeros, an empty audit and the hash of an empty string.

    The hash of a conversation is sequential: its segments pass through one
    task in order, one at a time, and nothing is gathered.
    """
    report = (repaired_segments(rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
              .select("conv_id", "turns", "letters", "faults", "cost", "audit", "roles", "texts")
              .mapInArrow(_report, REPORT_FIELDS))
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    key = fresh_name(report, "id")
    out = every.withColumnRenamed("conv_id", key).join(report, F.col(key).eqNullSafe(F.col("conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.col(key).alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
