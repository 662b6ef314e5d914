"""Structure repair against Dijkstra's search and a plain model of the job."""

import hashlib
import heapq
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from coweave.llm import queries, repair

FIELDS = "conv_id bigint, turn bigint, role string, text string, audit int, letters string"


def best_way(letters, faults, entry=repair.START, exits=repair.ACCEPT, to_the_end=True):
    """Cheapest (cost, audit), first in ASCII order, by uniform-cost search."""
    heap, seen = [(0, "", 0, entry)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(letters) and state in exits:
            return cost, audit
        if i < len(letters) or to_the_end:
            heapq.heappush(heap, (cost + 3, audit + "I", i, repair.GIVEN[state]))
        if i < len(letters):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if faults[i] in "-t":
                stays = cost + 3 * (faults[i] == "t")
                if letters[i] in repair.KEPT[state]:
                    heapq.heappush(heap, (stays, audit + "K", i + 1, repair.KEPT[state][letters[i]]))
                heapq.heappush(heap, (stays + 3, audit + "R", i + 1, repair.GIVEN[state]))
    return None


turns = st.lists(st.tuples(st.sampled_from("suuaa?"), st.sampled_from("---tbd")), max_size=10)


@settings(max_examples=600, deadline=None)
@given(turns)
def test_the_search_finds_the_cheapest_and_least_audit(rows):
    letters, faults = ("".join(x) for x in zip(*rows)) if rows else ("", "")
    assert repair.cheapest(letters, faults, repair.START, repair.ACCEPT, True) == best_way(letters, faults)


@settings(max_examples=200, deadline=None)
@given(turns.filter(len), st.sampled_from(repair.STATES), st.sampled_from(repair.STATES))
def test_ways_through_a_segment(rows, entry, leave):
    letters, faults = ("".join(x) for x in zip(*rows))
    assert repair.cheapest(letters, faults, entry, (leave,), False) == best_way(letters, faults, entry, (leave,), False)


@settings(max_examples=300, deadline=None)
@given(turns)
def test_the_estimate_is_never_too_high(rows):
    letters, faults = ("".join(x) for x in zip(*rows)) if rows else ("", "")
    for entry in repair.STATES:
        cost, _ = best_way(letters, faults, entry)
        assert repair.least_costs(letters, faults, entry == repair.START)[0] <= cost


def model(rows):
    """The report of every conversation, by the contract's words."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), ""
        for _, role, text in left:
            bare = text.strip(" \t\n\x0b\f\r")
            faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in left]
        letters = "".join(i if i in ("s", "u", "a") else "?" for i in initials)
        cost, audit = best_way(letters, faults)
        mended = repair.apply_audit(audit, repair.START, letters, [(r, t) for _, r, t in left])
        numbers = [t for t, _, _ in left if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mended).encode()).hexdigest())
    return out


def report(spark, rows, partitions=4):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], FIELDS).repartition(partitions)
    got = repair.repair_report(queries.damaged(df), df).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_damaged_conversations_equal_the_model(spark):
    rnd = random.Random(5)
    texts = ["Yes.", "No!", "why", "  \t", "", None, "a.b.c", "Yes.", "long " * 20_000 + ".", "é?\n "]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "user", "assistant"]
    rows = [(c, rnd.choice([None, t, t, t, t + 2]), rnd.choice(roles), rnd.choice(texts))
            for c in range(150) for t in range(rnd.randint(1, 9))]
    rows += [(None, t, "user", "no conversation") for t in range(3)] + rows[:30]
    rows += [(-5, 0, "user", "x")] * 3
    assert report(spark, rows) == model(rows)


def test_a_conversation_of_many_segments(spark):
    rnd = random.Random(8)
    rows = [(1, t, rnd.choice(["user", "user", "assistant", "assistant", "system", "tool"]),
             rnd.choice([f"text {t}.", f"text {t}", "same.", ""])) for t in range(700)]
    rows += [(c, t, rnd.choice(["user", "assistant"]), f"t{t}.") for c in (0, 2, 3) for t in range(6)]
    assert report(spark, rows, 7) == model(rows)


def test_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert report(spark, [(gone, 0, "user", "x")]) == {
        gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = spark.createDataFrame([], FIELDS)
    assert repair.repair_report(queries.damaged(empty), empty).count() == 0
    assert repair.repaired_segments(empty).count() == 0


def test_repaired_turns_read_as_they_should(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c.")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], FIELDS)
    got = repair.repaired_segments(df).collect()
    assert [(r["audit"], list(zip(r["roles"], r["texts"]))) for r in got] == [
        ("KIKK", [("user", "a."), ("assistant", ""), ("user", "b."), ("assistant", "c.")])]
