"""Conversation repair against a plain search over whole conversations."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from sparkwave.llm.repair import Lattice, repair, repaired_report, repaired_turns, transfer

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def search(rows, faults):
    """(cost, audit, repaired) of the cheapest edits, the least audit of these: a best-first search over whole edit strings."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, done = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, done
        to = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", i, to[0], (*done, f"{to}:")))
        if i == len(rows):
            continue
        role, text = rows[i][2:]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, done))
        if faults[i] in ("", "truncated"):
            more = 3 if faults[i] else 0
            heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to[0], (*done, f"{to}:{text}")))
            if role[:1] and last + role[:1] in ("s", "u", "su", "ua", "au"):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*done, f"{role}:{text}")))


def brute(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in damage(rows):
        convs[r[0]].append(r)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in turns:
            tail = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "" if tail[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit, done = search(turns, faults)
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def made(rng, convs, most):
    words = ["Yes.", "No?", "go on", "", " \n", "So!", "Right. ", "x"]
    roles = ["user", "assistant"] * 4 + ["system", None, "", "unknown", "tool"]
    for c in convs:
        n = rng.randint(1, most)
        for t in range(n):
            if rng.random() < 0.9:
                yield (c, t, roles[t % 2] if rng.random() < 0.6 else rng.choice(roles), rng.choice([*words, None, f"line {t}."]))


def found(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize(("chunk", "partitions"), [(1024, 8), (3, 5), (1, 2)])
def test_against_search(spark, chunk, partitions):
    rng = random.Random(8)
    rows = list(made(rng, range(60), 7)) + list(made(rng, [None, 2**60 + 1, 2**60], 40))
    rows += [(90, None, "user", "a."), (90, None, "user", "a."), (90, 4, "assistant", "b."), (91, 2**62, "user", "x."), (91, -(2**62), "user", "x.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as at", "'x' as chunk", "2 as fault", "3 as place").repartition(3)
    assert found(repaired_report(df, chunk, partitions)) == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert found(repaired_report(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_lost_conversations_and_empty(spark):
    assert repaired_report(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = found(repaired_report(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_edits_give_the_dialogue(spark):
    rows = list(made(random.Random(2), range(20), 9))
    _, turns, parts = repair(spark.createDataFrame(rows, SCHEMA), 4, 3)
    lines = {}
    for r in sorted(repaired_turns(turns, parts).collect(), key=lambda r: (r["conv_id"], r["step"])):
        lines.setdefault(r["conv_id"], []).append(r)
    for conv, want in brute(rows).items():
        mine = lines.get(str(conv), [])
        assert "".join(r["edit"] for r in mine) == want[6]
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine if r["edit"] != "D").encode()).hexdigest() == want[7]


def test_one_hot_conversation(spark):
    rows = [(1, t // 2, "user", "Same.") for t in range(3000)] + [(2, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(repaired_report(df, 256, 6)) == brute(rows)


def test_prices_are_exact_for_every_node():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(0, 9)
        initials, faults = [rng.choice("sua x") for _ in range(n)], [rng.randrange(4) for _ in range(n)]
        lattice = Lattice(initials, faults)
        for node, price in enumerate(lattice.price):
            arcs = lattice.arcs(node)
            assert all(price <= cost + lattice.price[end] for _, cost, end in arcs)
            assert not arcs or any(price == cost + lattice.price[end] for _, cost, end in arcs)
        if n:
            k = rng.randint(0, n)
            first, second, whole = (transfer(initials[a:b], faults[a:b]) for a, b in ((0, k), (k, n), (0, n)))
            joined = [min(first[4 * a + m] + second[4 * m + b] for m in range(4)) for a in range(4) for b in range(4)]
            # A whole table may insert at the cut, which a part leaves to the one behind it: both count such costs once.
            assert [min(v, 1 << 60) for v in joined] == [min(v, 1 << 60) for v in whole]
