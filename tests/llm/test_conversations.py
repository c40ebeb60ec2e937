import hashlib
import heapq
import random
import re
import zlib

import pytest

from trialweave.llm import conversations

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damage(rows):
    """Rows (conv, turn, role, text) after damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        role = "user" if fault == 4 else role
        kept.extend([(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1))
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def cheapest(kept, faults):
    """Cost, audit and lines of the first path in (cost, audit) order, by a search that holds audits as strings."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(kept) and state in ("", "a"):
            return cost, audit, lines
        for role in ("user", "assistant"):
            if (state, role[0]) in STEP:
                heapq.heappush(heap, (cost + 2, audit + "I", k, STEP[state, role[0]], (*lines, f"{role}:")))
        if k < len(kept):
            _, own, text = kept[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state, lines))
            if faults[k] not in ("blank", "duplicate"):
                cut = faults[k] == "truncated"
                if own and (state, own[0]) in STEP:
                    heapq.heappush(heap, (cost + cut, audit + "K", k + 1, STEP[state, own[0]], (*lines, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    if (state, role[0]) in STEP:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", k + 1, STEP[state, role[0]], (*lines, f"{role}:{text}")))


def brute(rows):
    out = {}
    for conv, kept in damage(rows).items():
        turns = {t for t, _, _ in kept if t is not None}
        seen, faults = set(), []
        for _, role, text in kept:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = cheapest(kept, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, conv string, n int, piece int")


def agrees(got, rows):
    want = brute(rows)
    found = got.collect()
    assert len(found) == len(want)
    for row in found:
        assert tuple(row)[1:] == want[row["conv_id"]], row["conv_id"]


def drawn(seed, n):
    pick = random.Random(seed)
    texts = ["Hi.", "Yes.", "ok", "", None, " \n", *[f"T{k}." for k in range(300)], *[f"T{k}" for k in range(100)]]
    roles = ["user", "assistant", "system", "assistant", "user", "tool", "", None]
    return [(pick.choice([None, 1, 1, 1, 1, 2, 3, 4, 5]), pick.choice([None, *range(400)]), pick.choice(roles), pick.choice(texts)) for _ in range(n)]


def test_query_equals_brute_force(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/conversations.parquet")
    agrees(conversations.repair(df), [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("seed", [3, 4])
def test_conversations_cut_into_pieces(spark, seed):
    """One conversation has most rows and lies in several pieces; turns tie, rows repeat, any value may be null."""
    rows = drawn(seed, 1500) + [(9, k, "user" if k % 2 else "assistant", f"{k}.") for k in range(40)] + [(10, None, None, None)] * 50 + [(11, 1, "user", "long. " * 100_000)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        agrees(conversations.repair(table(spark, rows)), rows)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_dropped_rows_leave_an_empty_conversation(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.repair(table(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert conversations.repair(table(spark, [])).count() == 0


def test_matrix_of_many_rows_equals_one_block():
    pick = random.Random(1)
    kinds = bytes(pick.choice(list(conversations.EDGES)) for _ in range(500))
    assert conversations.matrix(kinds) == conversations._block(kinds)
