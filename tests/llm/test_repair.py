"""Conversation repair against a plain search for the cheapest and least edits."""

import hashlib
import heapq
import random
import zlib

import pytest

from tessera.llm import queries, repair

DATA = "/root/testdata/sf0.01"
SPACES = " \t\n\x0b\x0c\r"
READS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    """The rows of each conversation after damage, in order."""
    out, space = {}, lambda v: " " if v is None else str(v)
    for c, t, r, x in rows:
        d, own = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20, out.setdefault(c, [])
        r, x = "user" if d == 4 else space(r), "" if d == 1 else space(x)
        if d == 2:
            x = "".join(k for k in x if k not in ".!?")
        own += [(t, r, x)] * (0 if d == 0 else 2 if d == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def plain(rows):
    seen, faults = set(), []
    for _, r, x in rows:
        bare = x.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, p, out = heapq.heappop(heap)
        if i == len(rows) and p in (0, 3):
            return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        if (i, p) in done:
            continue
        done.add((i, p))
        for a, q in READS[p].items():
            if a in NAMES:
                heapq.heappush(heap, (cost + 3, audit + "I", i, q, (*out, f"{NAMES[a]}:")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, p, out))
            if faults[i] in ("", "truncated"):
                (_, r, x), more = rows[i], 3 * (faults[i] == "truncated")
                if r[:1] in READS[p]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, READS[p][r[:1]], (*out, f"{r}:{x}")))
                for a, q in READS[p].items():
                    if a in NAMES:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, q, (*out, f"{NAMES[a]}:{x}")))


def test_query_equals_the_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {(c, *plain(v)) for c, v in damage(rows).items()}
    got = [tuple(r) for r in queries.op12_repair(spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.fixture(scope="module")
def drawn():
    rng, rows = random.Random(12), []
    for c in [*range(250), None]:
        for k in range(300 if c in (7, 8) else rng.choice([1, 2, 3, 5, 9, 40])):
            role = rng.choice(["user", "assistant", "system", "tool", "u", "", None, "user", "assistant"])
            rows.append((c, rng.choice([k, k, k, k, None, 3]), role, rng.choice(["a.", "b!", "c", "", " \t", "hello there.\n", "x?  ", None, f"u{k}.", f"v{k}."])))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", "ok." if rng.random() < 0.3 else f"text {t}.") for t in range(1000)]
    return rows + [(501, 1, "user", "same.")] * 700


@pytest.mark.parametrize("most", [10**6, 30])
def test_whole_and_cut_conversations_equal_the_plain_search(spark, drawn, most, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", 7)
    df = spark.createDataFrame([(*r, "extra") for r in drawn], "conv_id bigint, turn bigint, role string, text string, times string")
    got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.damaged(df), whole_rows=most).collect()}
    assert got == {c: plain(v) for c, v in damage(drawn).items()}


def test_hard_tables(spark):
    df = spark.createDataFrame([("a", 1, "user", "x" * 3_000_000 + "."), (None, None, None, None)], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: (r["cost"], r["audit"], r["gaps"]) for r in repair.repair(repair.damaged(df)).collect()}
    assert set(got) == {"a", None}
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0


def test_few_states():
    machine, rng = repair.Determinised(), random.Random(0)
    for _ in range(300):
        machine.scan([rng.randrange(9) for _ in range(200)], machine.end)
    assert len(machine.vectors) < 100
