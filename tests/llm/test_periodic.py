"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import time
import zlib

import numpy as np

from tessera.llm import periodic, queries

DATA = "/root/testdata/sf0.001"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(x):
    """All runs, by trying each period and keeping stretches without a smaller one."""
    out, n = [], len(x)
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and x[e] == x[e + q]:
                e += 1
            length = e + q - s
            if length >= max(6, 4 * q) and not any(all(x[i] == x[i + d] for i in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _drawn(rng):
    few = lambda lo, hi, k: [rng.randint(0, k) for _ in range(rng.randint(lo, hi))]
    kind = rng.randint(0, 4)
    if kind == 0:
        return few(0, 60, rng.randint(0, 3))
    if kind == 1:
        root = few(1, 14, 2)
        return few(0, 9, 2) + (root * 8)[: rng.randint(0, len(root) * 8)] + few(0, 9, 2)
    if kind == 2:
        out = []
        for _ in range(rng.randint(1, 3)):
            root = [c for _ in range(rng.randint(1, 3)) for c in [rng.randint(0, 1)] * rng.randint(1, 7)]
            out += (root * rng.randint(1, 6))[: rng.randint(1, 100)]
        return out
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < 150:
            a, b = b, b + a
        return b[: rng.randint(0, 150)]
    root = [0, 1] * rng.randint(1, 6) + [2] * rng.randint(0, 2) + [0, 1] * rng.randint(0, 4) + few(0, 4, 2)
    return (root * 6)[: rng.randint(1, 160)]


def test_runs_equal_the_plain_search():
    rng, seen = random.Random(11), 0
    for _ in range(1500):
        x = _drawn(rng)
        got = [tuple(r) for r in periodic.runs(np.array(x, dtype=np.int32))]
        assert got == plain(x), x
        seen += len(got)
    assert seen > 1000


def test_long_texts_take_time_that_grows_with_them():
    start = time.time()
    for x in (np.zeros(200_000), np.arange(200_000) % 2, np.arange(200_000) % 50_000, np.arange(200_000)):
        found = periodic.runs(x.astype(np.int32))
        assert len(found) == (x[-1] != 199_999)
    assert time.time() - start < 20


def test_query_equals_the_plain_search(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    sha, some = lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    rows = queries.op11_periodic(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        words, h = _WORD.findall(texts[r["doc_id"]]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 2000:
            continue
        found = plain(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda f: (-f[1] / f[2], f[0], f[2]), default=None)
        assert r["n_runs"] == len(found)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in found))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        some += len(found)
    assert some > 5


def test_hard_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a a a a a a b", "z"), (None, "a a a a a a b", "z"), (2, "a\x85a b c", "q"), (3, "\t\n \x0b\x0c\r", "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], bytes(r["collapsed"])) for r in periodic.find(df).collect())
    assert got == [(0, [(0, 6, 1)], b"a b"), (0, [(0, 6, 1)], b"a b"), (1, [], b""), (1, [], b""), (2, [], "a\x85a b c".encode()), (3, [], b"")]
    assert periodic.digests(df.limit(0)).count() == 0
