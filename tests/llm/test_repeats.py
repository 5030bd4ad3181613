"""Removal of repeated strings against a count of all strings."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, repeats

DATA = "/root/testdata/sf0.001"


def plain(rows, length=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                covered[s : s + length] = b"\1" * length
        n = sum(c and not p for p, c in zip(b"\0" + covered, covered))
        out.append((i, len(b), sum(covered), n, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()))
    return sorted(out, key=repr)


def test_query_equals_the_plain_count(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_repeats(spark, DATA).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = plain(rows)
    assert sorted(map(tuple, got), key=repr) == want and sum(r[2] for r in want) > 10_000


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(5)
    stock = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    passages, rows = [say(rng.randint(60, 200)) for _ in range(6)], []
    for i in range(120):
        text = say(rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            text += f" {p[a : a + rng.randint(300, 1500)]} {say(rng.randint(0, 50))}"
        rows.append((i, text))
    return rows + [(None, None), (3, ""), (9, rows[9][1]), (9, rows[9][1]), (10, "a" * 3000), (11, "a" * 399), (12, "ab" * 700), (13, "ba" * 300 + "x" + "ab" * 300)]


@pytest.mark.parametrize(("stretch", "most"), [(1 << 18, 16_384), (500, 16_384), (1 << 18, 6)])
def test_hard_texts_equal_the_plain_count(spark, drawn, stretch, most, monkeypatch):
    """Null, empty, short, periodic and repeated texts; stretches of few bytes; buckets that must be halved again and again."""
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    df = spark.createDataFrame([(*r, "extra") for r in drawn], "doc_id bigint, text string, key string")
    found = repeats.remove(df, bucket_reads=most).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, found.collect()), key=repr) == plain(drawn)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.remove(df).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"] and repeats.remove(df).count() == 0


def test_columns_of_a_bucket():
    rng = random.Random(1)
    core = bytes(rng.randrange(97, 100) for _ in range(64))
    reads = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) + b"#" + core[:8] + bytes(rng.choice(b"ab") for _ in range(rng.randint(6, 14))) for _ in range(300)})
    ahead = np.array([t.index(b"#") for t in reads])
    got = repeats.repeated_windows(reads, ahead, np.zeros(len(reads), dtype=np.int64), np.ones(len(reads), dtype=np.int64), 14)
    seen = Counter((s - int(a), t[s : s + 14]) for t, a in zip(reads, ahead, strict=True) for s in range(len(t) - 13))
    for t, a, own in zip(reads, ahead, got, strict=True):
        covered = {k for s in range(int(a) + 1) if s + 14 <= len(t) and seen[s - int(a), t[s : s + 14]] > 1 for k in range(s, s + 14)}
        assert {k for s, e in own for k in range(s, e)} == covered


def test_long_texts_take_time_that_grows_with_them():
    start, rng = time.time(), np.random.default_rng(0)
    text = rng.integers(97, 123, 20_000_000, dtype=np.uint8).tobytes()
    reads = [len(repeats.anchored([text[o : o + repeats.STRETCH]])[0]) for o in range(0, len(text), repeats.STRETCH)]
    assert time.time() - start < 30 and 100_000 < sum(reads) < 140_000
