"""The registered queries over whole tables against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import language_model, packing, pii, queries, simhash, tokens

DATA = "/root/testdata/sf0.001"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_op1(spark, texts):
    prints = {}
    for i, t in texts.items():
        words = _WORD.findall(t.translate(_LOWER))
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    sets = Sets(prints)
    ids = sorted(prints)
    for x in range(len(ids)):
        for y in range(x):
            if (prints[ids[x]] ^ prints[ids[y]]).bit_count() <= 3:
                sets.join(ids[x], ids[y])
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, DATA).collect()}
    assert got == {(i, f"{p:016x}", sets.find(i)) for i, p in prints.items()}


def _base(text):
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15],
    }
    return found, sorted((a, list(found).index(k), b) for k, own in found.items() for a, b in own)


def test_op2(spark, texts):
    kinds = ["email", "ip", "card", "phone"]
    rows = queries.op2_pii(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found, order = _base(texts[r["doc_id"]])
        listed = [f"{kinds[k]}:{a}:{b}" for a, k, b in order]
        assert [r[f"n_{k}"] for k in kinds] == [len(found[k]) for k in kinds]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert set(listed) <= set(spans)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_redaction_is_what_is_found(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    for r in pii.redact(docs).collect():
        t, out, last = texts[r["doc_id"]], [], 0
        for s in spans[r["doc_id"]]:
            if s["start"] >= last:
                out.append(f"{t[last : s['start']]}[{s['kind'].upper()}]")
            last = max(last, s["end"])
        assert r["text"] == "".join([*out, t[last:]])


def _model(words, train):
    """Unigram and bigram counts of the training texts, as the model quantises them."""
    uni, bi = Counter(), defaultdict(Counter)
    for i in train:
        for before, w in zip(["\n", *words[i]], words[i]):
            uni[w] += 1
            bi[before][w] += 1
    middle = lambda c: 1.5 * 2 ** (c.bit_length() - 1) - 0.5 if c else 0.0
    mass, v = sum(map(middle, uni.values())), len(uni)
    single = lambda w: (middle(uni[w]) + 1) / (mass + v + 1)

    def chance(h, w):
        s, t = sum(map(middle, bi[h].values())), len(bi[h])
        return (middle(bi[h][w]) + t * single(w)) / (s + t) if s else single(w)

    return uni, chance


def test_op3(spark, texts):
    words = {i: [*_WORD.findall(t.translate(_LOWER)), "\n"] for i, t in texts.items()}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    uni, chance = _model(words, train)
    n, v = sum(uni.values()), len(uni)
    rows = queries.op3_lm(spark, DATA).collect()
    assert len(rows) == len(texts)
    off = []
    for r in rows:
        own = words[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(uni[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        want = sum(math.log10(chance(h, w)) for h, w in zip(["\n", *own], own))
        off.append(abs(r["score"] / want - 1))
    assert np.median(off) < 1e-3 and max(off) < 0.05  # the filter's false positives are all that differs
    vocabulary = [*uni, "never seen"]
    for h in [*list(uni)[:20], "\n", "never seen"]:
        assert sum(chance(h, w) for w in vocabulary) == pytest.approx(1)


def test_chances_sum_to_one():
    rng = np.random.default_rng(0)
    c1 = rng.integers(1, 500, 60)
    c2 = rng.integers(0, 9, 60) * (rng.random(60) < 0.4)
    twice = language_model.twice_count
    l1, l2 = language_model.level_of(np.append(c1, 0)), language_model.level_of(np.append(c2, 0))
    mass = int(twice(l1).sum())
    for pair in (l2, np.zeros(61, dtype=np.int64)):
        s, t = np.full(61, twice(pair).sum()), np.full(61, (pair > 0).sum())
        assert language_model.chances(twice(l1), twice(pair), s, t, mass, 60).sum() == pytest.approx(1)


def test_hot_words_are_dealt_over_segments(spark):
    rng = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, " ".join(x for w in rng.integers(0, 400, 150) for x in ("hot", f"w{w}"))) for i in range(60)], "doc_id bigint, text string")
    whole = {r["doc_id"]: (r["base_score"], r["score"]) for r in language_model.score_texts(docs).collect()}
    small = {r["doc_id"]: (r["base_score"], r["score"]) for r in language_model.score_texts(docs, limit=128).collect()}
    assert [x for x, _ in whole.values()] == [small[i][0] for i in whole]
    assert np.mean([abs(small[i][1] / whole[i][1] - 1) for i in whole]) < 0.02


def test_language_model_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, "A b", "x"), (None, "a B", "x"), (3, None, None), (3, "", "y"), (4, "a b", "z"), (4, "a b", "z"), (5, " \t a  b\x0b\n", "z"), (6, "w " * 300_000, "z"), (7, "日本 a b", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string").withColumn("block", F.lit(1)).withColumn("score", F.lit("x"))
    got = language_model.score_texts(docs).collect()
    assert len(got) == len(rows) and sum(r["n_tokens"] for r in got if r["doc_id"] == 6) == 300_001
    same = {round(r["base_score"], 9) for r in got if r["doc_id"] in (1, 4, 5) or r["doc_id"] is None}
    assert len(same) == 1
    assert {r["n_tokens"] for r in got if r["doc_id"] == 3} == {1}


def test_op4_and_op8(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.tokenizer_path())
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in queries.op4_bpe(spark, DATA).collect():
        own = ids[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(own, skip_special_tokens=False).encode()).hexdigest()
    rows, bins, total = queries.op8_packing(spark, DATA).collect(), defaultdict(list), 0
    seen = defaultdict(list)
    for r in rows:
        own = np.array([*ids[r["doc_id"]], 2], dtype="<u4")[r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    for i, own in seen.items():
        assert sorted(own) == [(k, s, n) for k, (s, n) in enumerate(packing.cut(len(ids[i]) + 1, 1024))]
    assert total == sum(len(x) + 1 for x in ids.values()) and set(seen) == set(ids)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.01 * -(-total // 1024) + 1


def test_near_dedup_on_a_table(spark, texts):
    from tessera.llm import exact_dedup

    docs = exact_dedup.exact_dedup(spark.read.parquet(f"{DATA}/documents.parquet"))
    sets = {r["doc_id"]: frozenset(simhash.shingles((r["text"] or "").encode(), 5)) for r in docs.collect()}
    groups = Sets(sets)
    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                groups.join(x, y)
    got = {r["doc_id"] for r in simhash.near_dedup(docs).select("doc_id").collect()}
    assert got == {i for i in sets if groups.find(i) == i}


def test_op10_and_the_first_stage(spark, texts):
    """A really trained network: scores rank held-out toxic texts high, and the pipeline's stage drops what is scored high."""
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([b > g for b in bad for g in good]) > 0.93
    caught, wrong = sum(b >= 0.3 for b in bad), sum(g >= 0.3 for g in good)
    assert caught / len(bad) > 0.8 and caught / (caught + wrong) > 0.8
    kept = {r["doc_id"] for r in cp.STAGES[0][1](spark, spark.read.parquet(f"{d}/documents.parquet"), d).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in rows if r["score"] < 0.3}
