import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, exact_dedup, html_extract, language_model, neighbours, packing, pii, queries, simhash, tokens, toxicity, url_filter

ODD = [(1, "Hello World foo bar", "x"), (2, None, None), (3, "", "x"), (4, "hello world foo bar", None), (4, "hello world foo bar", None), (5, "日本 🙂 é\x85 <|endoftext|>  a\n\nb", "y"), (6, "word " * 5000, "z")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated rows, and columns with clashing names."""
    return spark.createDataFrame(ODD, "doc_id bigint, text string, score string").withColumn("fp", F.lit(1)).withColumn("block", F.lit(2))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_exact_dedup(odd, none):
    rows = [tuple(r) for r in exact_dedup.exact_classes(odd).collect()]
    norm = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    want = []
    for i, t, _ in ODD:
        same = [j for j, u, _ in ODD if norm(u) == norm(t)]
        want.append((i, max(same), len(same), i == max(same), hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(rows) == sorted(want)
    assert exact_dedup.exact_classes(none).count() == 0
    assert exact_dedup.exact_dedup(odd).columns == odd.columns


def test_simhash_against_brute_force(spark, none):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = np.concatenate([base] + [base ^ (np.int64(1) << rng.integers(0, 60, 40)) for _ in range(4)])
    rows = spark.createDataFrame([(int(x), int(x)) for x in np.unique(fps)], "cid bigint, f0 bigint")
    for bucket in (simhash.BUCKET_ROWS, 3):  # the small one splits buckets and compares chunks
        links = common.components(simhash.near_edges(rows, 3, bucket_rows=bucket), "t")
        root = {r["node"]: r["root"] for r in links.collect()}
        u = np.unique(fps)
        for a in u:
            for b in u[np.bitwise_count((u ^ a).view(np.uint64)) <= 3]:
                assert root.get(int(a), int(a)) == root.get(int(b), int(b))
    assert simhash.near_groups(none).count() == 0


def test_simhash_groups(odd):
    got = {r["doc_id"]: r for r in simhash.near_groups(odd, 3, 3, words=1).collect()}
    assert got[1]["component_id"] == got[4]["component_id"] == 1
    assert got[2]["fingerprint"] == got[3]["fingerprint"] == "0" * 16
    kept = {r["doc_id"] for r in simhash.near_dedup(odd).collect()}
    assert kept == {1, 2, 5, 6}


def test_components_of_a_path(spark):
    ids = np.random.default_rng(1).permutation(200)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, ids[1:])] + [(1000, 1001), (7, 7)], "a bigint, b bigint")
    root = {r["node"]: r["root"] for r in common.components(edges, "t").collect()}
    assert len({root[int(i)] for i in ids}) == 1 and root[1000] == root[1001] != root[int(ids[0])]


def test_bpe_is_the_library(odd, none):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    t = Tokenizer.from_file(path)
    back = bpe.decode(bpe.encode(odd, path), path).collect()
    texts = {i: x or "" for i, x, _ in ODD}
    for r in back:
        assert r["ids"] == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["text"] == t.decode(r["ids"], skip_special_tokens=False) == texts[r["doc_id"]]
    assert bpe.decode(bpe.encode(none, path), path).count() == 0
    b = bpe.load(path)[0]
    words = ["a" * n for n in range(1, 90)] + ["naïveté", "don't", " the", "zqxj" * 9]
    assert [np.frombuffer(x, "<u4").tolist() for x in b.merge_many([w.encode() for w in words])] == [b.merge(w.encode()) for w in words]


def test_packing(odd, none):
    path = tokens.tokenizer_path()
    rows = packing.pack(packing.pieces(odd, path)).collect()
    bins = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.pack(packing.pieces(none, path)).count() == 0


def test_packing_of_many_shards(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 900, 600))], "doc_id bigint, length bigint")
    out = packing.pack(rows, shard_rows=100).groupBy("sequence_id").agg(F.sum("length").alias("s")).collect()
    total = rows.agg(F.sum("length")).first()[0]
    lengths = [r["length"] for r in rows.collect()]
    plain = packing.fit_all(sorted(range(600), key=lambda i: -lengths[i]), lengths, 1024)
    assert max(r["s"] for r in out) <= 1024 and sum(r["s"] for r in out) == total and len(out) <= 1.03 * len(plain.items)


def test_pii(odd, none, spark):
    t = "Mail a.b@c.d, ip 1.2.3.4 or 1.2.3.999, card 4111 1111 1111 1111, tel +1 (212) 555-0100. card: 4111.1111.1111.1111"
    got = pii.find(spark.createDataFrame([(1, t)], "doc_id int, text string")).first()
    kinds = {(s["kind"], t[s["start"] : s["end"]]) for s in got["base"]}
    assert {("email", "a.b@c.d"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100")} == kinds
    assert [s for s in got["base"] if s not in got["spans"]] == []
    assert pii.find(none).count() == 0 and pii.find(odd).count() == len(ODD)
    assert "[EMAIL]" in pii.redact(spark.createDataFrame([(1, t)], "doc_id int, text string")).first()["text"]
    assert pii.redact(odd).columns == odd.columns


@pytest.mark.parametrize("text", ["a@b@c.de", "x@y.z@q.rs", "@a.b", "1.2.3.4.5.6.7.8", "1.2.3", "+1+23 456 7890 1", "00 1-2 3", "9" * 40, "a@b-.c..d"])
def test_pii_base_is_the_patterns(text):
    import re

    e = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    i = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    c = [(m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= sum(x.isdigit() for x in m[0]) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    p = [(m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(x.isdigit() for x in m[0]) <= 15]
    got = pii.base_spans(text)
    for k, want in enumerate((e, i, c, p)):
        assert [(s, x) for s, kind, x in got if kind == k] == want


def test_language_model(spark, none):
    import math
    from collections import Counter

    docs = [(i, "The cat sat" if i % 2 else f"a dog {i} ran") for i in range(60)] + [(100, None)]
    rows = {r["doc_id"]: r for r in language_model.score_texts(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    words = {i: [*(t or "").lower().split(), "\n"] for i, t in docs}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    for i, ws in words.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), sum(c.values()))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in ws))
        assert r["score"] < 0
    assert language_model.score_texts(none).count() == 0


def test_language_model_has_no_bound(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 37 + k * k) % 900}" for k in range(60))) for i in range(400)], "doc_id bigint, text string")
    whole = {r["doc_id"]: r["score"] for r in language_model.score_texts(docs).collect()}
    small = {r["doc_id"]: r["score"] for r in language_model.score_texts(docs, limit=256).collect()}
    assert np.mean([abs(small[i] / whole[i] - 1) for i in whole]) < 0.01  # more, smaller segments; what they hold stays


def _filled(grams, n, level):
    bits = np.zeros(-(-int(level.sum()) * language_model.BITS_EACH // 8), dtype=np.uint8)
    language_model.put(bits, grams, n, level)
    return bits


def test_bigrams_seen_once_are_known():
    grams = np.arange(1, 3001, dtype=np.uint64) * np.uint64(7919)
    bits = _filled(grams, 2, np.ones(3000, dtype=np.int64))
    assert (language_model.probe(bits, grams, 2) >= 1).all()


def test_log_frequency_filter():
    seen, level = np.arange(4000, dtype=np.uint64) * np.uint64(7919), 1 + np.arange(4000) % 9
    assert (language_model.level_of(1 << (level - 1)) == level).all()
    bits = _filled(seen, 1, level)
    assert (language_model.probe(bits, seen, 1) >= level).all()
    assert (language_model.probe(bits, seen, 1) == level).mean() > 0.97
    assert (language_model.probe(bits, seen + np.uint64(1), 1) > 0).mean() < 0.03


def test_html():
    page = '<html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One <b>two\n three<br>four<p>f&eacute;&#x41;</p></article><footer>&copy; me</footer>'
    assert html_extract.extract(page, html_extract.trained()) == "Head & line One two three four féA"
    assert html_extract.extract("", html_extract.trained()) == ""
    nodes = html_extract.labelled_pages(60, 99)
    right = total = 0
    for own in nodes:
        html_extract.features(own)
        prob, _ = html_extract.marginals(own, html_extract.trained())
        for p, x in zip(prob, own, strict=True):
            if x.tag == "#":
                total, right = total + 1, right + ((p >= 0.5) == bool(x.label))
    assert right / total > 0.95


def test_marginals_are_exact():
    from itertools import product
    from math import exp

    nodes = html_extract.parse("<div><p>a</p><b>c</b></div>")
    html_extract.features(nodes)
    m = html_extract.Model({"tag:p": 0.7, "text": -0.4, "tag:div": 0.3}, {("block", 1, 0): -1.0, ("text", 1, 1): 0.8, ("inline", 0, 1): -0.5})
    kind = html_extract._kind
    z, want = 0.0, np.zeros(len(nodes))
    for y in product((0, 1), repeat=len(nodes)):
        s = sum(y[i] * sum(m.unary.get(k, 0) for k in x.keys) for i, x in enumerate(nodes))
        s += sum(m.pair.get((kind(x), y[x.parent], y[i]), 0.0) for i, x in enumerate(nodes) if i)
        z += exp(s)
        want += np.array(y) * exp(s)
    assert np.allclose(html_extract.marginals(nodes, m)[0], want / z)


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16))
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1))
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    hit = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        order = [int(i) for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [o[0] for o in own] == list(range(1, 21)) and all(abs(o[2] - s[o[1]]) < 1e-9 for o in own)
        hit += len({o[1] for o in own} & set(order))
    assert hit / 400 >= 0.9
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_url_filter(spark):
    urls = ["https://Www.Example.COM/en/7817?x", "http://m.a.net/de/1#t", "http://example.net/de/8", "nothing", None, "http://casino-win.org/x", "http://b.org/es/", "http://notcom/en/", "http://com/en/9"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, queries.RULES).collect()}
    assert got[0] == ("www.example.com", "/en/7817", "example.com/en/7", "allow")
    assert got[1][2:] == ("net/de/", "block") and got[2][2] == "example.net/de/8" and got[3] == got[4] == ("", "", None, "allow")
    assert got[5][2:] == (None, "allow") and got[6][3] == "block" and got[7][2] is None and got[8][2] == "com/en/"
    assert url_filter.judge(df.limit(0), queries.RULES).count() == 0


def test_toxicity_learns_and_reads_all(spark, odd):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(200)]
    say = lambda bad: " ".join([*rng.choice(words, 60), *(["vilewort"] if bad else []), *rng.choice(words, 60)])
    net = toxicity.train([say(i % 3 == 0) for i in range(240)], [int(i % 3 == 0) for i in range(240)], steps=150)
    s = toxicity.Scorer(net).scores([say(i % 2 == 0) for i in range(60)])
    right = sum((x >= 0.3) == (i % 2 == 0) for i, x in enumerate(s))
    assert right >= 54
    assert toxicity.windows(100).tolist() == [0, 16, 32, 48, 64, 80] and toxicity.windows(0).tolist() == [0]
    out = toxicity.score(odd, net).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)


def test_gradient():
    net = toxicity.Network.fresh(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(2)
    x, idx, mask = rng.standard_normal((5, toxicity.INPUT)), rng.integers(0, 5, (3, toxicity.WINDOW)), np.ones((3, toxicity.WINDOW), bool)
    _, kept = net.run(net.project(x), idx, mask, keep=True)
    g, _ = net.backward(idx, kept, np.ones(3, np.float32), 5)
    for name, at in (("u", (0, 1, 2)), ("u", (1, 3, 20)), ("attend", (4,)), ("out", (2,))):
        step = 1e-2
        net.p[name][at] += step
        up = net.run(net.project(x), idx, mask).sum()
        net.p[name][at] -= 2 * step
        down = net.run(net.project(x), idx, mask).sum()
        net.p[name][at] += step
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-3)


def test_pipeline(spark, monkeypatch):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    net = toxicity.train(["fine text", "bad stupid"] * 4, [0, 1] * 4, steps=2)
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: net)
    docs = common.read(spark, d, "documents")
    left = docs
    for name, stage in cp.STAGES[:-1]:
        after = common.stage(stage(spark, left, d), name)
        assert after.columns == docs.columns and after.count() <= left.count()
        left = after
    packed = cp.STAGES[-1][1](spark, left, d)
    assert packed.select("doc_id").distinct().count() == left.count()
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "simhash", "pii", "packing"]
