"""Three-pass chunking with an embedder that is passed in."""

import numpy as np
import pytest

from tessera.operators import chunking
from tessera.session import new_path


def embedder(subjects=("cat", "tax", "sea")):
    """One place for each subject that a text names."""

    def embed(texts):
        return [[float(s in t) for s in subjects] for t in texts]

    return embed


def say(subject, n):
    return " ".join([subject, *["word"] * (n - 1)])


def test_boundaries():
    s = chunking.Settings(window=2, least=10, most=30, dynamic=False, threshold=0.5)
    v = np.array([[1, 0], [1, 0], [0, 1], [0, 1], [1, 0]], float)
    alike = chunking.similarities(v, 2)
    assert alike == pytest.approx([1, 0, 1 / np.sqrt(2), 0])
    assert [r[0] for r in chunking.runs_of(alike, np.array([10] * 5), 0.5, s)] == [0, 2, 4]
    assert [r[0] for r in chunking.runs_of(alike, np.array([4] * 5), 0.5, s)] == [0, 4]  # too short to split before
    found = chunking.runs_of(np.ones(4), np.array([12] * 5), 0.5, s)
    assert [r[0] for r in found] == [0, 2, 4] and not any(r[1] for r in found)  # too long to go on


def test_threshold_aims_at_the_wanted_length():
    rng = np.random.default_rng(0)
    alike, tokens = rng.random(400), np.full(401, 10)
    for least, most in ((20, 25), (25, 40)):
        s = chunking.Settings(least=least, most=most, tolerance=0, adjustment=0.001)
        cuts = [0, *(np.flatnonzero(alike < chunking.best_threshold(alike, tokens, s)) + 1)]
        assert least <= np.median(np.add.reduceat(tokens, cuts)) <= most
    assert chunking.best_threshold(np.zeros(0), np.array([3]), chunking.Settings()) == 0.5


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, 0, say("cat", 20), "x"), (1, 1, say("cat", 20), "x"), (1, 2, "  <b> </b>", "x"), (1, 3, say("tax", 20), "x"), (1, 4, say("tax", 20), "x"),
        (2, 0, f"{say('cat', 15)}. {say('cat', 15)}. {say('sea', 15)}. {say('sea', 14)}.", "x"),
        (3, 0, say("sea", 170), "x"), (4, 0, None, "x"), (None, 5, say("tax", 3), "x"),
        (5, 0, "שלום עולם. " * 30, "x"), (5, 1, say("sea", 5), "x"),
    ]
    df = spark.createDataFrame(rows, "section int, place bigint, text string, tokens string")
    s = chunking.Settings(window=2, least=20, most=60, dynamic=False, threshold=0.5)
    got = chunking.chunk(df, embedder(), s).collect()
    return {k: sorted((r for r in got if r["section"] == k), key=lambda r: r["chunk"]) for k in (1, 2, 3, 4, 5, None)}


def test_passes(chunks):
    one = [(r["first"], r["last"], r["kind"], r["pass"], r["triggered"]) for r in chunks[1]]
    assert one == [(0, 1, "multi_segment", 1, False), (3, 4, "multi_segment", 1, True)]
    assert [(r["kind"], r["text"].split()[0]) for r in chunks[2]] == [("intra_segment", "cat"), ("intra_segment", "sea")]
    assert [r["kind"] for r in chunks[3]] == ["hard_max_split"] * 3 and sum(r["tokens"] for r in chunks[3]) == 170
    assert chunks[4] == [] and [r["kind"] for r in chunks[None]] == ["single_segment"]
    assert all(r["tokens"] <= 60 for own in chunks.values() for r in own)


def test_hebrew_is_split_by_rule(chunks):
    text = " ".join(r["text"] for r in chunks[5])
    assert text.count("שלום עולם.") == 30 and text.endswith(say("sea", 5))


def test_no_text_is_embedded_twice(spark):
    calls = spark.sparkContext.accumulator(0)

    embed = embedder()

    def counted(texts):
        calls.add(len(texts))
        return embed(texts)

    df = spark.createDataFrame([("cat",), ("cat",), ("tax",)], "text string").repartition(3)
    cache = new_path(spark, "cache-test")
    for extra in ([], ["sea"]):
        texts = df.union(spark.createDataFrame([(t,) for t in extra], "text string"))
        got = chunking.embeddings(texts, counted, cache, "m").collect()
        assert len(got) == 2 + len(extra)
    assert calls.value == 3
    rows = spark.createDataFrame([(1, k, say(x, 30)) for k, x in enumerate(("cat", "cat", "sea"))], "section int, place int, text string")
    same = [[tuple(r) for r in chunking.chunk(rows, embed, chunking.Settings(least=20, most=90), cache=c).collect()] for c in (None, cache)]
    assert same[0] == same[1] and len(same[0]) == 2
    assert chunking.chunk(spark.createDataFrame([], "section int, place int, text string")).count() == 0


def test_words_with_equal_letters_differ():
    a, b = chunking.hashed_embedder()(["listen to this", "silent to this"])
    assert np.dot(a, b) < 0.95
