"""The whole pipeline over rows that tables should not have: nulls in any column, repeated rows and ids, empty and very long texts, further columns whose names the stages use themselves, and no rows at all."""

import corpus_pipeline as cp
import pytest

from tessera.llm import common, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __own string, cid int, kept boolean, score double, `a b` string"


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None, None, "own", 1, None, 0.5, "x")


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    net = toxicity.train(["fine text", "bad stupid"] * 4, [0, 1] * 4, steps=2)
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: net)
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 9)] + [(None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
        return f"file://{tmp_path}"

    return put


def test_every_text_that_passes_is_packed_once(spark, folder):
    rows = [row(1, "The quick Brown fox"), row(2, "the quick brown FOX"), row(3, None), row(4, ""), row(5, "twin rows here"), row(5, "twin rows here"), row(5, "another text of that id"), row(None, "a text without an id"), row(6, " ".join(f"w{k * k % 7919}" for k in range(30_000))), row(7, "write to jo@example.org", None), row(8, "\x00 é 漢字 \U0001f600")]
    d = folder(rows)
    kept = cp.STAGES[0][1](spark, common.read(spark, d, "documents"), d).select("doc_id", "text").collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    stays: dict[str, int | None] = {}
    for r in kept:
        old = stays.get(low(r["text"]), None)
        stays[low(r["text"])] = r["doc_id"] if old is None else max(old, r["doc_id"] or old)
    assert len(stays) > 5
    got = cp.run(spark, d).collect()
    firsts = sorted(str(r["doc_id"]) for r in got if r["piece"] == 0)
    assert firsts == sorted(map(str, stays.values()))
    full: dict[int, list] = {}
    for r in got:
        assert 0 < r["length"] <= 1024
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_a_table_without_rows_gives_none(spark, folder):
    d = folder([])
    out = cp.run(spark, d)
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
