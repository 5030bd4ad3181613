"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, exact_dedup, html_extract, language_model, neighbours, packing, periodic, pii, repair, repeats, simhash, tokens, toxicity, url_filter

RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(common.read(spark, sf_dir, "documents"), radius=3, shingle=3, seed=42, words=1)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(common.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(common.read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.tokenizer_path()
    back = bpe.decode(bpe.encode(common.read(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(common.read(spark, sf_dir, "pages"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(common.read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pieces(common.read(spark, sf_dir, "documents"), tokens.tokenizer_path(), keep_ids=False)
    return packing.pack(rows)


def op9_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.read(spark, sf_dir, "pages"), RULES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(common.read(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(common.read(spark, sf_dir, "conversations")))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(common.read(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash, op2_pii, op3_lm, op4_bpe, op5_html, op6_ann, op7_exact, op8_packing, op9_url, op10_toxicity, op11_periodic, op12_repair, op13_repeats]
    return {f.__name__: f for f in found}


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_EXACT = f"""
WITH n AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256, {_LOWERED} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
_URL = """
WITH s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM s),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.action, 'allow') AS verdict
FROM p LEFT JOIN f USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact": _EXACT, "op9_url": _URL}
