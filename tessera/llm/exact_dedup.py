"""Exact dedup by skew-safe combining, with built-in operations only.

Copies are combined three times: on the map side within an input partition, then in groups of (digest, salt),
where the salt is the input partition's number modulo SALTS, and then over the salts' winners. The full content
is part of the key each time, so equal digests never make texts equal. Documents find their winner by digest
alone where the combined groups show that the digest stands for one content, and by content where it does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SALTS = 64


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal if identical after lower-casing A-Z; null counts as the empty text. Of equal texts the
    largest id stays. Null ids lose against any id; if a group has none but null ids, keep_id is null and all
    its rows are kept. Rows that repeat an id and its text share their fate. Empty tables give empty results;
    extra columns are ignored.
    """
    norm = common.ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    salted = base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = salted.groupBy("digest", "salt", "norm").agg(F.max("id").alias("best"), F.count("*").alias("n"))
    groups = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = common.stage(groups.groupBy("digest").agg(F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "exact-winners")
    out = base.select("id", "digest").join(winners.where("contents = 1").drop("contents"), "digest")
    clash = winners.where("contents > 1").select("digest")
    if not clash.isEmpty():
        own = base.join(clash, "digest", "left_semi")
        out = out.unionByName(own.join(groups.join(clash, "digest", "left_semi"), ["digest", "norm"]).drop("norm"))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Exactly one row of docs for each text (A-Z lower-cased), with the columns as they came: that with the largest id.

    Rows are judged by id and text, so a row of its own text stays even where its id recurs with another text. Of
    rows that share both, or have null ids only, the one that sorts last as JSON stays. Null texts count as empty, an
    empty table gives an empty one, and extra columns may have any names.
    """
    norm = common.ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    own, doc, sha, text, last = common.unused(docs, "own", "doc", "sha", "norm", "last")
    scratch = common.Scratch()
    found = exact_classes(docs, id_col, text_col, salts)
    judged = scratch.stage(found.select(F.col(id_col).alias(doc), F.col("text_sha256").alias(sha), "kept"), "exact-judged")
    drop = judged.where(~F.col("kept")).select(doc, sha).distinct()
    rows = docs.withColumn(own, F.sha2(norm, 256))
    same = F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(sha))
    left = rows.join(drop, same, "left_anti")
    again = scratch.stage(judged.where("kept").groupBy(sha).count().where("count > 1").select(sha), "exact-repeated")
    if again.isEmpty():
        return left.select(docs.columns)
    here = F.col(own) == F.col(sha)
    row = F.struct(*docs.columns)
    one = left.join(again, here, "left_semi").groupBy(own, norm.alias(text)).agg(F.max_by(row, F.to_json(row)).alias(last))
    return left.join(again, here, "left_anti").select(docs.columns).unionByName(one.select(f"{last}.*"))
