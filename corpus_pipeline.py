"""The corpus pipeline: stages over documents, each of which calls an operator of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, exact_dedup, packing, pii, simhash, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    return toxicity.drop_toxic(docs, common.read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, the smallest doc_id stays."""
    return simhash.near_dedup(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are cut and packed into sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs, tokens.tokenizer_path(), keep_ids=False))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("pii", redact_pii), ("packing", pack)]
#: Network, SimHash and packing have no SQL form. Tests compare dropping with the scores, both dedups and redaction with
#: plain versions, and packing with the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again by the next."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
