"""Documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry.llm import exact_dedup, ngram_join, packing, quality, secrets
from flowsentry.llm.common import keyed
from flowsentry.plans.storage import checkpoint_dir

#: No SQL text tells the rows of ``run``: rules are learned and ids come from a tokenizer. Tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the learned list reject. Rows of null or empty text go."""
    rules = quality.learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = quality.fresh(docs, "quality")
    return quality.judge(docs, rules, verdict).filter(F.col(f"`{verdict}`.kept")).drop(verdict)


def keep_rows(docs: DataFrame, row: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs``, without ``key``, whose key of that name is in ``row`` (one column, row)."""
    kept = docs.join(row.select(F.col("row").alias(key)), key, "left_semi")
    return kept.select(*[f"`{c}`" for c in docs.columns if c != key])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    key = quality.fresh(docs, "row_key")
    docs = keyed(docs, key)
    return keep_rows(docs, exact_dedup.dedup_exact(docs, row_col=key).filter("kept").select("row"), key)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8 or more stays: the one of smallest id, then place."""
    key = quality.fresh(docs, "row_key")
    docs = keyed(docs, key)
    linked = ngram_join.link_documents(docs, row_col=key)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    grouped = linked.filter("n_shingles > 0").groupBy("group").agg(F.min(order).alias("first"))
    return keep_rows(docs, grouped.select("first.row").union(linked.filter("n_shingles = 0").select("row")), key)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Covers secrets in the texts; n_chars follows. All rows stay."""
    out = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*[f"`{c}`" for c in docs.columns])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 4096 tokens."""
    pieces = packing.pack_documents(docs, "word_bpe_49k.json")
    return pieces.select(
        "sequence_id", "offset", "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens",
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("secret_scan", hide_secrets),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is stored in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
