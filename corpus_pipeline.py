"""From raw documents to token ids in five stages, each one of the training-data operators.

Every stage takes all rows that its predecessor kept and is written as Parquet before the next one reads it.

In every stage a null text counts as empty, a null id is no reason to go, repeated rows are judged alike (the
near-duplicate stage keeps one of them), an empty table stays empty, and the columns of ``documents`` are returned by all
but the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackstream.llm import bpe, decontam, pii, simhash, toxicity
from trackstream.llm.common import bounded_batches, discard, materialize, table

#: Documents with at least this probability of being toxic are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the toxicity model, learned from training labels, calls toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.in_training())
    return toxicity.judge(docs, model, "text", "_toxicity").where(F.col("_toxicity.score") < TOXIC).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of least id, of each group of near copies: five-word shingles, a similarity of 0.8."""
    bounded_batches(spark)
    return simhash.keep_one(docs, "doc_id", "text", similarity=0.8, size=5).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents of which one word in twenty or more lies in benchmark windows."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"), "text", "item_id", "text", size=13)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Covers personal data in the texts; ``n_chars`` follows."""
    bounded_batches(spark)
    redacted = pii.redact(docs, "text", pii.fit(docs, "text"))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and the digests of ids and decoded bytes."""
    bounded_batches(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.with_decoded(bpe.with_tokens(docs, "text", ranks, pattern), "token_ids", ranks, pattern)
    ids = F.col("token_ids")
    return both.select(
        "doc_id",
        "lang",
        "source",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        ids,
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("tokens", encode_tokens),
]

#: The stages' models and numpy kernels have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
