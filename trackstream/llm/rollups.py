"""Token counts as delta-maintained rollups.

Documents are inserted, deleted or recounted; each change is a signed row, and totals by key are sums of signed rows.
A batch commits as one partition folder of its signed sums, overwritten as a whole, so committing it again changes
nothing. Totals are sums over batches. Compaction folds batches into one without changing a total, and keeps the names of
those it folded: a late retry of one of them is known and left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch string"


def counted(docs: DataFrame, id_col: str, tokenizers: dict[str, Column], also: dict[str, Column] | None = None) -> DataFrame:
    """Ledger rows (doc_id, source, lang, tokenizer, n_tokens), one for each row of ``docs`` and tokenizer version.

    ``tokenizers`` maps a version's name to the expression of its count over ``docs``; a null count is 0. ``also`` adds
    columns to the ledger, such as a digest that tells the texts of a repeated id apart. Rows with a null id, and repeated
    rows, have ledger rows of their own.
    """
    each = [F.struct(F.lit(name).alias("tokenizer"), F.coalesce(n, F.lit(0)).cast("long").alias("n_tokens")) for name, n in tokenizers.items()]
    more = also or {}
    told = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in more.items()], "source", "lang", F.explode(F.array(*each)).alias("c"))
    return told.select("doc_id", *more, "source", "lang", "c.*")


def inserts(ledger: DataFrame) -> DataFrame:
    """Signed rows that add counted documents."""
    return ledger.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(ledger: DataFrame) -> DataFrame:
    """Signed rows that take counted documents away."""
    return ledger.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that replace counts: a document's old rows go and its new ones come, under whatever keys each has."""
    return deletes(before).unionByName(inserts(after))


def _sums(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def folded(spark: SparkSession, folder: str) -> list[str]:
    """Names of the batches that compaction put into this folder: a few bytes a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_folded")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return sorted(r[0] for r in spark.read.schema("batch string").parquet(f"{folder}/_folded").collect())


def commit(changes: DataFrame, folder: str, batch: str) -> bool:
    """Commit signed rows as ``batch``; whether it was written.

    Committing the same batch again replaces what it wrote before, also by nothing at all; other batches stay as they
    are. A batch that compaction has folded is not written again. Sums are formed within each task before the shuffle, so
    a hot source costs no more than any other. A null source or language is a key like any other.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    if batch in folded(changes.sparkSession, folder):
        return False
    _sums(changes).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    return True


def committed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; keys whose documents all went are gone."""
    return _sums(committed(spark, folder)).where("n_docs <> 0 or n_tokens <> 0")


def compact(spark: SparkSession, folder: str, into: str, name: str) -> None:
    """Write all committed batches of ``folder`` as the one batch ``name`` of a new folder ``into``, and their names beside it."""
    rows = committed(spark, folder)
    names = [r[0] for r in rows.select("batch").distinct().collect()] + folded(spark, folder)
    commit(rows.drop("batch"), into, name)
    log = spark.createDataFrame([(n,) for n in sorted({*names} - {name})], "batch string")
    log.coalesce(1).write.mode("overwrite").parquet(f"{into}/_folded")
