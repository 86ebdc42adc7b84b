"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the ``k`` least distinct hashes of a text's shingles (five words, or all words of a
shorter text; a text without words has an empty sketch). Sketches of parts merge into the sketch of the whole, and two
sketches estimate resemblance, containment and distinct counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackstream.llm.common import text_input

SHINGLE = 5
K = 128
#: Documents dealt to one run of neighbours when looking for each document's next, about.
NEIGHBOURS = 256
#: Runs up to which only their rows count, and bytes of values of a run beyond that.
RUNS, RUN_BYTES = 2_000, 64 << 20


def words(text: Column) -> Column:
    """Lower-cased runs without ASCII white space."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """Bottom-k sketch (``array<bigint>``) of a text; null counts as empty.

    Words are hashed once, and a shingle's hash is the hash of its words' hashes, so no shingle text is ever built.
    """
    hashes = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))
    return F.slice(F.sort_array(F.array_distinct(_shingles(hashes, size))), 1, k)


def _shingles(hashes: Column, size: int) -> Column:
    # one array at a time is bound by a one-element transform, so that it is evaluated once
    def of(h: Column) -> Column:
        full = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(1))),
            lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(size)]),
        )
        short = F.transform(F.array(h), lambda x: F.xxhash64(x))
        return F.when(F.size(h) >= size, full).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(hashes), of), 1)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's sketch found in both (1 for two empty sketches)."""

    def of(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))

    return F.element_at(F.transform(F.array(merge(a, b, k)), of), 1).cast("double")


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of hash space below the k-th."""
    share = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too (1 for an empty a)."""
    union = distinct_count(merge(a, b, k), k)
    shared = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def merge_groups(sketches: DataFrame, keys: list[str], sketch_col: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch a group, whatever the group's size: the k least within each salt first, then of those.

    No task holds more than ``salts * k`` hashes of a group, and a hot group is dealt over ``salts`` tasks. Null and
    empty sketches count as nothing; a group of only such has an empty sketch. Null keys form a group of their own.
    """
    hashes = sketches.select(*keys, F.explode_outer(sketch_col).alias("_hash")).distinct()
    hashes = hashes.withColumn("_salt", F.pmod(F.xxhash64("_hash"), F.lit(salts)))
    for by in ([*keys, "_salt"], keys):
        least = W.partitionBy(*by).orderBy(F.col("_hash").asc_nulls_last())
        hashes = hashes.withColumn("_rank", F.row_number().over(least)).where(F.col("_rank") <= k).drop("_rank")
    return hashes.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch_col))


def as_text(s: Column) -> Column:
    """A sketch as one string: 16 lower-case hex digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def id_cuts(docs: DataFrame, id_col: str, runs: int) -> list[int]:
    """Upper ends of about ``runs`` runs of ids with like many rows, ascending; the last is the greatest id.

    A range partitioning of the ids alone finds them; only its bounds, 8 bytes a run, reach the driver.
    """
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").repartitionByRange(runs, "id")
    ends = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.max("id").alias("id"))
    return sorted({r.id for r in ends.collect()})


def with_next(docs: DataFrame, id_col: str, value_cols: list[str], run: int = NEIGHBOURS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Each row with ``next_<c>`` of the row that follows it by descending id; the first follows the last.

    Ids are cut into runs of about ``run`` rows, and into more than ``RUNS`` runs only where each would else have more than
    ``run_bytes`` of values, so a run stays small whatever the size. Each run borrows the greatest row of the run below,
    so no window covers the whole table. A row finds its run in two steps: among every so many of the cuts, then among the
    cuts in between, which are broadcast (8 bytes for each ``run_bytes`` of values). Of repeated ids, each is followed by
    the next row, in order of its values. Null ids come last of all, in run 0. An empty table stays empty.
    """
    size = sum((F.octet_length(F.col(c).cast("string")) if dict(docs.dtypes)[c] == "string" else F.lit(0) for c in value_cols), F.lit(0))
    count = docs.agg(F.count(id_col).alias("n"), F.sum(size).alias("bytes")).first()
    runs = max(1, min(count.n // run, max(RUNS, (count.bytes or 0) // run_bytes)))
    cuts = id_cuts(docs, id_col, runs) if count.n else [0]
    step = max(1, math.isqrt(len(cuts)))
    coarse = F.array(*[F.lit(c) for c in cuts[step - 1 :: step]]).cast("array<bigint>")
    fine = docs.sparkSession.createDataFrame([(k, cuts[k * step : (k + 1) * step]) for k in range(-(-len(cuts) // step))], "_k int, _fine array<bigint>")
    known = F.col(id_col).isNotNull()
    at = docs.select(id_col, *value_cols, F.when(known, F.size(F.filter(coarse, lambda c: c < F.col(id_col)))).otherwise(F.lit(0)).alias("_k"))
    at = at.join(F.broadcast(fine), "_k")
    # the run whose upper end is the first cut at or above the id; null ids follow run 0
    run_of = F.when(known, F.col("_k") * step + F.size(F.filter("_fine", lambda c: c < F.col(id_col)))).otherwise(F.lit(0))
    lends = known & F.array_contains("_fine", F.col(id_col))
    homes = F.array(
        F.struct(run_of.alias("run"), F.lit(0).alias("borrowed")),
        F.when(lends, F.struct(F.pmod(run_of + 1, F.lit(len(cuts))).alias("run"), F.lit(1).alias("borrowed"))),
    )
    dealt = at.select(id_col, *value_cols, F.explode(F.filter(homes, lambda h: h.isNotNull())).alias("_home"))
    order = W.partitionBy("_home.run").orderBy("_home.borrowed", F.col(id_col).desc_nulls_last(), *value_cols)
    following = {f"next_{c}": F.lead(c).over(order) for c in value_cols}
    return dealt.withColumns(following).where("_home.borrowed = 0").drop("_home")


def fingerprint_edits(docs: DataFrame, id_col: str, text_col: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likenesses.

    The edit replaces the last third of a text's code points (rounded down) by the first as many of the next document's,
    or by all of them where it has fewer. Null texts count as empty; a lone document is its own next. Of repeated ids each
    row has a next of its own, in order of text; null ids come last. Empty texts have empty fingerprints. An empty table
    gives no rows. Only id and text are used, so other columns may have any names.
    """
    texts = text_input(docs, id_col, text_col).withColumn("own", sketch(F.col("text"), k, size))
    chained = with_next(texts, "doc_id", ["text", "own"])
    m = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - m), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), m))
    return (
        chained.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", F.coalesce("next_own", F.array().cast("array<bigint>")).alias("next"), edited.alias("edited"))
        .select("doc_id", "n_chars", "own", "next", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), k, size).alias("changed"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("own")).alias("fingerprint"),
            as_text(F.col("changed")).alias("edited_fingerprint"),
            resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
            resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
            distinct_count(F.col("own"), k).alias("n_shingles_est"),
            containment(F.col("own"), F.col("changed"), k).alias("kept_in_edited"),
        )
    )
