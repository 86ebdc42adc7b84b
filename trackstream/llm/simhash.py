"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most ``max_bits`` bits are cut into ``max_bits // 2 + 1`` segments, so that one segment
differs in at most one bit. Each segment is indexed once whole and once per wildcard position; equal signatures are
joined and the pairs verified. Only distinct fingerprints take part, so exact copies cost nothing.

Segment values shared by very many distinct fingerprints (a large group of near copies) leave the pair join. The
fingerprints in and beside them are linked through the values within one bit of them instead: two fingerprints differ in
at most two bits exactly if such a value is common to both, and no such value has more than 65 holders. That is exact,
linear, and needs no pairs.

``near_duplicates`` links by fingerprint alone. ``keep_one`` links by similarity: these links of five-word fingerprints
propose pairs, and so do min-hash bands, as fingerprints of texts with a similarity of 0.8 are some ten bits apart, beyond
any radius that variants can index. The shingle sets of the two texts decide.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackstream.llm.common import discard, join_values, materialize, measured_broadcasts, temporary, text_input
from trackstream.llm.components import components

BITS = 64
#: A segment value with more distinct fingerprints than this goes the linear way.
DENSE = 64


def simhash_text(text: str, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    count = max(1, len(words) - size + 1)
    hashes = np.fromiter((digest(b" ".join(words[i : i + size]), seed) for i in range(count)), np.uint64, count)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, count, 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, size: int = 3, seed: int = 42) -> Column:
    """SimHash as a signed long. Words are runs without ASCII white space, A-Z lower-cased; null counts as empty."""

    @F.pandas_udf("long")
    def simhashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([simhash_text(t or "", size, seed) for t in batch], np.uint64).view(np.int64))

    return simhashes(text)


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    n = max_bits // 2 + 1
    ends = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _segment(fp: Column, low: int, width: int) -> Column:
    mask = (1 << width) - 1
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)).cast("long"))


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def _segment_rows(prints: DataFrame, max_bits: int) -> DataFrame:
    parts = [
        F.struct(F.lit(s).alias("segment"), F.lit(width).alias("width"), _segment(F.col("fp"), low, width).alias("value"))
        for s, (low, width) in enumerate(_segments(max_bits))
    ]
    return prints.select("fp", "node", F.explode(F.array(*parts)).alias("s")).select("fp", "node", "s.*")


def _signatures(rows: DataFrame) -> DataFrame:
    """One row for the whole segment (wildcard -1) and one for each wildcard position, with the bit found there."""
    return (
        rows.select("fp", "node", "segment", "value", F.explode(F.expr("sequence(-1, width - 1)")).alias("wildcard"))
        .withColumn("mask", F.when(F.col("wildcard") < 0, F.lit(0).cast("long")).otherwise(_bit(F.greatest("wildcard", F.lit(0)))))
        .select(
            "fp",
            "node",
            "segment",
            "wildcard",
            F.col("value").bitwiseAND(F.bitwise_not("mask")).alias("rest"),
            F.when(F.col("wildcard") < 0, F.lit(2)).when(F.col("value").bitwiseAND(F.col("mask")) == 0, F.lit(0)).otherwise(F.lit(1)).alias("bit"),
        )
    )


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, max_bits: int = 2, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of nodes that connect all fingerprints within ``max_bits`` (0, 1 or 2) of each other, and no others.

    ``prints`` has distinct ``fp`` and a ``node`` id each. Sparse fingerprints give every such pair; dense ones give
    pairs with the same connected components.

    Spark estimates rows made by an explode at the size of those before it, here less by a factor of up to 65, so their joins
    are told to merge: by the estimate, signatures of some 100,000 fingerprints would be broadcast.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    if max_bits == 0:
        return prints.select(F.col("node").alias("a"), F.col("node").alias("b")).where(F.lit(False))
    rows = _segment_rows(prints, max_bits)
    crowded = materialize(rows.groupBy("segment", "width", "value").count().where(F.col("count") > dense).drop("count"), "dense")
    crowds = crowded.count()
    sparse = rows.join(crowded, ["segment", "width", "value"], "left_anti") if crowds else rows
    signs = _signatures(sparse)
    left, right = signs.where("bit != 1").alias("l"), signs.where("bit != 0").hint("merge").alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("segment", "wildcard", "rest")]
    whole = (F.col("l.bit") == 2) & (F.col("l.fp") < F.col("r.fp"))
    joined = left.join(right, same[0] & same[1] & same[2] & (whole | (F.col("l.bit") == 0)) & (_differing(F.col("l.fp"), F.col("r.fp")) <= max_bits))
    pairs = joined.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    if not crowds:
        return pairs
    beside = crowded.select(
        "segment", F.explode(F.expr("concat(array(value), transform(sequence(0, width - 1), i -> value ^ shiftleft(1L, i)))")).alias("value")
    ).distinct()
    near = rows.join(beside.hint("merge"), ["segment", "value"], "left_semi").select("fp", "node").distinct()
    if max_bits == 2:  # values within one bit
        centres = near.select("node", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("centre"))
        centres = centres.withColumn("wildcard", F.lit(0))
    else:  # equal but for one position
        centres = near.select("node", "fp", F.explode(F.expr("sequence(0, 63)")).alias("wildcard"))
        centres = centres.select("node", "wildcard", F.expr("fp & ~shiftleft(1L, wildcard)").alias("centre"))
    stars = centres.groupBy("centre", "wildcard").agg(F.min("node").alias("a"), F.collect_list("node").alias("members"))  # at most 65
    return pairs.unionByName(stars.where("size(members) > 1").select("a", F.explode("members").alias("b")).where("a != b"))


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, max_bits: int = 2, size: int = 3, dense: int = DENSE) -> DataFrame:
    """Per document: ``doc_id``, ``fingerprint`` (signed long) and ``component_id``, the smallest id linked to it.

    Null and empty texts have fingerprint 0 and are linked like any others. Repeated rows keep a row each. A row with a
    null id gets a fingerprint, takes no part in linking, and has a null component. An empty table gives no rows. Only
    id and text are used, so other columns may have any names.
    """
    prints = materialize(text_input(docs, id_col, text_col).select("doc_id", fingerprint(F.col("text"), size).alias("fp")), "simhash")
    known = prints.where(F.col("doc_id").isNotNull())
    with measured_broadcasts(docs.sparkSession):
        nodes = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "simhash-nodes")
        edges = materialize(links(nodes.select("fp", "node"), max_bits, dense), "simhash-links")
        of_print = materialize(nodes.join(components(edges), "node", "left").select("fp", "copies", F.coalesce("component", "node").alias("component_id")), "simhash-groups")
    discard(nodes, edges)
    out = join_values(known, of_print, "fp", "copies", merged=True).select("doc_id", F.col("fp").alias("fingerprint"), "component_id")
    return out.unionByName(prints.where(F.col("doc_id").isNull()).select("doc_id", F.col("fp").alias("fingerprint"), F.lit(None).cast(out.schema["component_id"].dataType).alias("component_id")))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# Near copies by similarity: SimHash links and min-hash bands of five-word shingles propose, the shingle sets decide.

#: Min-hashes in a band, and bands: a pair of similarity s shares one with probability 1 - (1 - s^r)^b: 0.9965 at 0.8, and
#: 0.005 at 0.3, as of texts that share a passage.
ROWS, BANDS = 7, 24
#: Bands whose crowds meet their least member at once; those of other bands then mostly are of one group already.
STARRED = 3
#: A bucket with more texts than this is a crowd: its members meet one of them, not each other.
CROWD = 32
#: A crowd with no more texts outside its main group is settled by comparing those with all of its members: up to some
#: hundreds, that costs less than to deal out and count the members' shingles.
FEW = 400
#: Texts of either side that a task compares.
BLOCK = (64, 256)
#: Shingles handled at a time.
SHINGLES = 1 << 14


def _bits(hashes: np.ndarray) -> int:
    """SimHash of hashes as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), SHINGLES):
        ones += np.unpackbits(hashes[k : k + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _remixed(h: np.ndarray, k: int) -> np.ndarray:
    x = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words is one shingle, one without words has none."""
    words = np.array([xxhash.xxh64_intdigest(w) for w in text.encode().lower().split()], np.uint64)
    n = min(size, len(words))
    if not n:
        return words
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = _remixed(out ^ words[i : len(words) - n + 1 + i], 1)
    return np.unique(out)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One number for each band of min-hashes; sets of similarity s share each with probability s to the band's width."""
    if not len(shingles):
        return np.empty(0, np.int64)
    n = ROWS * BANDS
    seeds = _remixed(np.arange(1, 2 * n + 1, dtype=np.uint64), 2)
    least = np.full(n, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), SHINGLES // 8):
        mixed = (shingles[k : k + SHINGLES // 8, None] ^ seeds[:n]) * (seeds[n:] | np.uint64(1))
        np.minimum(least, mixed.min(0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _remixed(key ^ column, 1)
    return key.view(np.int64)


def sketches(text: Column, size: int) -> Column:
    """SimHash of the shingle set, its size, and its band keys."""

    @F.pandas_udf("struct<fp:bigint,weight:int,keys:array<bigint>>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t or "", size) for t in batch]
            yield pd.DataFrame({"fp": [_bits(s) for s in sets], "weight": [len(s) for s in sets], "keys": [band_keys(s) for s in sets]})

    return sketched(text)


def _shingle_set(text: Column, size: int) -> Column:
    @F.pandas_udf("array<bigint>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(t or "", size).view(np.int64) for t in batch], dtype=object)

    return hashed(text)


def _texts(text: Column) -> dict[str, Column]:
    """128 bits that tell texts apart."""
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def print_pairs(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that their fingerprints propose: within two bits, by ``links``.

    Of nodes with one fingerprint all meet the least, which stands for them.
    """
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "prints")
    same = join_values(nodes.select("node", "fp"), prints.where("n > 1").select("fp", F.col("node").alias("a"), "n"), "fp", "n").select("a", F.col("node").alias("b"))
    return links(prints.select("fp", "node"), 2, dense).select("a", "b").unionByName(same)


def bucket_members(keyed: DataFrame) -> DataFrame:
    """``keyed`` rows (key, node, ...) of keys with several nodes, with ``size``, the key's rows, and ``pivot``, its least node."""
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"), "buckets")
    return materialize(join_values(keyed, sizes.withColumn("size", F.col("n")), "key", "n"), "bucket-members")


def small_pairs(held: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """Pairs (a, b) of members of buckets of up to ``crowd``, but for sets whose sizes rule the similarity out."""
    met = held.where(F.col("size") <= crowd).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "weight"))).alias("m"))  # ``crowd`` at most
    pairs = met.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x, y))))")).alias("p")).select("p.x", "p.y")
    able = F.least("x.weight", "y.weight") >= F.lit(similarity) * F.greatest("x.weight", "y.weight")
    return pairs.where(able).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def similar(pairs: DataFrame, nodes: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs whose sets of shingles have a Jaccard similarity of ``similarity`` or more, written to a table."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = materialize(ordered, "pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    sets = materialize(used.join(nodes.select("node", "text"), "node").select("node", "n", _shingle_set(F.col("text"), size).alias("set")), "shingles")
    both = pairs
    for c in "ab":
        both = join_values(both, sets.select(F.col("node").alias(c), "n", F.col("set").alias(f"set_{c}")), c, "n")
    common = F.size(F.array_intersect("set_a", "set_b"))
    alike = (common > 0) & (common >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - common))
    edges = materialize(both.where(alike).select("a", "b"), "alike")
    discard(pairs, sets)
    return edges


def _thinned(edges: DataFrame) -> DataFrame:
    """Fewer links (a < b) with the same connected components: a node's smaller neighbours are linked to its least one."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    steps = edges.join(least, "b").select(F.col("least").alias("a"), F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a")).alias("b"))
    return materialize(steps.distinct(), "thinned")


def _unsettled(crowds: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (key, node, group, main, others, size) of crowds that are not one group; ``others`` are not of the main one."""
    told = materialize(crowds.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("group")), "crowds")
    by_group = told.groupBy("key", "group").agg(F.count("*").alias("n"))
    mains = by_group.groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("others"))
    return materialize(join_values(told, mains.where("others > 0").withColumn("n", F.col("size")), "key", "n"), "unsettled")


def _main_pairs(unsettled: DataFrame) -> DataFrame:
    """Members outside a crowd's main group, each with the crowd's least member of that group."""
    least = unsettled.where(F.col("group") == F.col("main")).groupBy("key").agg(F.min("node").alias("a"), F.max("others").alias("n"))
    return join_values(unsettled.where(F.col("group") != F.col("main")).select("key", F.col("node").alias("b")), least, "key", "n").select("a", "b")


def block_links(unsettled: DataFrame, nodes: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links (a, b) between the members outside each crowd's main group and all members of other groups, written to a table.

    Those outside are dealt into parts of about ``BLOCK[0]``, all members into parts of about ``BLOCK[1]``; a task compares
    one part with the other, so that what travels and what a task holds stay small however large the crowd.
    """
    sets = unsettled.select("node").distinct().join(nodes.select("node", "text"), "node").select("node", _shingle_set(F.col("text"), size).alias("set"))
    told = materialize(unsettled.join(materialize(sets, "crowd-sets"), "node"), "crowd-members")
    parts = [F.ceil(F.col(c) / n).cast("int") for c, n in zip(("others", "size"), BLOCK, strict=True)]
    own = [F.pmod(F.xxhash64("node", F.lit(k)), parts[k]).cast("int") for k in (0, 1)]
    outer = told.where(F.col("group") != F.col("main")).select("key", own[0].alias("c"), F.explode(F.sequence(F.lit(0), parts[1] - 1)).alias("m"), F.lit(True).alias("outer"), "node", "group", "set")
    inner = told.select("key", F.explode(F.sequence(F.lit(0), parts[0] - 1)).alias("c"), own[1].alias("m"), F.lit(False).alias("outer"), "node", "group", "set")

    def compare(block: pa.Table) -> pa.Table:
        outer, group, node = (block[c].to_numpy() for c in ("outer", "group", "node"))
        sets = [x.values.to_numpy() for x in block["set"]]
        mine, theirs = np.flatnonzero(outer), np.flatnonzero(~outer)
        found: list[tuple[int, int]] = []
        if len(mine) and len(theirs):
            flat, sizes = np.concatenate([sets[k] for k in theirs]), np.array([len(sets[k]) for k in theirs])
            starts = np.cumsum(sizes) - sizes
            for i in mine:
                x = np.sort(sets[i])
                common = np.add.reduceat((x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat).astype(np.int64), starts)
                alike = (common >= similarity * (len(x) + sizes - common)) & (group[theirs] != group[i])
                found += [(min(node[i], node[k]), max(node[i], node[k])) for k in theirs[alike]]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return materialize(outer.unionByName(inner).groupBy("key", "c", "m").applyInArrow(compare, "a long, b long").distinct(), "alike")


def prefix_keys(nodes: DataFrame, similarity: float, size: int) -> DataFrame:
    """(key, node, weight): each text's rarest shingles, so many that two similar texts share one for certain.

    Sets of similarity s or more share at least s of either; so of |x| shingles in one order, here by how few of ``nodes``
    have them, one of the first |x| - s|x| + 1 is among the first ones of the other text too.
    """
    each = materialize(nodes.select("node", "weight", F.explode(_shingle_set(F.col("text"), size)).alias("key")), "crowd-shingles")
    uses = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    ranked = join_values(each, uses.withColumn("uses", F.col("n")), "key", "n").groupBy("node", "weight").agg(F.sort_array(F.collect_list(F.struct("uses", "key"))).alias("shared"))
    # shingles of one text alone come first and join nothing: they take places of the prefix
    places = F.col("weight") - F.ceil(F.lit(similarity) * F.col("weight")) + 1 - (F.col("weight") - F.size("shared"))
    return ranked.where(places > 0).select(F.explode(F.slice("shared", F.lit(1), places.cast("int"))).alias("s"), "node", "weight").select("s.key", "node", "weight")


def _joined(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups`` (node, component) with further links: only groups that these join are worked through again."""
    ends = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "ends")
    links_ = edges.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").where("x != y")
    links_ = materialize(links_.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "group-links")
    if links_.isEmpty():
        return groups
    both = groups.unionByName(ends.join(groups, "node", "left_anti"))
    over = components(links_)
    moved = both.join(over.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(moved, "groups")


def groups_of_texts(docs: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, size: int = 5, dense: int = CROWD) -> DataFrame:
    """Per distinct text (k1, k2): ``first``, its least id, and ``keeper``, whether it stands for its group.

    Texts are linked if the Jaccard similarity of their sets of ``size``-word shingles is ``similarity`` or more and a
    SimHash link or a min-hash band proposes them; groups are connected components. A group's keeper has the least
    (id, k1, k2), null ids last. Texts without words are linked to their equals only.

    Buckets of up to ``dense`` texts give all pairs. Of larger ones, crowds, members meet one of them: all in some bands,
    then, in every band, those outside the group that most of the crowd is in. A crowd that is one group by then is
    settled, as no further pair could change a group. Of a crowd with few members outside its main group, those are
    compared with all others. Members of other crowds are joined by their rarest shingles, which finds every pair; in crowds
    that these have in turn, all members outside the main group are compared with all others, in blocks.
    """
    spark = docs.sparkSession
    with measured_broadcasts(spark), temporary(spark) as tables:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        texts = rows.withColumns(_texts(F.col("text"))).groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.any_value("text").alias("text"))
        told = texts.select("k1", "k2", "first", "text", sketches(F.col("text"), size).alias("s"))
        nodes = materialize(told.select("k1", "k2", "first", "text", "s.*").withColumn("node", F.monotonically_increasing_id()), "texts")
        wordy = nodes.where("weight > 0")
        with temporary(spark) as used:
            held = bucket_members(wordy.select(F.posexplode("keys").alias("band", "key"), "node", "weight"))
            stars = held.where((F.col("size") > dense) & (F.col("band") < STARRED) & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
            crowds = used.keep(materialize(held.where(F.col("size") > dense).select("key", "node"), "crowds"))
            pairs = small_pairs(held, similarity, dense).unionByName(stars).unionByName(print_pairs(wordy.select("node", "fp")))
            groups = used.keep(materialize(components(_thinned(similar(pairs, nodes, similarity, size))), "groups"))
        with temporary(spark) as used:
            groups = used.keep(_joined(groups, similar(_main_pairs(_unsettled(crowds, groups)), nodes, similarity, size)))
        with temporary(spark) as used:
            open_ = _unsettled(crowds, groups)
            groups = used.keep(_joined(groups, block_links(open_.where(F.col("others") <= FEW), nodes, similarity, size)))
            hard = used.keep(materialize(open_.where(F.col("others") > FEW).select("node").distinct(), "hard"))
        if not hard.isEmpty():
            with temporary(spark) as used:
                held = bucket_members(prefix_keys(wordy.join(hard, "node", "left_semi"), similarity, size))
                groups = _joined(groups, similar(small_pairs(held, similarity, dense), nodes, similarity, size))
                crowds = held.where(F.col("size") > dense).select("key", "node")
                groups = _joined(groups, similar(_main_pairs(_unsettled(crowds, groups)), nodes, similarity, size))
                groups = used.keep(_joined(groups, block_links(_unsettled(crowds, groups), nodes, similarity, size)))
        of_node = nodes.select("node", "k1", "k2", "first").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        order = F.struct(F.col("first").isNull().alias("last"), "first", "k1", "k2")
        keepers = of_node.groupBy("component").agg(F.min(order).alias("best")).select("best.*").drop("last").withColumn("keeper", F.lit(True))
        return tables.keep(materialize(keepers, "keepers"))


def keep_one(docs: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """One row of ``docs`` for each group of near copies: rows are judged by their texts, and the least id stays.

    Two texts under one id are judged apart. Of repeated rows (id and text alike) one stays. A null id comes last in its
    group, so such a row stays only where no other has its text or a near copy of it. Null and empty texts are copies of
    each other. An empty table stays empty. All columns are kept, whatever their names.
    """
    keepers = groups_of_texts(docs, id_col, text_col, similarity, size)
    keys = _texts(F.coalesce(F.col(text_col), F.lit("")))
    own = {f"_{uuid.uuid4().hex}": c for c in (F.col(id_col), *keys.values())}
    i, a, b = own
    kept = keepers.select(F.col("first").alias(f"{i}_"), F.col("k1").alias(f"{a}_"), F.col("k2").alias(f"{b}_"))
    same = F.col(i).eqNullSafe(F.col(f"{i}_")) & (F.col(a) == F.col(f"{a}_")) & (F.col(b) == F.col(f"{b}_"))
    return docs.withColumns(own).join(kept.hint("merge"), same, "left_semi").dropDuplicates(list(own)).drop(*own)
