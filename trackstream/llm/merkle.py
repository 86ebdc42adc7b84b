"""Merkle manifest of a dataset with incremental witnesses.

The leaves of a group form a tree whose nodes have three children each (the last ones fewer); the groups' roots form another.
A tree grows by streaming aligned append: a leaf joins the open subtrees at the right end, and when the siblings of a
subtree are complete, the witnesses of all leaves beneath get one more step. Spark deals the leaves out in aligned blocks
of ``BLOCK``; a block's root is appended in turn to the blocks of the next level, where its own witness grows. A leaf's
witness is its block's steps, then the steps of that block's root, and so on.

``append`` adds a batch of leaves to a stored manifest: closed blocks stay as they are, only the open block at the end of
each group and level is grown again. ``witnesses`` reads a manifest, ``fold`` follows a witness up to the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackstream.llm.common import materialize, new_path, shuffles_deleted, temporary

#: Children of a node.
FAN = 3
#: Levels of tree within a block; a task grows one block at a time, so this bounds what it holds.
LEVELS = 7
BLOCK = FAN**LEVELS
#: Rows of a range of leaves, at most about so many, when their places are counted.
RANGE_ROWS = 500_000

WITNESS = "array<struct<before:string,after:string>>"
_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def combine(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Tree:
    """A tree that grows leaf by leaf. Each leaf's witness holds, from below, the siblings left and right of its path."""

    def __init__(self):
        self.witness: list[list[tuple[str, str]]] = []
        self._open: list[list[tuple[str, list[int]]]] = []  # by level: digests of complete subtrees and the leaves beneath

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._push(0, digest, [len(self.witness) - 1])

    def _push(self, level: int, digest: str, leaves: list[int]) -> None:
        if level == len(self._open):
            self._open.append([])
        self._open[level].append((digest, leaves))
        if len(self._open[level]) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self._open[level] = self._open[level], []
        digests = [d for d, _ in run]
        for k, (_, leaves) in enumerate(run):
            step = ("".join(digests[:k]), "".join(digests[k + 1 :]))
            for leaf in leaves:
                self.witness[leaf].append(step)
        self._push(level + 1, combine(*digests), [x for _, leaves in run for x in leaves])

    def finish(self, levels: int | None = None) -> str:
        """Closes the open runs, up to ``levels`` if given, else until one node remains, and returns that node."""
        level = 0
        while True:
            open_ = self._open[level] if level < len(self._open) else []
            last = level == levels if levels is not None else len(open_) == 1 and not any(self._open[level + 1 :])
            if last:
                return open_[0][0]
            if open_:
                self._close(level)
            level += 1


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field is ``-`` if null, else the bytes of its text, a colon and the text."""
    texts = [f.cast("string") for f in fields]
    told = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*told), 256)


def fold(digest: Column, witness: Column) -> Column:
    """The root that a leaf's digest leads to by a witness."""
    return F.aggregate(witness, digest, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof(witness: Column) -> Column:
    """Digest of all siblings on the way, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def group_key(group: Column) -> Column:
    """A text that sorts as groups do: null first, then by the bytes of the group's text."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 within the group by ``order`` (nulls first), and ``n``, the group's size.

    Ranges of (group, order) are dealt out, so a large group has many. Places count on from the ranges before: that is a
    window over one row for each range and group, not over the rows. Rows equal in all of ``order`` may take any order.
    """
    rows = materialize(rows.withColumn("_tie", F.monotonically_increasing_id()), "merkle-leaves")
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    keys = [group, *order, "_tie"]
    dealt = materialize(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    runs = dealt.groupBy("_range", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    ahead = F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("_range", group, (ahead - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n")), "merkle-ranges")
    return dealt.join(runs, ["_range", group]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def grow(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, pos, n, digest and others) with ``up``, their block, its ``root``, and ``witness``, the steps to it.

    A group of more than a block has exactly ``LEVELS`` levels in each; a smaller one ends where one node remains.
    """
    nodes = nodes.withColumn("up", F.floor(F.col("pos") / BLOCK).cast("long"))
    schema = T.StructType([*nodes.schema.fields, T.StructField("root", T.StringType()), T.StructField("witness", T._parse_datatype_string(WITNESS))])

    def grown(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos").combine_chunks()
        tree = Tree()
        for digest in block["digest"].to_pylist():
            tree.append(digest)
        root = tree.finish(LEVELS if block["n"][0].as_py() > BLOCK else None)
        steps = [[{"before": a, "after": b} for a, b in w] for w in tree.witness]
        return block.append_column("root", pa.array([root] * len(steps), pa.string())).append_column("witness", pa.array(steps, _STEPS))

    return nodes.groupBy("grp", "up").applyInArrow(grown, schema)


def _read(spark: SparkSession, state: list[str], level: int, closed: bool) -> DataFrame | None:
    """A level's closed blocks of all batches, or the open ones of the last batch."""
    paths = [f"{p}/level-{level}/closed={str(closed).lower()}" for p in (state if closed else state[-1:])]
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    found = [p for p in paths if fs(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(p))]
    return spark.read.parquet(*found) if found else None


def append(leaves: DataFrame, state: list[str] | None = None, group: str = "grp", order: tuple[str, ...] = ("id",)) -> list[str]:
    """Adds ``leaves`` (group key, ``digest``, ``order`` and ``row``, a struct to keep) to a manifest; returns its new state.

    ``state`` lists the folders of the batches so far. Within a batch leaves go by ``order``, and batches follow each other.
    Of what was there, only the open block at the right end of each group and level is read and grown again. A batch that
    failed half-way leaves a folder that no state names; commit it again with the state before.
    """
    with temporary(leaves.sparkSession):
        return _append(leaves, list(state or []), group, order)


def _append(leaves: DataFrame, state: list[str], group: str, order: tuple[str, ...]) -> list[str]:
    spark, path = leaves.sparkSession, new_path(leaves.sparkSession, "merkle")
    new = numbered(leaves.withColumnRenamed(group, "grp"), "grp", *order).select("grp", "pos", "n", "digest", "row")
    counts = new.groupBy("grp").agg(F.max("n").alias("more"))
    before = spark.read.parquet(f"{state[-1]}/groups") if state else spark.createDataFrame([], "grp string, n long")
    sizes = before.withColumnRenamed("n", "had").join(counts, "grp", "full").select("grp", F.coalesce("had", F.lit(0)).alias("had"), (F.coalesce("had", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
    with shuffles_deleted(spark):
        sizes.write.parquet(f"{path}/sizes")
        sizes = spark.read.parquet(f"{path}/sizes")
        sizes.select("grp", "n").write.parquet(f"{path}/groups")
        leaves.limit(0).select("row").write.parquet(f"{path}/none")  # the schema, where there are no leaves at all
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if state:
        new = new.drop("n").join(sizes, "grp").withColumn("pos", F.col("pos") + F.col("had")).drop("had")
    level, span = 0, 1
    while True:
        keep = [c for c in new.columns if c != "n"]
        old = _read(spark, state, level, False) if state else None
        if old is not None:
            old = old.select(*keep)
            new = old.join(new.select("grp", "pos"), ["grp", "pos"], "left_anti").unionByName(new.select(*keep))
            new = new.join(sizes.select("grp", "n"), "grp")
            new = new.withColumn("n", F.ceil(F.col("n") / span).cast("long"))
        # a block is closed once no later leaf can come beneath it; the group's number of leaves tells
        span *= BLOCK
        ends = (F.col("up") + 1) * span <= F.col("leaves")
        known = grow(new).join(sizes.select("grp", F.col("n").alias("leaves")), "grp").withColumn("closed", ends).drop("leaves")
        with shuffles_deleted(spark):
            known.write.partitionBy("closed").parquet(f"{path}/level-{level}")
        done = spark.read.schema(known.schema).parquet(f"{path}/level-{level}")
        if largest <= span // BLOCK:
            return [*state, path]
        of_block = (F.ceil(F.col("n") / BLOCK)).cast("long").alias("n")
        new = done.where(F.col("pos") == F.greatest(F.col("up") * BLOCK, F.lit(0))).select("grp", F.col("up").alias("pos"), of_block, F.col("root").alias("digest"))
        level += 1


def _levels(spark: SparkSession, state: list[str]) -> list[DataFrame]:
    out: list[DataFrame] = []
    while True:
        both = [x for x in (_read(spark, state, len(out), True), _read(spark, state, len(out), False)) if x is not None]
        if not both:
            return out
        out.append(both[0] if len(both) == 1 else both[0].unionByName(both[1]))


def _climb(tables: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """(grp, pos, steps, top): for each node of the lowest of ``tables`` the whole way up. ``top`` is the last root.

    ``above`` has the way on from each group's root (grp, steps, top).
    """
    way = None
    for rows in reversed(tables):
        own = rows.select("grp", "pos", "up", "witness", "root")
        if way is None:
            if above is None:
                way = own.select("grp", "pos", F.col("witness").alias("steps"), F.col("root").alias("subroot"), F.col("root").alias("top"))
            else:
                way = own.join(above, "grp").select("grp", "pos", F.concat("witness", "steps").alias("steps"), F.col("root").alias("subroot"), "top")
        else:
            rest = way.withColumnRenamed("pos", "up")
            way = own.join(rest, ["grp", "up"]).select("grp", "pos", F.concat("witness", "steps").alias("steps"), "subroot", "top")
    return way


def witnesses(spark: SparkSession, state: list[str]) -> DataFrame:
    """Per leaf: ``row``, ``leaf``, ``witness`` (all steps to the root), ``subroot`` of its group, and ``root``."""
    tables = _levels(spark, state)
    if not tables:
        none = F.lit(None).cast("string")
        return spark.read.parquet(f"{state[-1]}/none").select("row", none.alias("leaf"), F.lit(None).cast(WITNESS).alias("witness"), none.alias("subroot"), none.alias("root"))
    subroots = tables[-1].where("n = 1").select(F.col("grp").alias("member"), F.col("root").alias("digest"))
    tops = append(subroots.withColumns({"grp": F.lit(""), "row": F.struct("member")}), None, order=("member",))
    of_group = _levels(spark, tops)
    members = of_group[0].select("pos", "row.member")
    above = materialize(_climb(of_group, None).join(members, "pos").select(F.col("member").alias("grp"), "steps", "top"), "merkle-groups")
    blocks = _climb(tables[1:], above)
    blocks = materialize(blocks, "merkle-blocks").withColumnRenamed("pos", "up")
    lowest = tables[0].select("grp", "up", "row", F.col("digest").alias("leaf"), "witness")
    return lowest.join(blocks, ["grp", "up"]).select("row", "leaf", F.concat("witness", "steps").alias("witness"), "subroot", F.col("top").alias("root"))


def manifest(rows: DataFrame, id_col: str, group_col: str, fields: list[str], kept: dict[str, Column] | None = None) -> DataFrame:
    """``witnesses`` of all rows as one batch, leaves ascending by id within their group; ``row`` has the id and ``kept``.

    Nulls in any field have an encoding of their own; a null id comes first in its group, and null is the first group.
    Repeated rows are leaves of their own; rows of equal id go by their digests. A single group's root is the whole root,
    a single leaf its group's. An empty table gives no rows. Further columns of ``rows`` play no part.
    """
    told = {"id": F.col(id_col), "grp": group_key(F.col(group_col)), "digest": leaf(*map(F.col, fields))}
    row = F.struct(F.col(id_col).alias("id"), *[c.alias(name) for name, c in (kept or {}).items()])
    leaves = rows.select(*[c.alias(name) for name, c in told.items()], row.alias("row"))
    return witnesses(rows.sparkSession, append(leaves, None, order=("id", "digest")))
