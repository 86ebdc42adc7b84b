"""Tables whose commits are swapped as one file, so that a retried or half-done batch changes nothing.

A ``Manifest`` names the folder that holds each slice of a table. A commit writes new folders for the slices that it
touches and then one manifest file, by rename; readers see all of it or nothing. ``KeyedTable`` keeps the latest row of
each key in hash buckets, ``FactTable`` merges facts into date partitions by key, and ``Published`` lets several sinks of
one stream show a micro-batch together.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackstream.sources.scratch import staged

#: Hash buckets of a keyed table or key index. A batch rewrites the buckets that it touches: a table of many keys that
#: gets small batches wants some ten times as many buckets as a batch has keys.
BUCKETS = 64


class Files:
    """The few file operations that commits need, on whatever store the folder is in."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, inner: str) -> list[str]:
        p = self._path(f"{self.folder}/{inner}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.folder}/{name}", wholetext=True).collect())  # one small file

    def put(self, name: str, text: str) -> None:
        """The whole file or none: written beside, then renamed. Of two writers of one name the first stays."""
        draft, final = self._path(f"{self.folder}/_drafts/{uuid.uuid4().hex}"), self._path(f"{self.folder}/{name}")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if not self._fs.rename(draft, final):
            raise FileExistsError(name)

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)


class Manifest:
    """Versions of a map from slice names to folders. Slices are buckets or dates: a bounded number, known to the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files = Files(spark, folder)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("manifest") if n.endswith(".json")]

    def at(self, version: int | None = None) -> tuple[int, dict]:
        """(version, contents) of a version, or of the last one; (-1, {}) before the first commit."""
        there = self.versions()
        if not there:
            return -1, {}
        version = there[-1] if version is None else version
        return version, json.loads(self.files.read(f"manifest/{version:012d}.json"))

    def commit(self, version: int, contents: dict) -> None:
        self.files.put(f"manifest/{version:012d}.json", json.dumps(contents, sort_keys=True))

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last ``keep`` versions, and the data that none of those names (half-done commits too)."""
        there = self.versions()
        for v in there[:-keep]:
            self.files.remove(f"manifest/{v:012d}.json")
        used = {place for v in there[-keep:] for part in self.at(v)[1].values() if isinstance(part, dict) for place in part.values() if isinstance(place, str)}
        for commit in self.files.names("data"):
            inner = [f"data/{commit}/{part}/{x}" for part in self.files.names(f"data/{commit}") for x in self.files.names(f"data/{commit}/{part}") if "=" in x]
            gone = [x for x in inner if x not in used]
            for x in gone:
                self.files.remove(x)
            if len(gone) == len(inner):
                self.files.remove(f"data/{commit}")


def newest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of greatest ``by`` for each key; null is a key like any other."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


class _Sliced:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.manifest = spark, folder.rstrip("/"), Manifest(spark, folder)

    def _scan(self, contents: dict, part: str, names: list[str] | None = None) -> DataFrame | None:
        """Rows of a part's slices (all, or those named that are there)."""
        places = contents.get(part, {})
        found = [f"{self.folder}/{places[n]}" for n in (sorted(places) if names is None else names) if n in places]
        if not found:
            return None
        return self.spark.read.schema(StructType.fromJson(contents[f"{part}_schema"])).parquet(*found)

    def _write(self, rows: DataFrame, slice_col: Column, commit: str, part: str, contents: dict) -> list[str]:
        """Writes one folder a slice; returns the slices' names and enters them into ``contents``."""
        place = f"data/{commit}/{part}"
        rows.withColumn("slice", slice_col.cast("string")).repartition("slice").write.partitionBy("slice").parquet(f"{self.folder}/{place}")
        names = [n.removeprefix("slice=") for n in self.manifest.files.names(place) if n.startswith("slice=")]
        contents.setdefault(part, {}).update({n: f"{place}/slice={n}" for n in names})
        contents[f"{part}_schema"] = rows.schema.jsonValue()
        return names


class KeyedTable(_Sliced):
    """The latest row of each key, in hash buckets. A merge reads and rewrites only the buckets that its rows fall into."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], by: list[str], buckets: int = BUCKETS):
        super().__init__(spark, folder)
        self.keys, self.by, self.buckets = keys, by, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))

    def merge(self, batch: DataFrame, version: int, deleted: Column | None = None) -> bool:
        """Takes a batch in under its number; False, and no change, if that or a later one is there already.

        A row replaces one of smaller ``by``; of equal ``by`` the row that was there stays. Rows for which ``deleted`` holds
        leave a mark, so that an older image of the key that comes later does not bring it back.
        """
        last, contents = self.manifest.at()
        if version <= last:
            return False
        contents.setdefault("buckets", self.buckets)
        if contents["buckets"] != self.buckets:
            raise ValueError(f"the table has {contents['buckets']} buckets")
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        with staged(newest(batch.withColumn("_deleted", gone), self.keys, self.by).withColumn("_bucket", self._bucket()), "merge") as rows:
            touched = [str(r[0]) for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets``
            rows = rows.drop("_bucket")
            held = self._scan(contents, "rows", touched)
            if held is not None:
                both = held.withColumn("_old", F.lit(1)).unionByName(rows.withColumn("_old", F.lit(0)))
                rows = newest(both, self.keys, [*self.by, "_old"]).drop("_old")
            if touched:
                self._write(rows, self._bucket(), f"{version:012d}-{uuid.uuid4().hex[:8]}", "rows", contents)
        self.manifest.commit(version, contents)
        self.manifest.vacuum()
        return True

    def read(self) -> DataFrame | None:
        """The table as last committed; None before the first rows came."""
        rows = self._scan(self.manifest.at()[1], "rows")
        return None if rows is None else rows.where("not _deleted").drop("_deleted")


class FactTable(_Sliced):
    """Facts by key in date partitions. A merge updates rows whose key is there, also into another date, and adds the others.

    An index by hash bucket tells the date of each key, so only the partitions that a batch's keys are in, or go to, are
    read and written; the index and the partitions change in one commit.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, date_col: str, by: list[str], buckets: int = BUCKETS):
        super().__init__(spark, folder)
        self.key, self.date_col, self.by, self.buckets = key, date_col, by, buckets

    def merge(self, facts: DataFrame, version: int) -> bool:
        """Takes a batch in under its number; False if it is there. Of rows of one key the greatest ``by`` stays, wherever it is."""
        last, contents = self.manifest.at()
        if version <= last:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(contents.setdefault("buckets", self.buckets)))
        with staged(newest(facts, [self.key], self.by).withColumn("_bucket", bucket), "facts") as rows:
            self._merge(rows, version, contents, bucket)
        self.manifest.commit(version, contents)
        self.manifest.vacuum()
        return True

    def _merge(self, rows: DataFrame, version: int, contents: dict, bucket: Column) -> None:
        """Writes the partitions and index buckets that the batch touches, and enters them into ``contents``."""
        touched = [str(r[0]) for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets``
        rows = rows.drop("_bucket")
        commit = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        index = self._scan(contents, "index", touched)
        place = rows.select(self.key, F.col(self.date_col).cast("string").alias("_date"))
        dates = place.select("_date")
        if index is not None:
            known = index.join(place.select(F.col(self.key).alias("_k")), F.col(self.key).eqNullSafe(F.col("_k")), "left_semi")
            dates = dates.unionByName(known.select("_date"))
        dates = [r[0] for r in dates.distinct().collect()]  # dates of one batch, before and after
        names = [("__HIVE_DEFAULT_PARTITION__" if d is None else d) for d in dates]
        held = self._scan(contents, "facts", names)
        for n in names:  # a partition that all keys have left is no longer named
            contents.get("facts", {}).pop(n, None)
        if held is not None:
            both = held.withColumn("_old", F.lit(1)).unionByName(rows.withColumn("_old", F.lit(0)))
            rows = newest(both, [self.key], [*self.by, "_old"]).drop("_old")
        with staged(rows, "facts") as merged:
            if not touched:
                return
            self._write(merged, F.col(self.date_col), commit, "facts", contents)
            new_place = merged.select(self.key, F.col(self.date_col).cast("string").alias("_date"))
            if index is not None:
                stays = index.join(new_place.select(F.col(self.key).alias("_k")), F.col(self.key).eqNullSafe(F.col("_k")), "left_anti")
                new_place = new_place.where(bucket.cast("string").isin(touched)).unionByName(stays)
            self._write(new_place, bucket, commit, "index", contents)

    def read(self) -> DataFrame | None:
        return self._scan(self.manifest.at()[1], "facts")


class Published:
    """Sinks of one stream that show a micro-batch together, each batch once, however often it is tried.

    Each sink keeps a batch in a folder of its number, which a retry overwrites. One file tells the last batch that all sinks
    have; ``read`` leaves out what came after it. ``run`` names the stream's checkpoint: a new one counts batches anew.
    """

    def __init__(self, spark: SparkSession, folder: str, run: str = "run"):
        self.spark, self.folder, self.run = spark, folder.rstrip("/"), run
        self.files = Files(spark, f"{self.folder}/{run}")

    def last(self) -> int:
        return max((int(n) for n in self.files.names("_published")), default=-1)

    def write(self, sinks: dict[str, DataFrame], batch: int) -> bool:
        """Writes the batch into all sinks and publishes it; False, and no change, if it was published before."""
        done = self.last()
        if batch <= done:
            return False
        for name, rows in sinks.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{self.run}/{name}/batch={batch}")
        self.files.put(f"_published/{batch}", "")
        for old in self.files.names("_published"):
            if int(old) < batch:
                self.files.remove(f"_published/{old}")
        return True

    def read(self, name: str) -> DataFrame:
        """Rows of published batches of a sink."""
        return self.spark.read.parquet(f"{self.folder}/{self.run}/{name}").where(F.col("batch") <= self.last()).drop("batch")
