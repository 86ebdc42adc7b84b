"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry, by Ball k-means.

A codebook entry and the parts that it holds are a ball. Entries further than two radii from a ball's own entry cannot take
a part of it; only nearer ones are its neighbours. A part within half the way to the nearest neighbour lies in the stable
core and keeps its entry without another distance. The rest of the ball is cut into rings by half the ways to the
neighbours in order, and a part is compared exactly with those neighbours only that its ring reaches. All numbers are
integers, so nothing is lost by the bounds, and ties go to the lower index.

A round reads the stored integer vectors once and adds up, in each task, the parts of every entry; codebooks are tiny and
travel with the tasks. Each vector is stored with the entries that held it when it was written. A round that finds more than
``REWRITE`` of the parts elsewhere writes the table anew, so that balls stay tight; otherwise a round only reads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackstream.llm.common import discard, join_values, materialize

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Share of parts that have left the entry they are stored with, above which the table is written anew.
REWRITE = 0.25
#: Vectors worked through at a time in a task.
CHUNK = 16_384
#: Components are below this in size, so that squared distances of parts of up to 64 components fit 64 bits.
LARGEST = 2**27
FAR = np.int64(2**63 - 1)


class Codebook:
    """Entries of one part position, their mutual distances, and each entry's neighbours in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.order = [np.array([j for j in np.argsort(row, kind="stable") if j != i], np.int64) for i, row in enumerate(self.apart)]

    def nearest(self, parts: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each part, and how many distances were computed; ``home``: entries to begin with.

        With d the distance to the home entry h, another entry j can be as near only if |hj| <= 2d. So a ball of radius r
        has the neighbours |hj| <= 2r, the stable core is 2d < |hj| for the nearest j, and each ring lies between two of them.
        """
        entry, best = home.copy(), ((parts - self.entries[home]) ** 2).sum(1)
        own, spent = best.copy(), len(parts)
        by_ball = np.argsort(home, kind="stable")
        ends = np.searchsorted(home[by_ball], np.arange(len(self.entries) + 1))
        for h in range(len(self.entries)):
            ball = by_ball[ends[h] : ends[h + 1]]
            if not len(ball):
                continue
            apart = self.apart[h][self.order[h]]
            near = np.searchsorted(apart, 4 * own[ball].max(), side="right")  # neighbours of the ball
            for j, far in zip(self.order[h][:near], apart[:near], strict=True):
                ball = ball[4 * own[ball] >= far]  # outside the stable core, in rings that reach j
                d = ((parts[ball] - self.entries[j]) ** 2).sum(1)
                spent += len(ball)
                closer = (d < best[ball]) | ((d == best[ball]) & (j < entry[ball]))
                entry[ball[closer]], best[ball[closer]] = j, d[closer]
        return entry, best, spent

    def full(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by all distances: for parts that no entry holds yet."""
        entry, best = np.zeros(len(parts), np.int64), np.full(len(parts), FAR)
        for j, e in enumerate(self.entries):
            d = ((parts - e) ** 2).sum(1)
            closer = d < best
            entry[closer], best[closer] = j, d[closer]
        return entry, best


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 x) of each component; the product with a power of two is exact in double precision."""
    out = np.floor(values.astype(np.float64) * SCALE)
    if len(out) and np.abs(out).max(initial=0) >= LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} and more are not supported")
    return out.astype(np.int64)


def _usable(vector: Column) -> Column:
    return F.coalesce(F.size(vector) >= 0, F.lit(False)) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Arrow batches gathered to about ``CHUNK`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield pa.Table.from_batches(held)
            held = []
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _parts(quantised: np.ndarray, p: int) -> np.ndarray:
    width = quantised.shape[1] // PARTS
    return quantised[:, p * width : (p + 1) * width].astype(np.int64)


def _batches(columns: dict[str, object], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns, schema=schema).to_batches(max_chunksize=2048)


def _assigned(vectors: np.ndarray, homes: np.ndarray | None, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray, int]:
    codes, error, spent = np.zeros((len(vectors), PARTS), np.int64), np.zeros(len(vectors), np.int64), 0
    for p, book in enumerate(books):
        if homes is None:
            codes[:, p], d = book.full(_parts(vectors, p))
            used = len(vectors) * len(book.entries)
        else:
            codes[:, p], d, used = book.nearest(_parts(vectors, p), homes[:, p].astype(np.int64))
        error += d
        spent += used
    return codes, error, spent


def _stored(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """``rows`` with their parts' entries by ``books``, to be written. Rows come as floats first, later as integers."""
    first = "homes" not in rows.columns
    schema = T.StructType([*[f for f in rows.schema.fields if f.name not in ("vector", "homes")], T.StructField("vector", T.BinaryType()), T.StructField("homes", T.BinaryType())])
    kept = [f.name for f in schema.fields[:-2]]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            if first:
                lists = rows["vector"].combine_chunks()
                flat = integers(lists.flatten().to_numpy(zero_copy_only=False))
                whole = flat.reshape(len(lists), -1) if len(flat) % len(lists) == 0 else flat[:0].reshape(len(lists), 0)
                if whole.shape[1] != books[0].entries.shape[1] * PARTS or set(np.diff(lists.offsets.to_numpy())) != {whole.shape[1]}:
                    raise ValueError("vectors must have equal numbers of components")
            else:
                whole = _matrix(rows["vector"], "<i4")
            codes, _, _ = _assigned(whole, None if first else _matrix(rows["homes"], "u1"), books)
            columns = {c: rows[c] for c in kept}
            columns["vector"] = pa.array([r.tobytes() for r in whole.astype("<i4")], pa.binary())
            columns["homes"] = pa.array([r.tobytes() for r in codes.astype("u1")], pa.binary())
            yield from pa.table(columns).to_batches(max_chunksize=2048)

    return rows.mapInArrow(store, schema)


SUMS = "part int, entry int, rows long, moved long, spent long, sums array<long>"


def _sums(table: DataFrame, books: list[Codebook], as_stored: bool) -> dict[tuple[int, int], tuple]:
    """By part position and entry: rows, parts elsewhere than stored, distances computed, and sums of components.

    A task adds up its own rows and sends one row for each position and entry, which Spark sums: the driver gets 128 rows.
    ``as_stored`` takes the entries that the table was just written with.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros_like(b.entries) for b in books]
        rows, moved, spent = (np.zeros((PARTS, ENTRIES), np.int64) for _ in range(3))
        for chunk in _chunks(batches):
            vectors, homes = _matrix(chunk["vector"], "<i4"), _matrix(chunk["homes"], "u1").astype(np.int64)
            for p, book in enumerate(books):
                parts = _parts(vectors, p)
                entry, used = homes[:, p], 0
                if not as_stored:
                    entry, _, used = book.nearest(parts, homes[:, p])
                np.add.at(total[p], entry, parts)
                rows[p] += np.bincount(entry, minlength=ENTRIES)
                moved[p] += np.bincount(entry[entry != homes[:, p]], minlength=ENTRIES)
                spent[p, 0] += used
        found = [(p, e) for p, b in enumerate(books) for e in range(len(b.entries)) if rows[p, e] or spent[p, e]]
        columns = {"part": [p for p, _ in found], "entry": [e for _, e in found]}
        columns |= {name: [int(x[k]) for k in found] for name, x in (("rows", rows), ("moved", moved), ("spent", spent))}
        columns["sums"] = [total[p][e].tolist() for p, e in found]
        kinds = [("part", pa.int32()), ("entry", pa.int32()), ("rows", pa.int64()), ("moved", pa.int64()), ("spent", pa.int64()), ("sums", pa.list_(pa.int64()))]
        yield from _batches(columns, pa.schema(kinds))

    told = table.select("vector", "homes").mapInArrow(add, SUMS)
    width = books[0].entries.shape[1]
    by_place = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = told.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("rows", "moved", "spent")], *by_place).collect()
    return {(r.part, r.entry): (r.rows, r.moved, r.spent, [int(r[f"s{i}"]) for i in range(width)]) for r in rows}


def _moved_on(books: list[Codebook], sums: dict) -> list[Codebook]:
    """Each entry becomes the floor of the mean of its parts; an entry without parts stays."""
    out = []
    for p, book in enumerate(books):
        entries = book.entries.copy()
        for e in range(len(entries)):
            rows, _, _, total = sums.get((p, e), (0, 0, 0, None))
            if rows:
                entries[e] = [x // rows for x in total]
        out.append(Codebook(entries))
    return out


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components as decimal numbers, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for e in b.entries.tolist() for x in e).encode()).hexdigest()


def fit(vectors: DataFrame, id_col: str, vector_col: str, *, rounds: int = ROUNDS, entries: int = ENTRIES, keep: tuple[str, ...] = (), rewrite: float = REWRITE) -> tuple[DataFrame | None, list[Codebook], list[dict]]:
    """(stored vectors, codebooks, a report for each round): ``rounds`` rounds from the ``entries`` least ids.

    Vectors that are null or hold null or non-finite components are left out. Ids sort null last, then by the vector, so
    repeated ids start entries of their own. Fewer vectors than entries give fewer entries; none give ``(None, [], [])``.
    Vectors must have the same number of components, a multiple of ``PARTS``, else ValueError.
    """
    rows = vectors.select(F.col(id_col).alias("id"), *[F.col(c) for c in keep], F.col(vector_col).alias("vector")).where(_usable(F.col("vector")))
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE))
    seeds = rows.select("id", whole.alias("vector")).orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    if not seeds:
        return None, [], []
    start = integers(np.array([r.vector for r in seeds], np.float64) / SCALE) if len({len(r.vector) for r in seeds}) == 1 else None
    if start is None or start.shape[1] % PARTS:
        raise ValueError(f"vectors must have equal numbers of components, a multiple of {PARTS}")
    books = [Codebook(_parts(start, p)) for p in range(PARTS)]
    table = materialize(_stored(rows, books), "vectors")
    fresh, told = True, []
    for _ in range(rounds):
        sums = _sums(table, books, fresh)
        held = max(1, sum(x[0] for x in sums.values()))
        away = sum(x[1] for x in sums.values()) / held
        told.append({"away": away, "distances": sum(x[2] for x in sums.values()) / held, "rewritten": away > rewrite})
        if away > rewrite:
            old, table = table, materialize(_stored(table, books), "vectors")
            discard(old)
        books, fresh = _moved_on(books, sums), False
    return table, books, told


def encode(table: DataFrame, books: list[Codebook], keep: tuple[str, ...] = ()) -> DataFrame:
    """Per stored vector: ``id``, ``keep``, ``code`` (an index for each part, two hex digits) and ``error``."""
    schema = T.StructType([f for f in table.schema.fields if f.name in ("id", *keep)])
    schema = schema.add("code", "string").add("error", "long")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            codes, error, _ = _assigned(_matrix(rows["vector"], "<i4"), _matrix(rows["homes"], "u1"), books)
            columns = {c: rows[c] for c in schema.names[:-2]}
            columns |= {"code": pa.array([r.tobytes().hex() for r in codes.astype("u1")], pa.string()), "error": pa.array(error, pa.int64())}
            yield from pa.table(columns).to_batches(max_chunksize=2048)

    return table.mapInArrow(coded, schema)


def compress(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id_col``, ``code``, ``error``, ``label_error`` (errors summed over equal labels, nulls together), ``codebooks_sha256``.

    Repeated rows keep a row each; a null id is coded too. A table without usable vectors gives no rows. Further columns
    may have any names.
    """
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(F.concat(F.lit("1"), F.col(label_col).cast("string")), F.lit("0")).alias("label"))
    table, books, _ = fit(own, "id", "vector", keep=("label",))
    out = [F.col("id").alias(id_col), F.col("code"), F.col("error"), F.col("label_error"), F.lit(digest(books)).alias("codebooks_sha256")]
    if table is None:
        return own.where(F.lit(False)).select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).select(*out)
    coded = materialize(encode(table, books, ("label",)), "codes")
    discard(table)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return join_values(coded, materialize(by_label, "label-errors"), "label", "n").select(*out)
