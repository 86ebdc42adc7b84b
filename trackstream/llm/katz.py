"""Katz backoff over stored n-gram tables: order ``n`` backs off to ``n - 1``, down to words and the one unknown word.

Counts are discounted by Good-Turing (Katz's form; counts above ``GT_K`` stay whole) and backoff weights normalise each
context exactly. A ``Model`` is a set of Parquet tables partitioned by hash: words (hash, id, count), and for every order
the n-grams with their counts and the contexts with what their backoff weights need. ``score_texts`` scores any texts from
these tables with Spark joins, one order after the other.

Scoring the corpus itself needs each document's n-grams beside the corpus counts. Joining a row for every token would move
several times the input (README), so documents travel as chunks:

1. Documents become chunks, each with its own word list.
2. Order by order, each chunk sends its distinct n-grams, with its counts of them, to the partition of their context; there
   counts are summed over all chunks, written to the model's table, and answered to each chunk in the order it asked.
3. Per context, answers carry how its successors' counts are made up and the mass that the lower order gives them. So a
   chunk can score its tokens once the corpus-wide counts of counts are known.

A chunk sends an n-gram once however often it occurs. Contexts with a large share of all tokens are dealt over several
partitions by successor. Words are told apart by 64-bit hashes, n-grams by exact ids of their words. Only sums of counts
reach the driver.

The number of messages grows with the square of the corpus, so chunks and partitions would have to grow with its root, and
with them what a task holds. Beyond ``JOINED_TOKENS`` the same counts are therefore made and looked up by plain Spark
aggregations and joins over a row for each token (``fit_joined``): more moves, but no task holds a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from trackstream.llm.common import discard, materialize, new_path, remove

#: Tokens of a chunk, and of the corpus for each partition of counts, at least.
CHUNK_TOKENS = 1_000_000
PART_TOKENS = 1_000_000
#: Tokens for each message from a chunk to a partition, at least, on average.
MESSAGE = 64
#: Tokens up to which documents travel as chunks: there, a million tokens a chunk and partition make messages of ``MESSAGE``.
JOINED_TOKENS = 15_000_000_000
#: Counts up to this one are discounted.
GT_K = 5

END = b" "  # stands for the end of a text; no word has white space
SEED = 42  # Spark's xxhash64
WIDE = np.int64(1 << 32)  # ids are below 2 ** 31
UNKNOWN = -1
#: Passes over the chunks to count n-grams: each moves the n-grams of its share of the partitions, so that this much less
#: lies on disk at a time; every pass builds the chunks' n-grams anew.
PASSES = 3
#: Bytes of a row group. Rows hold up to millions of numbers, and a reader holds up to 4,096 rows of a row group at a time, a
#: number as up to 12 bytes: with row groups of Spark's size, that is whatever a task has written. Writers look at the size of
#: pages and row groups after a hundred rows only, unless told otherwise.
GROUP_BYTES = 4 << 20

CHUNK = "chunk string, kind string, docs array<{id}>, n bigint, stop int, words array<bigint>, seen array<int>, codes_lo array<smallint>, codes_hi array<smallint>, sizes array<int>, learn array<boolean>"
ASKED = "chunk string, bucket int, hashes array<bigint>, contexts array<array<int>>, runs array<int>, wide array<int>, words_lo array<smallint>, words_hi array<smallint>, seen array<int>, lower_lo array<smallint>, lower_hi array<smallint>, values array<double>"
ANSWERED = (
    "chunk string, bucket int, counts array<int>, ids_lo array<smallint>, ids_hi array<smallint>, made array<array<int>>, mass array<double>, told array<int>, whole array<int>, "
    "stats array<bigint>, hashes array<bigint>, grams array<array<int>>, contexts array<array<int>>"
)
SCORED = "doc_id {id}, n_tokens bigint, n_known bigint, base_score double, score double"


def discounts(n: list[int], k: int = GT_K) -> np.ndarray:
    """d[r] for r = 0..k (d[0] unused) from counts of counts n[1..k + 1].

    Where Good-Turing has no valid value (too few data), half a count is taken off instead.
    """
    out = np.ones(k + 1)
    for r in range(1, k + 1):
        d = math.nan
        if n[1] and n[r]:
            tail = (k + 1) * n[k + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail) if tail != 1 else math.nan
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1).astype(np.int64)], 1.0)


class Unigrams:
    """The lowest order: discounted relative frequencies, and the mass of the unknown word."""

    def __init__(self, total: int, distinct: int, n: list[int]):
        self.total, self.distinct, self.d = total, distinct, discounts(n)
        kept = total - sum((1 - self.d[r]) * r * n[r] for r in range(1, GT_K + 1))
        self.scale = 1.0 if kept < total - 1e-9 else total / (total + 1)  # the unknown word always has some mass
        self.unknown = 1.0 - self.scale * kept / total if total else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, self.scale * discounted(counts, self.d) / self.total, self.unknown)


@dataclass
class Plan:
    """What tasks need to know: partitions by order, and the words' and higher orders' discounts found so far."""

    parts: dict[int, int]
    unigrams: Unigrams | None = None
    d: dict[int, np.ndarray] = field(default_factory=dict)


def sizes(tokens: int) -> tuple[int, int]:
    """Tokens of a chunk and of a partition: the constants, or more where messages would get too small."""
    least = math.isqrt(MESSAGE * tokens)
    return max(CHUNK_TOKENS, least), max(PART_TOKENS, least)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of two, in order."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def chunks(docs: DataFrame, train: Column, size: int) -> DataFrame:
    """Rows of about ``size`` tokens of a run of documents: word hashes, ascending, their training counts, and the tokens
    as places in that list; ``stop`` is the place of the end token."""

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = CHUNK.format(id=kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        learn: list[bool] = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []
        index: dict[bytes, int] = {}

        def flush() -> list[pa.RecordBatch]:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in index), np.uint64, len(index))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            flat = rank[np.concatenate(codes)]
            weight = np.repeat(np.array(learn, bool), lengths)
            seen = np.bincount(flat[weight], minlength=len(index)).astype(np.int32)
            row = {"chunk": f"{part}-{number}", "kind": "codes", "docs": ids, "n": len(flat), "stop": int(rank[0]), **_halves("codes", flat)}
            words = {"chunk": row["chunk"], "kind": "words", "words": hashes[order].view(np.int64), "seen": seen}
            return _written([words, row | {"sizes": np.array(lengths), "learn": np.array(learn, bool)}], schema).to_batches()

        pending = 0
        for batch in batches:
            for doc_id, text, used in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "train")), strict=True):
                if not ids:
                    index = {END: 0}
                words = text.encode().lower().split()
                new = [w for w in dict.fromkeys(words) if w not in index]
                index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
                code = np.empty(len(words) + 1, np.int32)
                code[:-1] = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
                code[-1] = 0
                ids.append(doc_id)
                learn.append(used)
                lengths.append(len(code))
                codes.append(code)
                pending += len(code)
                if pending >= size:
                    yield from flush()
                    number, pending = number + 1, 0
                    ids, learn, lengths, codes = [], [], [], []
        if ids:
            yield from flush()

    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    return rows.mapInArrow(encode, schema)


class Order:
    """A chunk's distinct n-grams of one order and the partitions that count them. Built alike whenever it is needed."""

    def __init__(self, n: int, context: np.ndarray, members: np.ndarray, chunk: Chunk, held: np.ndarray, parts: int, share: int, of: int):
        self.n, self.context, self.members, self.held = n, context, members, held
        self.keys = chunk.ids[members].astype(np.int32)
        key = np.zeros(len(members), np.uint64)
        for column in self.keys.T:
            key = mix(key, column.astype(np.uint64))
        # a context with a large share of the tokens is dealt over several partitions
        self.spread = np.minimum(parts, 1 + held * 4 * parts // max(chunk.total, 1))
        first = (key % np.uint64(parts)).astype(np.int64)

        def bucket_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            salt = mix(chunk.ids[right].astype(np.uint64), key[left]) % self.spread[left].astype(np.uint64)
            return (first[left] + salt.astype(np.int64)) % parts

        tokens = slice(None) if of == 1 else np.flatnonzero(bucket_of(context, chunk.codes) % of == share)
        width = len(chunk.ids)
        grams, self.place = np.unique(context[tokens].astype(np.int64) * width + chunk.codes[tokens], return_inverse=True)
        self.left, self.right = grams // width, grams % width
        self.seen = np.bincount(self.place, chunk.learn[tokens], len(grams)).astype(np.int32)
        self.low = np.empty(len(grams), np.int64)  # each n-gram without its first word, among those of the order below
        self.low[self.place] = (chunk.orders[-1].place if chunk.orders else chunk.codes)[tokens]
        bucket = bucket_of(self.left, self.right)
        self.order = np.argsort(bucket, kind="stable")  # by partition, context, successor
        self.ends = np.searchsorted(bucket[self.order], np.arange(parts + 1))
        self.wide: dict[int, list[int]] = {}
        for h in np.flatnonzero(self.spread > 1):
            for s in range(self.spread[h]):
                self.wide.setdefault(int((first[h] + s) % parts), []).append(int(h))

    def asked(self, share: int = 0, of: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(partition, its n-grams, its contexts): wide contexts are asked for even where no successor is."""
        for b in range(share, len(self.ends) - 1, of):
            own = self.order[self.ends[b] : self.ends[b + 1]]
            contexts = np.union1d(self.left[own], np.array(self.wide.get(b, []), np.int64))
            if len(contexts):
                yield b, own, contexts

    def answered(self, told: dict[int, dict], plan: Plan, lower: np.ndarray) -> None:
        """Counts and probabilities of the n-grams from the partitions' answers and the order below."""
        self.count, total = np.zeros(len(self.left), np.int64), self.held  # a context is followed as often as it occurs
        made, mass = np.zeros((GT_K + 1, len(self.members)), np.int64), np.zeros(len(self.members))
        whole, known = (np.zeros(len(self.members), bool) for _ in range(2))
        for bucket, own, contexts in self.asked():
            row = told[bucket]
            self.count[own] = row["counts"]
            at = contexts[row["told"]]
            known[at], whole[contexts[row["whole"]]] = True, True
            for r, column in enumerate(row["made"]):
                made[r, at] += column
            mass[at] += row["mass"]
        if self.n not in plan.d:
            return
        d = plan.d[self.n]
        whole[known] = made[:-1].sum(0)[known] == 0
        scale = np.where(whole, total / (total + 1.0), 1.0)  # a context of large counts only leaves one count to the unseen
        kept = made[-1] + (d[1:, None] * np.arange(1, GT_K + 1)[:, None] * made[:-1]).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(total > 0, (1.0 - scale * kept / np.maximum(total, 1)) / (1.0 - mass), 1.0)
            seen = scale[self.left] * discounted(self.count, d) / total[self.left]
        self.probability = np.where(self.count > 0, seen, alpha[self.left] * lower[self.low])


class Chunk:
    """A chunk with the answers that it has so far, order by order."""

    def __init__(self, row: dict, answers: list[dict], plan: Plan, share: int = 0, of: int = 1):
        self.stop, self.codes, self.sizes = row["stop"], _whole(row, "codes"), row["sizes"].astype(np.int64)
        self.learn = np.repeat(row["learn"], self.sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.plan, self.total, self.orders = plan, plan.unigrams.total, []
        words = sorted((a for a in answers if a["n"] == 1), key=lambda a: a["bucket"])  # buckets and words both ascend by hash
        self.counts = np.concatenate([a["counts"] for a in words]).astype(np.int64)
        self.ids = np.concatenate([_whole(a, "ids") for a in words])
        self.probability = plan.unigrams.probability(self.counts)
        for n in range(2, max(plan.parts) + 1):
            mine = {a["bucket"]: a for a in answers if a["n"] == n}
            if not mine:
                self.asking = self._order(n, share, of)
                return
            order = self._order(n)
            order.answered(mine, plan, self.orders[-1].probability if self.orders else self.probability)
            self.orders.append(order)

    def _shifted(self, values: np.ndarray, start: int) -> np.ndarray:
        """What stands before each token; ``start`` before a text's first."""
        out = np.empty(len(values), np.int64)
        out[1:] = values[:-1]
        out[self.starts] = start
        return out

    def _order(self, n: int, share: int = 0, of: int = 1) -> Order:
        """The n-grams of an order; of those of every ``of``-th partition only, where that is asked for."""
        before = self._shifted(self.codes, self.stop)  # a text starts after ends
        if n == 2:
            used, context = np.unique(before, return_inverse=True)
            members, held = used[:, None], self.counts[used]
        else:
            last, width = self.orders[-1], len(self.ids)
            key = self._shifted(last.context, last.context[self.starts[0]]) * width + before
            used, context = np.unique(key, return_inverse=True)
            members = np.concatenate([last.members[used // width], (used % width)[:, None]], 1)
            held = np.empty(len(used), np.int64)
            held[context] = self._shifted(last.count[last.place], self.counts[self.stop])
        return Order(n, context, members, self, held, self.plan.parts[n], share, of)

    def lower(self, order: Order) -> np.ndarray:
        return (self.orders[-1].probability if self.orders else self.probability)[order.low]

    def scores(self) -> dict[str, np.ndarray]:
        top = self.orders[-1].probability[self.orders[-1].place] if self.orders else self.probability[self.codes]
        base = np.log10((self.counts + 1.0) / (self.total + self.plan.unigrams.distinct + 1.0))
        return {
            "n_tokens": self.sizes,
            "n_known": np.add.reduceat((self.counts > 0).astype(np.int64)[self.codes], self.starts),
            "base_score": np.add.reduceat(base[self.codes], self.starts),
            "score": np.add.reduceat(np.log10(top), self.starts),
        }


def _bucket_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of the unsigned hash."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


_TYPES = {"string": pa.string(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _small_groups() -> dict[str, str]:
    """Options of Parquet's writer for tables of long arrays."""
    return {"parquet.block.size": str(GROUP_BYTES), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def _type(ddl: str) -> pa.DataType:
    if ddl.startswith("array<"):
        return pa.list_(pa.field("element", _type(ddl[6:-1])))
    return _TYPES[ddl] if ddl in _TYPES else to_arrow_type(DataType.fromDDL(ddl))


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Values of one column, lists of numbers being numpy arrays, without a Python object for every number."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    held = [v for v in values if v is not None]
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in values)]).astype(np.int32)
    if pa.types.is_list(kind.value_type):
        inner = _column([x for v in held for x in v], kind.value_type)
    elif held and all(isinstance(v, np.ndarray) for v in held):
        inner = pa.array(np.concatenate(held), kind.value_type, safe=False)
    else:
        inner = pa.array([x for v in held for x in v], kind.value_type)
    return pa.ListArray.from_arrays(pa.array(ends), inner, type=kind, mask=pa.array([v is None for v in values], pa.bool_()))


def _written(rows: list[dict], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: _column([r.get(name) for r in rows], _type(ddl)) for name, ddl in fields})


def _halves(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers below 2 ** 31 as two columns of 16 bits: most upper halves are 0 and cost next to nothing on disk."""
    return {f"{name}_lo": (values & 0xFFFF).astype(np.uint16).view(np.int16), f"{name}_hi": (values >> 16).astype(np.int16)}


def _whole(row: dict, name: str) -> np.ndarray:
    return row[f"{name}_lo"].view(np.uint16).astype(np.int64) | row[f"{name}_hi"].astype(np.int64) << 16


def _value(x: pa.Scalar):
    if not pa.types.is_list(x.type) or x.values is None:
        return x.as_py()
    if pa.types.is_list(x.values.type):
        return [_value(v) for v in x.values]
    return x.values.to_numpy(zero_copy_only=False) if not x.values.null_count else x.values.to_pylist()


def _read(table: pa.Table | pa.RecordBatch) -> list[dict]:
    """Rows as dicts; lists of numbers are numpy arrays."""
    columns = [[_value(x) for x in table.column(name)] for name in table.schema.names]
    return [dict(zip(table.schema.names, r, strict=True)) for r in zip(*columns, strict=True)]


def ask_words(table: DataFrame, plan: Plan) -> DataFrame:
    """Each chunk's distinct words and training counts, by partition of the word."""
    parts = plan.parts[1]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _read(batch):
                ends = np.searchsorted(_bucket_of(row["words"], parts), np.arange(parts + 1))
                cuts = ((b, slice(ends[b], ends[b + 1])) for b in range(parts) if ends[b] < ends[b + 1])
                told = [{"chunk": row["chunk"], "bucket": b, "hashes": row["words"][own], "seen": row["seen"][own]} for b, own in cuts]
                yield from _written(told, ASKED).to_batches()

    return table.select("chunk", "words", "seen").mapInArrow(ask, ASKED)


def _histogram(counts: np.ndarray) -> list[int]:
    """Sum, number, and counts of counts 1 to GT_K + 1."""
    seen = counts[counts > 0]
    return [int(seen.sum()), len(seen), *(int((seen == r).sum()) for r in range(1, GT_K + 2))]


def answer_words(asked: DataFrame, plan: Plan) -> DataFrame:
    """Corpus count and id of each word asked for, and one row a partition for the model. Frequent words have small ids."""
    parts = plan.parts[1]

    def answer(group: pa.Table) -> pa.Table:
        asks = _read(group.select(["chunk", "bucket", "hashes", "seen"]))
        keys, place = np.unique(np.concatenate([a["hashes"] for a in asks]), return_inverse=True)
        total = np.bincount(place, np.concatenate([a["seen"] for a in asks]), len(keys)).astype(np.int64)
        bucket, rows, at = asks[0]["bucket"], [], 0
        ids = np.empty(len(keys), np.int64)
        ids[np.argsort(-total, kind="stable")] = np.arange(len(keys)) * parts + bucket
        if len(keys) and (len(keys) - 1) * parts + bucket >= 1 << 31:
            raise OverflowError("more distinct words than 31-bit ids; lower JOINED_TOKENS")
        for a in asks:
            own = place[at : at + len(a["hashes"])]
            rows.append({"chunk": a["chunk"], "bucket": bucket, "counts": total[own], **_halves("ids", ids[own])})
            at += len(own)
        rows.append({"chunk": "", "bucket": bucket, "hashes": keys, **_halves("ids", ids), "counts": total, "stats": _histogram(total)})
        return _written(rows, ANSWERED)

    return asked.groupBy("bucket").applyInArrow(answer, ANSWERED)


def _of_chunk(table: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    told = answers.where("chunk != ''").select("chunk", "n", "bucket", "counts", "ids_lo", "ids_hi", "told", "made", "mass", "whole")
    return table.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


def ask_grams(table: DataFrame, answers: DataFrame, plan: Plan, share: int = 0, of: int = 1) -> DataFrame:
    """Each chunk's distinct n-grams of the next order, with what the order below makes of them, by partition of context;
    only those of every ``of``-th partition, from ``share`` on."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in _read(left):
            c = Chunk(row, _read(right), plan, share, of)
            o = c.asking
            distinct, code = np.unique(c.lower(o), return_inverse=True)
            for bucket, own, contexts in o.asked(share, of):
                runs = np.bincount(np.searchsorted(contexts, o.left[own]), minlength=len(contexts)).astype(np.int32)
                used, lower = np.unique(code[own], return_inverse=True)
                more = {"contexts": list(o.keys[contexts].T), "runs": runs, "wide": np.flatnonzero(o.spread[contexts] > 1).astype(np.int32), **_halves("words", c.ids[o.right[own]])}
                rows.append({"chunk": row["chunk"], "bucket": bucket, **more, "seen": o.seen[own], **_halves("lower", lower), "values": distinct[used]})
        return _written(rows, ASKED)

    return _of_chunk(table.select("chunk", "stop", "codes_lo", "codes_hi", "sizes", "learn"), answers, ask, ASKED)


def answer_grams(asked: DataFrame) -> DataFrame:
    """Corpus count of each n-gram asked for; per context, how its successors' counts are made up and their lower mass."""

    def answer(group: pa.Table) -> pa.Table:
        asks = _read(group.drop_columns(["hashes"]))
        members = [np.concatenate([a["contexts"][k] for a in asks]).astype(np.int64) for k in range(len(asks[0]["contexts"]))]
        code = np.zeros(len(members[0]), np.int64)
        for column in members:
            _, first, code = np.unique(code * WIDE + column, return_index=True, return_inverse=True)
        members, n = [m[first] for m in members], len(first)
        context = np.repeat(code, np.concatenate([a["runs"] for a in asks]))
        word = np.concatenate([_whole(a, "words") for a in asks])
        grams, at, place = np.unique(context * WIDE + word, return_index=True, return_inverse=True)
        total = np.bincount(place, np.concatenate([a["seen"] for a in asks]), len(grams)).astype(np.int64)
        lower = np.concatenate([a["values"][_whole(a, "lower")] for a in asks])[at]
        seen = np.flatnonzero(total)
        owner, counts = (grams // WIDE)[seen], total[seen]
        made = [np.bincount(owner[counts == r], minlength=n).astype(np.int64) for r in range(1, GT_K + 1)]
        made.append(np.bincount(owner[counts > GT_K], counts[counts > GT_K], n).astype(np.int64))
        mass = np.bincount(owner, lower[seen], n)
        large = sum(made[:-1]) == 0  # contexts without a small count
        bucket, rows, i, c = asks[0]["bucket"], [], 0, 0
        for a in asks:
            own, of = total[place[i : i + len(a["seen"])]], code[c : c + len(a["runs"])]
            asking = np.zeros(len(of), bool)  # what a backoff weight needs is told where one is needed, and for wide contexts
            asking[np.repeat(np.arange(len(of)), a["runs"])[own == 0]] = True
            asking[a["wide"]] = True
            at = np.flatnonzero(asking)
            whole = np.flatnonzero(large[of] & ~asking)
            rows.append({"chunk": a["chunk"], "bucket": bucket, "counts": own, "told": at, "made": [m[of[at]] for m in made], "mass": mass[of[at]], "whole": whole})
            i, c = i + len(own), c + len(of)
        table = [*(m[owner] for m in members), (grams % WIDE)[seen]]
        rows.append({"chunk": "", "bucket": bucket, "counts": counts, "grams": table, "contexts": members, "made": made, "mass": mass, "stats": _histogram(total)})
        return _written(rows, ANSWERED)

    return asked.groupBy("bucket").applyInArrow(answer, ANSWERED)


@dataclass
class Model:
    """The stored tables of a fitted corpus, and the discounts of each order."""

    order: int
    tables: dict[int, DataFrame]
    unigrams: Unigrams
    d: dict[int, np.ndarray]

    def words(self) -> DataFrame:
        """(hash, id, count) of every word; the count is 0 for words outside the training documents."""
        columns = F.arrays_zip("hashes", "ids_lo", "ids_hi", "counts")
        rows = self.tables[1].where("chunk = ''").select(F.inline(columns)).toDF("hash", "lo", "hi", "count")
        return rows.select("hash", (F.col("hi").cast("int") * 65536 + F.pmod(F.col("lo").cast("int"), F.lit(65536))).alias("id"), "count")

    def grams(self, n: int) -> DataFrame:
        """(w1, ..., wn, count) of every n-gram of the training documents, words by id."""
        columns = [F.col("grams")[k] for k in range(n)]
        return self.tables[n].where("chunk = ''").select(F.inline(F.arrays_zip(*columns, "counts"))).toDF(*[f"w{k + 1}" for k in range(n)], "count")

    def context_sums(self, n: int) -> DataFrame:
        """(w1, ..., w<n-1>, made1, ..., mass) of every context of order ``n``: how its successors' counts are made up (the
        last: the sum of larger counts), and the lower order's mass of its successors."""
        keys = [f"w{k + 1}" for k in range(n - 1)]
        made = [f"made{r}" for r in range(1, GT_K + 2)]
        columns = [*(F.col("contexts")[k] for k in range(n - 1)), *(F.col("made")[r] for r in range(GT_K + 1)), "mass"]
        rows = self.tables[n].where("chunk = ''").select(F.inline(F.arrays_zip(*columns))).toDF(*keys, *made, "mass")
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*made, "mass")])  # a wide context has several rows

    def contexts(self, n: int) -> DataFrame:
        """(w1, ..., w<n-1>, total, scale, backoff) of every context of order ``n``."""
        keys = [f"w{k + 1}" for k in range(n - 1)]
        made = [f"made{r}" for r in range(1, GT_K + 2)]
        sums = self.context_sums(n)
        small = sum((F.col(m) for m in made[:-1]), F.lit(0))
        total = sum((r * F.col(m) for r, m in enumerate(made[:-1], 1)), F.col(made[-1]))
        kept = sum((float(self.d[n][r]) * r * F.col(m) for r, m in enumerate(made[:-1], 1)), F.col(made[-1]))
        parts = sums.withColumns({"total": total, "kept": kept}).where("total > 0")
        parts = parts.withColumn("scale", F.when(small > 0, F.lit(1.0)).otherwise(F.col("total") / (F.col("total") + 1.0)))
        return parts.select(*keys, "total", "scale", ((1.0 - F.col("scale") * F.col("kept") / F.col("total")) / (1.0 - F.col("mass"))).alias("backoff"))

    def discounted(self, n: int, count: Column) -> Column:
        out = count.cast("double")
        for r in range(1, GT_K + 1):
            out = F.when(count == r, F.lit(float(r * (self.unigrams.d if n == 1 else self.d[n])[r]))).otherwise(out)
        return out


class JoinedModel(Model):
    """A model whose tables are rows: words (hash, id, count), where the id is the hash, and n-grams (w1, ..., wn, count)."""

    def words(self) -> DataFrame:
        return self.tables[1]

    def grams(self, n: int) -> DataFrame:
        return self.tables[n]

    def context_sums(self, n: int) -> DataFrame:
        keys, lower = [f"w{k + 1}" for k in range(n - 1)], [f"w{k + 1}" for k in range(1, n)]
        if n == 2:
            p = self.unigrams.scale * self.discounted(1, F.col("below")) / max(self.unigrams.total, 1)
            below = self.words().select(F.col("id").alias("w2"), F.col("count").alias("below")).withColumn("p", p)
        else:
            held = self.contexts(n - 1).toDF(*lower[:-1], "total", "scale", "backoff")
            below = self.grams(n - 1).toDF(*lower, "below").join(held, lower[:-1]).withColumn("p", F.col("scale") * self.discounted(n - 1, F.col("below")) / F.col("total"))
        made = [F.count_if(F.col("count") == r).alias(f"made{r}") for r in range(1, GT_K + 1)]
        large = F.coalesce(F.sum(F.when(F.col("count") > GT_K, F.col("count"))), F.lit(0)).alias(f"made{GT_K + 1}")
        return self.grams(n).join(below.select(*lower, "p"), lower).groupBy(*keys).agg(*made, large, F.sum("p").alias("mass"))


def _windows(docs: DataFrame, text_col: str, n: int, *more: Column) -> DataFrame:
    """``more`` and the hashes h1, ..., hn of each token and the n - 1 before it; a text starts after ends, and has one."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    end = F.xxhash64(F.lit(END.decode()))
    words = F.transform(F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    rows = docs.select(*more, F.concat(F.array_repeat(end, n - 1), words, F.array(end)).alias("h"))
    at = F.explode(F.transform(F.sequence(F.lit(1), F.size("h") - (n - 1)), lambda i: F.slice("h", i, n)))
    names = rows.columns[:-1]
    return rows.select(*names, at.alias("h")).select(*names, *[F.col("h")[k].alias(f"h{k + 1}") for k in range(n)])


def fit_joined(docs: DataFrame, id_col: str, text_col: str, train: Column, order: int = 2) -> JoinedModel:
    """The model of ``fit``, counted by aggregations with partial sums in each task, whatever the size of the corpus."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("train", F.coalesce(train, F.lit(False)).cast("long"))
    keys = [f"h{k + 1}" for k in range(order)]
    top = materialize(_windows(rows, "text", order, F.col("train")).groupBy(*keys).agg(F.sum("train").alias("count")), f"katz-rows-{order}")
    tables: dict[int, DataFrame] = {}
    for n in range(order, 0, -1):
        counted = top if n == order else materialize(top.groupBy(*keys[order - n :]).agg(F.sum("count").alias("count")), f"katz-rows-{n}")
        tables[n] = counted.toDF(*[f"w{k + 1}" for k in range(n)], "count")
    stats = {}
    for n, rows in tables.items():
        stats[n] = [int(x or 0) for x in rows.agg(F.sum("count"), F.count_if(F.col("count") > 0), *[F.count_if(F.col("count") == r) for r in range(1, GT_K + 2)]).first()]
        tables[n] = rows.select(F.col("w1").alias("hash"), F.col("w1").alias("id"), "count") if n == 1 else rows.where("count > 0")
    total, distinct, *counts = stats[1]
    return JoinedModel(order, tables, Unigrams(total, distinct, [0, *counts]), {n: discounts([0, *stats[n][2:]]) for n in range(2, order + 1)})


def _fit(docs: DataFrame, id_col: str, text_col: str, train: Column, order: int) -> tuple[Model, DataFrame, DataFrame, Plan]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    guess = int(rows.agg(F.sum(F.length("text") / 6 + 1)).first()[0] or 0)
    made, path = chunks(rows, train, sizes(guess)[0]), new_path(docs.sparkSession, "katz-chunks")
    made.write.options(**_small_groups()).partitionBy("kind").parquet(path)
    kept = {kind: docs.sparkSession.read.schema(made.schema).parquet(f"{path}/kind={kind}").drop("kind") if guess else made.where(F.lit(False)).drop("kind") for kind in ("words", "codes")}
    table = kept["codes"]
    tokens = table.agg(F.sum("n")).first()[0] or 0
    parts = int(tokens // sizes(tokens)[1]) + 1
    plan = Plan({1: parts // 4 + 1})
    tables: dict[int, DataFrame] = {}
    answers = None
    for n in range(1, order + 1):
        if n == 1:
            made = [answer_words(ask_words(kept["words"], plan), plan)]
        else:
            plan.parts[n] = parts
            made = [answer_grams(ask_grams(table, answers, plan, share, PASSES)) for share in range(PASSES)]
        for share in made:
            one = materialize(share.withColumn("n", F.lit(n)), f"katz-{n}", **_small_groups())
            tables[n] = tables[n].unionByName(one) if n in tables else one
        answers = tables[n] if answers is None else answers.unionByName(tables[n])
        total, distinct, *counts = _sums(tables[n])
        if n == 1:
            plan.unigrams = Unigrams(total, distinct, [0, *counts])
            remove(docs.sparkSession, f"{path}/kind=words")  # places in a chunk's list are enough from here on
        else:
            plan.d[n] = discounts([0, *counts])
    return Model(order, tables, plan.unigrams, plan.d), table, answers, plan


def _sums(answers: DataFrame) -> list[int]:
    stats = answers.where("chunk = ''").agg(*[F.sum(F.col("stats")[i]) for i in range(GT_K + 3)]).first()
    return [int(x or 0) for x in stats]


def fit(docs: DataFrame, id_col: str, text_col: str, train: Column, order: int = 2) -> Model:
    """The tables of the rows of ``docs`` where ``train`` holds; see ``score`` for tokens, nulls and repeated rows."""
    model, table, _, _ = _fit(docs, id_col, text_col, train, order)
    discard(table)
    return model


def score(docs: DataFrame, id_col: str, text_col: str, train: Column, order: int = 2) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10), learned where ``train`` holds.

    Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end a text; ends are also the context of a
    text's first tokens. Null and empty texts are an end alone. All unseen words are one unknown word. ``train`` may use
    ``doc_id``; where it is null, a row is scored but not learned from. Repeated rows count and are scored each. An empty
    table gives no rows. Only id and text are used, so other columns may have any names.
    """
    if (docs.agg(F.sum(F.length(F.col(text_col)) / 6 + 1)).first()[0] or 0) > JOINED_TOKENS:
        model = fit_joined(docs, id_col, text_col, train, order)
        scored = score_texts(model, docs, id_col, text_col).select("doc_id", "n_tokens", "n_known", "base_score", "score")
        return scored.withColumn("train_tokens", F.lit(model.unigrams.total).cast("long"))
    model, table, answers, plan = _fit(docs, id_col, text_col, train, order)
    kind = table.schema["docs"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = _read(right)
        found = [Chunk(row, told, plan).scores() for row in _read(left.drop_columns(["docs"]))]
        ids = pa.concat_arrays([x.values for x in left.column("docs")]).cast(_type(kind))
        return pa.table({"doc_id": ids, **{c: np.concatenate([f[c] for f in found]) for c in found[0]}})

    scored = _of_chunk(table.drop("n", "words", "seen"), answers, run, SCORED.format(id=kind))
    return scored.withColumn("train_tokens", F.lit(model.unigrams.total).cast("long"))


def score_texts(model: Model, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of any texts from the model's tables, by joins, one order after the other.

    Each row of ``docs`` is scored, repeated ones too; nulls and empty texts as in ``score``.
    """
    n = model.order
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "katz-texts")
    tokens = _windows(rows, "text", n, F.col("doc_id"), F.col("row"))
    known = model.words().where("count > 0")
    for k in range(1, n + 1):
        tokens = tokens.join(known.select(F.col("hash").alias(f"h{k}"), F.col("id").alias(f"t{k}"), F.col("count").alias(f"c{k}")), f"h{k}", "left")
        tokens = tokens.withColumn(f"t{k}", F.coalesce(f"t{k}", F.lit(UNKNOWN))).drop(f"h{k}", *([f"c{k}"] if k < n else []))
    count = F.col(f"c{n}")
    u = model.unigrams
    p = F.when(count > 0, u.scale * model.discounted(1, count) / max(u.total, 1)).otherwise(F.lit(float(u.unknown)))
    base = F.log10((F.coalesce(count, F.lit(0)) + 1.0) / (u.total + u.distinct + 1.0))
    tokens = tokens.withColumns({"known": (F.coalesce(count, F.lit(0)) > 0).cast("long"), "base": base, "p": p}).drop(f"c{n}")
    for m in range(2, n + 1):
        names = [f"t{n - m + 1 + k}" for k in range(m)]
        grams = model.grams(m).toDF(*names, "count")
        contexts = model.contexts(m).toDF(*names[:-1], "total", "scale", "backoff")
        tokens = tokens.join(contexts, names[:-1], "left").join(grams, names, "left")
        seen = F.col("scale") * model.discounted(m, F.col("count")) / F.col("total")
        tokens = tokens.withColumn("p", F.when(F.col("count") > 0, seen).otherwise(F.coalesce("backoff", F.lit(1.0)) * F.col("p"))).drop("total", "scale", "backoff", "count")
    sums = tokens.groupBy("row", "doc_id").agg(F.count("*").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum(F.log10("p")).alias("score"))
    return sums.drop("row")
