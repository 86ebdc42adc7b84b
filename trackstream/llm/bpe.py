"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

Each distinct piece of a batch is one row of a padded id matrix in the bucket of its length. In every round each
row merges its leftmost pair of least rank; pair ranks come from a hashed table, and rows without a mergeable pair
leave the matrix (compaction). Spark deals the documents out; a task holds one Arrow batch and a bounded piece cache.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this are merged one by one with a heap, in n log n; a matrix row would take n * n steps.
MATRIX_BYTES = 1024
#: Pieces remembered by a task before it starts its cache anew.
CACHE_PIECES = 150_000
#: Characters of text handled at a time within an Arrow batch.
SLICE_CHARS = 1_000_000


class PairTable:
    """Open-addressing hash table from (left id, right id) to the id of the merged token."""

    def __init__(self, tokens: list[bytes], rank: dict[bytes, int]):
        keys, values = [], []
        for token, merged in rank.items():
            for cut_at in range(1, len(token)):
                a, b = rank.get(token[:cut_at]), rank.get(token[cut_at:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(merged)
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        slot, self.probes = self._slot(keys), 0
        while len(keys):  # insert all at once; who loses a slot tries the next
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids (NONE where the pair does not merge); negative ids are padding and never match."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        keys[(left < 0).ravel() | (right < 0).ravel()] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(shape)


class Vocabulary:
    """Ranks of a ``.tiktoken`` file: one base64 token and its rank a line."""

    def __init__(self, ranks_path: str, pattern: str):
        self.rank: dict[bytes, int] = {}
        with open(ranks_path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, number = line.split()
                    self.rank[base64.b64decode(token)] = int(number)
        size = max(self.rank.values()) + 1
        tokens = [b""] * size
        for token, number in self.rank.items():
            tokens[number] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        self._tokens, self._pairs = tokens, None

    @property
    def pairs(self) -> PairTable:
        if self._pairs is None:
            self._pairs = PairTable(self._tokens, self.rank)
        return self._pairs

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has (a piece that is itself a token is that token)."""
        whole = np.array([-1 if x is None else x for x in map(self.rank.get, pieces)], np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width_of = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        width_of[whole >= 0] = 1
        width_of[(whole < 0) & (sizes > MATRIX_BYTES)] = 0
        counts = np.ones(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(width_of):
            rows = np.flatnonzero(width_of == width)
            if width == 1:
                parts.append((rows, whole[rows, None].astype(np.int32)))
            elif width == 0:
                for row in rows:
                    ids = self._merge_long(pieces[row])
                    counts[row] = len(ids)
                    parts.append((rows[rows == row], ids[None]))
            else:
                for some in np.array_split(rows, 1 + len(rows) * int(width) // 2_000_000):
                    matrix, counts[some] = self._merge_matrix([pieces[i] for i in some], sizes[some], int(width))
                    parts.append((some, matrix))
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for rows, matrix in parts:
            columns = np.arange(matrix.shape[1])
            used = columns < counts[rows][:, None]
            flat[(starts[rows][:, None] + columns)[used]] = matrix[used]
        return flat, counts

    def _merge_matrix(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        columns, sizes = np.arange(width), sizes.copy()
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[columns < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.lookup(ids[:, :-1], ids[:, 1:])
        done, at = np.empty_like(ids), np.arange(len(pieces))
        while len(at):
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), j]
            live = best != NONE
            if not live.all():
                done[at[~live]] = ids[~live]
                ids, ranks, at, j, best = ids[live], ranks[live], at[live], j[live], best[live]
                if not len(at):
                    break
            rows = np.arange(len(at))
            sizes[at] -= 1
            take = np.minimum(columns + (columns > j[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, axis=1)
            ids[rows, j] = best
            ids[rows, sizes[at]] = -1
            ranks = np.take_along_axis(ranks, take[:, : width - 1].clip(max=width - 2), axis=1)
            ranks[:, -1] = NONE
            ranks[rows, np.minimum(sizes[at], width - 2)] = NONE
            right = np.where(j + 1 < width, ids[rows, np.minimum(j + 1, width - 1)], -1)
            ranks[rows, np.minimum(j, width - 2)] = self.pairs.lookup(best, right)
            inner = np.flatnonzero(j > 0)
            if len(inner):
                ranks[inner, j[inner] - 1] = self.pairs.lookup(ids[inner, j[inner] - 1], best[inner])
        return done, sizes

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        first = self.pairs.lookup(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        merged = self._one_pair
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            k = after[i]
            if ids[i] != a or k >= len(ids) or ids[k] != b:
                continue
            ids[i], ids[k] = rank, -1
            after[i] = after[k]
            if after[k] < len(ids):
                before[after[k]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (r := merged(ids[left], ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _one_pair(self, a: int, b: int) -> int | None:
        return self.rank.get(self._tokens[a] + self._tokens[b])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, gathered from the one token buffer."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.buffer[np.arange(ends[-1]) + shift].tobytes()


@lru_cache(maxsize=4)
def vocabulary(ranks_path: str, pattern: str) -> Vocabulary:
    """One vocabulary a Python worker."""
    return Vocabulary(ranks_path, pattern)


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Encoder:
    """Encodes batches of texts; pieces seen before come from a cache of bounded size."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._reset()

    def _reset(self) -> None:
        self.index = _Numbered()
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.counts = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        flat, counts = self.vocab.encode_pieces([p.encode() for p in pieces])
        base, known = len(self.index) - len(pieces), len(self.index)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(self.used + len(flat), np.int32)])
        if known > len(self.starts):
            more = np.empty(known, np.int64)
            self.starts, self.counts = np.concatenate([self.starts, more]), np.concatenate([self.counts, more])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[base:known] = self.used + np.cumsum(counts) - counts
        self.counts[base:known] = counts
        self.used += len(flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= SLICE_CHARS:
                out += self._encode(some)
                some, size = [], 0
        return out + (self._encode(some) if some else [])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > CACHE_PIECES:
            self._reset()
        split, known = self.vocab.split, len(self.index)
        pieces: list[str] = []
        ends = []
        for text in texts:
            pieces += split(text)
            ends.append(len(pieces))
        k = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if len(self.index) > known:
            self._learn(list(islice(reversed(self.index), len(self.index) - known))[::-1])
        counts = self.counts[k]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.starts[k] - total[:-1], counts)]
        return np.split(ids, total[ends[:-1]])


def encode(text: Column, ranks_path: str, pattern: str) -> Column:
    """``array<int>`` of token ids, without special tokens. A null or empty text gives no ids."""

    @F.pandas_udf("array<int>")
    def encode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary(ranks_path, pattern))
        for batch in batches:
            yield pd.Series(encoder.encode([t or "" for t in batch]), dtype=object)

    return encode_batches(text)


def decode(ids: Column, ranks_path: str, pattern: str) -> Column:
    """``binary`` of an array of token ids. No ids, or null, give no bytes."""

    @F.pandas_udf("binary")
    def decode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(ranks_path, pattern)
        for batch in batches:
            yield pd.Series([b"" if x is None else vocab.decode(np.asarray(x, np.int64)) for x in batch], dtype=object)

    return decode_batches(ids)


def with_tokens(docs: DataFrame, text_col: str, ranks_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """``docs`` and its ids; a column of the name ``ids_col`` is replaced, all others pass through."""
    return docs.withColumn(ids_col, encode(F.col(text_col), ranks_path, pattern))


def with_decoded(docs: DataFrame, ids_col: str, ranks_path: str, pattern: str, out_col: str = "decoded") -> DataFrame:
    """``docs`` and the bytes that its ids stand for; a column of the name ``out_col`` is replaced."""
    return docs.withColumn(out_col, decode(F.col(ids_col), ranks_path, pattern))


def digests(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: number of ids, and SHA-256 of the ids' decimal text and of the decoded bytes.

    A null or empty text has no ids and decodes to nothing. Repeated rows give repeated results; a null id stays null; an
    empty table gives no rows. Of pairs of equal rank in a piece, the leftmost merges first.
    """
    both = with_decoded(with_tokens(docs, text_col, ranks_path, pattern, "_ids"), "_ids", ranks_path, pattern, "_bytes")
    ids = F.col("_ids")
    return both.select(
        F.col(id_col),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("_bytes"), 256).alias("decoded_sha256"),
    )
