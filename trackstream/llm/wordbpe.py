"""BPE with word ends by speculation and verification.

A word is a row of symbols (bytes, the last one marked as word end). Greedy longest match proposes its tokens. A sequence
of tokens is what the merges give exactly if each token merges to itself and each adjacent pair is compatible, that is, if
no merge across the border of the two comes before the merges that close them off. All pairs of a batch of distinct words
are tested at once in numpy: the borders of a pair are walked back through the merges that made its tokens. Only words with
an incompatible pair are merged exactly. Spark deals the documents out; a task holds an Arrow batch and a bounded cache.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackstream.llm.bpe import Encoder

NEVER = np.int64(2**62)
#: Cells of a padded matrix of words; longer buckets are cut into several matrices.
CELLS = 2_000_000
#: Failing words in matrices wider than this merge one by one with a heap, in n log n.
HEAP_WIDTH = 256
#: White space that ends a word: the property of Unicode, without the ASCII separators 1C to 1F.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable ones as they are, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


class Lookup:
    """Exact map from non-negative 64-bit keys to numbers, over arrays; ``missing`` where there is none."""

    def __init__(self, found: dict[int, int], missing: int):
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.missing = missing

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.missing)


class WordVocabulary:
    """Tokens, merges, word end and special tokens of a tokenizer file; ``split`` and ``encode_pieces`` serve an Encoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            told = json.load(lines)
        model, end = told["model"], told["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, number in [*vocab.items(), *self.special.items()]:
            self.tokens[number] = token
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        # the one merge that makes a token: its two parts, and its rank; letters have none
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank, self.merged = np.full(size, -1, np.int64), {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            made = vocab[self.tokens[a] + self.tokens[b]]
            if self.rank[made] >= 0 or max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError("each token must be made by one merge, of tokens made before it")
            self.left[made], self.right[made], self.rank[made] = a, b, rank
            self.merged[a, b] = (rank, made)
        self.made = np.array([made for _, made in self.merged.values()], np.int64)  # by rank
        self.pair_rank = Lookup({a << 32 | b: rank for (a, b), (rank, _) in self.merged.items()}, int(NEVER))
        self._grow_trie()
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+").findall
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def _grow_trie(self) -> None:
        """Symbols of each token that merges to itself, as steps (node, symbol) to node; a node may stand for a token."""
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        whole = np.ones(len(self.tokens), bool)
        fits = dict(zip(made.tolist(), self.compatible(self.left[made], self.right[made], self.rank[made]).tolist(), strict=True))
        symbols: dict[int, tuple[int, ...]] = {int(s): (int(s),) for s in np.concatenate([self.inner, self.last])}
        for t in made.tolist():
            a, b = int(self.left[t]), int(self.right[t])
            symbols[t] = symbols[a] + symbols[b]
            whole[t] = fits[t] and whole[a] and whole[b]
        steps: dict[int, int] = {}
        token_at = [-1]
        for t, word in symbols.items():
            if not whole[t]:
                continue
            node = 0
            for s in word:
                node = steps.setdefault(node << 32 | s, len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = t
        self.step, self.token_at = Lookup(steps, -1), np.array(token_at, np.int64)
        self.length = np.zeros(len(self.tokens), np.int64)
        for t, word in symbols.items():
            self.length[t] = len(word)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Which pairs of tokens stay two: no merge across their border comes first.

        Walks back in time from the finished tokens: at every moment the border lies between the last part of ``a`` and the
        first part of ``b``; the one that was made later is undone next (of equal tokens the right one). A merge of the two
        happens if its rank is below that of the merge which takes away the left one, and not above that which takes away
        the right one. ``before`` limits the look to merges of lower rank.
        """
        a, b = a.copy(), b.copy()
        end_a = np.full(len(a), NEVER) if before is None else before.copy()
        end_b = end_a.copy() if before is None else before - 1
        fits, at = np.ones(len(a), bool), np.arange(len(a))
        while len(at):
            across = self.pair_rank(a << 32 | b)
            crossed = (across < end_a) & (across <= end_b)
            fits[at[crossed]] = False
            more = ~crossed & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            a, b, end_a, end_b, at = a[more], b[more], end_a[more], end_b[more], at[more]
            undo_a = self.rank[a] > self.rank[b]
            end_a, end_b = np.where(undo_a, self.rank[a], end_a), np.where(undo_a, end_b, self.rank[b])
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return fits

    def split(self, text: str) -> list[str]:
        """Pieces of a text in order: its special tokens as they are, and the words of the normalised rest."""
        if self._special is None:
            return self._words(text)
        out: list[str] = []
        for k, part in enumerate(self._special(text)):
            out += [part] if k % 2 else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a capital sigma has one small form here
        return self._split(text.lower())

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        widths = 1 << np.ceil(np.log2(np.maximum(sizes, 4))).astype(np.int64)
        counts, parts = np.ones(len(pieces), np.int64), []
        special = {s.encode(): i for s, i in self.special.items()}
        for k, piece in enumerate(pieces):
            if piece[:1] == b"<" and piece in special:
                widths[k] = 0
                parts.append((np.array([k]), np.array([special[piece]], np.int64)))
        for width in np.unique(widths[widths > 0]):
            same = np.flatnonzero(widths == width)
            for some in np.array_split(same, 1 + len(same) * int(width) // CELLS):
                flat, counts[some] = self._encode_matrix([pieces[k] for k in some], sizes[some], int(width))
                parts.append((some, flat))
        starts = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        for some, flat in parts:
            own = counts[some]
            ids[np.arange(len(flat)) + np.repeat(starts[some] - (np.cumsum(own) - own), own)] = flat
        return ids, counts

    def _encode_matrix(self, words: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        used = np.arange(width) < sizes[:, None]
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = np.full(used.shape, -1, np.int64)
        symbols[used] = self.inner[raw]
        symbols[np.arange(len(words)), sizes - 1] = self.last[raw[np.cumsum(sizes) - 1]]
        proposed, counts = self._greedy(self._longest(symbols, used), sizes)
        word = np.repeat(np.arange(len(words)), counts)
        left = np.flatnonzero(word[:-1] == word[1:])
        bad = left[~self.compatible(proposed[left], proposed[left + 1])]
        failed = np.zeros(len(words), bool)
        failed[word[bad]] = True
        rows = np.flatnonzero(failed)
        if not len(rows):
            return proposed, counts
        exact, exact_counts = self._merge_matrix(symbols[rows], sizes[rows])
        kept = ~failed[word]
        counts[rows] = exact_counts
        out, word = np.empty(int(counts.sum()), np.int64), np.repeat(np.arange(len(words)), counts)
        out[~failed[word]], out[failed[word]] = proposed[kept], exact
        return out, counts

    def _longest(self, symbols: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place: all places go down the trie together, fewer at every step."""
        width = symbols.shape[1]
        flat, best = symbols.ravel(), np.full(symbols.size, -1, np.int64)
        place = np.flatnonzero(used.ravel())
        room = width - place % width
        node, depth = np.zeros(len(place), np.int64), 0
        while len(place):
            node = self.step(node << 32 | np.maximum(flat[place + depth], 0))
            on = (node >= 0) & (flat[place + depth] >= 0)
            place, room, node = place[on], room[on], node[on]
            token = self.token_at[node]
            best[place[token >= 0]] = token[token >= 0]
            depth += 1
            on = room > depth
            place, room, node = place[on], room[on], node[on]
        return best.reshape(symbols.shape)

    def _greedy(self, longest: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by greedy longest match, word after word, and how many each word has."""
        position, live, taken = np.zeros(len(sizes), np.int64), np.arange(len(sizes)), []
        while len(live):
            token = longest[live, position[live]]
            taken.append((live, token))
            position[live] += self.length[token]
            live = live[position[live] < sizes[live]]
        word = np.concatenate([w for w, _ in taken])
        order = np.argsort(word, kind="stable")
        return np.concatenate([t for _, t in taken])[order], np.bincount(word, minlength=len(sizes))

    def _merge_matrix(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of many words: each round merges every row's leftmost pair of least rank; long words go by a heap."""
        sizes, width = sizes.copy(), ids.shape[1]
        if width > HEAP_WIDTH:
            done = [self.merge(row[:n].tolist()) for row, n in zip(ids, sizes, strict=True)]
            return np.concatenate(done), np.array([len(x) for x in done], np.int64)
        out, at, columns = np.full(ids.shape, -1, np.int64), np.arange(len(ids)), np.arange(width)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(at):
            rows, j = np.arange(len(at)), ranks.argmin(axis=1)
            best = ranks[rows, j]
            on = best < NEVER
            if not on.all():
                out[at[~on]] = ids[~on]
                ids, ranks, at, j, best = ids[on], ranks[on], at[on], j[on], best[on]
                rows = rows[: len(at)]
            ids[rows, j] = self.made[best]
            moved = np.minimum(columns + (columns > j[:, None]), width - 1)
            ids = np.take_along_axis(ids, moved, axis=1)
            ids[:, -1] = -1
            sizes[at] -= 1
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, :-1], width - 2), axis=1)
            ranks[:, -1] = NEVER
            for k in (j - 1, j):
                near = np.flatnonzero((k >= 0) & (k < width - 1))
                ranks[near, k[near]] = self._ranks(ids[near, k[near]], ids[near, k[near] + 1])
        return out[columns < sizes[:, None]], sizes

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((a >= 0) & (b >= 0), self.pair_rank(np.maximum(a, 0) << 32 | np.maximum(b, 0)), NEVER)

    def merge(self, ids: list[int]) -> np.ndarray:
        """Exact merges of a word, least rank first, the leftmost of equal rank."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(m[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.merged.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            k = after[i]
            if ids[i] != a or k >= len(ids) or ids[k] != b:
                continue
            ids[i], ids[k] = self.merged[a, b][1], -1
            after[i] = after[k]
            if after[k] < len(ids):
                before[after[k]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (m := self.merged.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' own texts, special ones too, joined by a space: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordVocabulary:
    """One vocabulary a Python worker."""
    return WordVocabulary(path)


def encode(text: Column, path: str) -> Column:
    """``array<int>`` of token ids; special tokens only where a text spells them. A null or empty text gives no ids."""

    @F.pandas_udf("array<int>")
    def encode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary(path))
        for batch in batches:
            yield pd.Series(encoder.encode([t or "" for t in batch]), dtype=object)

    return encode_batches(text)


def decode(ids: Column, path: str) -> Column:
    """``string`` of an array of token ids. No ids, or null, give an empty text."""

    @F.pandas_udf("string")
    def decode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for batch in batches:
            yield pd.Series(["" if x is None else vocab.decode(x) for x in batch], dtype=object)

    return decode_batches(ids)


def with_tokens(docs: DataFrame, text_col: str, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``docs`` and its ids; a column of the name ``ids_col`` is replaced, all others pass through."""
    return docs.withColumn(ids_col, encode(F.col(text_col), path))


def with_decoded(docs: DataFrame, ids_col: str, path: str, out_col: str = "decoded") -> DataFrame:
    """``docs`` and the text that its ids stand for; a column of the name ``out_col`` is replaced."""
    return docs.withColumn(out_col, decode(F.col(ids_col), path))


def digests(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """Per row: number of ids, and SHA-256 of the ids' decimal text and of the decoded text.

    A null or empty text, and one of white space alone, has no ids and decodes to an empty text. Very long words are rows
    of longer matrices, and merge in n log n where they fail. Repeated rows give repeated results; a null id stays null;
    an empty table gives no rows; other columns may have any names. Of pairs of equal rank in a word, the leftmost merges
    first. Letters that Unicode has added since its version 15 go by the tables of the installed ``regex`` package.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = with_decoded(with_tokens(own, "text", path, "ids"), "ids", path, "decoded")
    ids = F.col("ids")
    return both.select(
        F.col("doc_id").alias(id_col),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
