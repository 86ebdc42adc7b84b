"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over every training token window.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A window is ``size`` consecutive
words of an item, or all words of a shorter one. Distinct pairs of a window and an item are made by Spark and dealt by
hash into blocks of about ``block_windows``; only one block at a time is on the driver and in the workers, and a window that
very many items share is dealt over several. A benchmark of one block needs one pass; further blocks each take a pass over
what the pass before wrote. Set members are the windows themselves, so a hit needs no further proof of equality.
"""

from __future__ import annotations

import re
import string
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackstream.llm.common import discard, materialize

#: Entries (a window with one of its items) broadcast at a time.
BLOCK_WINDOWS = 1_000_000

_SPACE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
NORMAL = bytes(ord(chr(b).lower()) if b < 0x80 else b for b in _SPACE)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in texts as they are, capitals included

RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,hits:array<struct<first:int,last:int>>,spans:array<struct<start:int,end:int>>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(window, item): every distinct window, its words joined by a space, with the id of each of its items as a string."""
    lower = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    each = benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("w")).where("size(w) > 0")
    k = F.least(F.lit(size), F.size("w"))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))
    return each.select(F.explode(F.array_distinct(cut)).alias("window"), "item").distinct()


class Windows:
    """Hash set of windows, with the ids of the items that they come from, and their words."""

    def __init__(self, rows: list[tuple[str, str | None]]):
        self.items: dict[bytes, list[str]] = {}
        for window, item in rows:
            items = self.items.setdefault(window.encode(), [])
            if item is not None:
                items.append(item)
        self.words = {w for window in self.items for w in window.split(b" ")}
        self.sizes = sorted({window.count(b" ") + 1 for window in self.items})
        self.runs = re.compile(b"\x01{%d,}" % self.sizes[0]) if self.sizes else None

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit ranges of word positions (both inclusive) and the items of the hit windows."""
        hits: list[tuple[int, int]] = []
        items: set = set()
        if self.runs is None or len(words) < self.sizes[0]:
            return hits, items
        known = bytes(map(self.words.__contains__, words))
        for run in self.runs.finditer(known):  # only where all words are words of the benchmark
            for k in self.sizes:
                for i in range(run.start(), run.end() - k + 1):
                    found = self.items.get(b" ".join(words[i : i + k]))
                    if found is not None:
                        items.update(found)
                        hits.append((i, i + k - 1))
        return hits, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive ranges, sorted and joined where they overlap or adjoin."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _char_spans(text: str, hits: list[tuple[int, int]]) -> list[dict]:
    """Code-point spans, end exclusive, of ranges of word positions."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return [{"start": spans[a][0], "end": spans[b][1]} for a, b in hits]


def _scanner(shared, text: Column, before: Column | None) -> Column:
    """The result for one block, together with the result ``before`` of other blocks."""

    def judge(t: str | None, told: dict | None) -> tuple:
        words = words_of(t or "")
        hits, items = shared.value.scan(words)
        if told is not None:
            hits += [(h["first"], h["last"]) for h in told["hits"]]
            items |= set(told["items"])
        hits = merged(hits)
        n = sum(b - a + 1 for a, b in hits)
        return len(words), n, sorted(items), [{"first": a, "last": b} for a, b in hits], _char_spans(t, hits) if hits else []

    names = ["n_words", "n_hit", "items", "hits", "spans"]
    if before is None:

        @F.pandas_udf(RESULT)
        def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([judge(t, None) for t in batch], columns=names)

        return scan(text)

    @F.pandas_udf(RESULT)
    def scan_on(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for batch, told in batches:
            yield pd.DataFrame([judge(t, x) for t, x in zip(batch, told.to_dict("records"), strict=True)], columns=names)

    return scan_on(text, before)


def scan(
    docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, size: int = 13, block_windows: int = BLOCK_WINDOWS, out_col: str = "contamination"
) -> DataFrame:
    """``docs`` with a struct column: n_words, n_hit, items (ids as sorted strings), hits (word positions, inclusive) and
    spans (code points, end exclusive), both merged.

    Null and empty texts have no words. Items without words have no windows; items with a null id are hit but not
    listed. Repeated rows are judged alike, and repeated items count once. An empty table, on either side, gives no hits.
    A column of the name ``out_col`` is replaced; all other columns of ``docs`` pass through.
    """
    spark: SparkSession = docs.sparkSession
    found = materialize(windows(benchmark, item_col, item_text_col, size), "windows")
    blocks = 2 * found.count() // block_windows + 1  # a window and an id each
    rest, done = docs.drop(out_col), None
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in found.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k).collect()]))
        scanned = rest.withColumn(out_col, _scanner(shared, F.col(text_col), F.col(out_col) if k else None))
        if k == blocks - 1:
            break
        rest = materialize(scanned, "scanned")
        shared.destroy()
        if done is not None:
            discard(done)
        done = rest
    discard(found)
    return scanned


def contaminated(result: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (result["n_hit"] > 0) & (share * result["n_hit"] >= result["n_words"])


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, size: int = 13) -> DataFrame:
    """``docs`` without contaminated documents; columns as they were, whatever their names. Texts without words stay."""
    name = f"_{uuid.uuid4().hex}"
    judged = scan(docs, benchmark, text_col, item_col, item_text_col, size, out_col=name)
    return judged.where(~contaminated(F.col(name))).drop(name)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, size: int = 13, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with the hit words cut out of the texts; a null text stays null."""
    name = f"_{uuid.uuid4().hex}"
    judged = scan(docs, benchmark, text_col, item_col, item_text_col, size, block_windows, out_col=name)
    spans = F.col(f"{name}.spans")
    text, n = F.col(text_col), F.size(spans)
    kept = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            text,
            F.when(i == 0, F.lit(1)).otherwise(F.try_element_at(spans, i)["end"] + 1),
            F.coalesce(F.try_element_at(spans, i + 1)["start"], F.length(text)) - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(spans, F.greatest(i, F.lit(1)))["end"]),
        ),
    )
    return judged.withColumn(text_col, F.when(n > 0, F.array_join(kept, "")).otherwise(text)).drop(name)
