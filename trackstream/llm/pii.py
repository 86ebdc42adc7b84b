"""Personal data: high-recall candidates, gradient-boosted trees, calibrated thresholds.

Exact rules find the base spans (email, ip, card, phone), which always stay. Looser generators propose overlapping
candidates of the same kinds. Boosted trees, fitted on the candidates of all documents but those held back, score each by
its format and context: candidates that are base spans, and respellings of them, are the positive ones; others, decoys
made of their digits, and runs that cut or join numbers side by side, the negative ones. For each kind, the threshold is
the lowest that keeps the wanted precision on all documents that were held back, a quarter. Candidates above it that touch
no base span are added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackstream.llm.common import discard, materialize

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
#: Bins of a feature.
BINS = 32
#: Distinct feature vectors that a task holds at a time while the trees are fitted.
BLOCK = 50_000
#: Gradients are summed in units of one in so many.
UNIT = 1 << 24
#: Cells of scores, from 0 to 1, in which the held-back examples are counted.
CELLS = 10_000
#: Candidates of a text scored at a time.
SCORED = 20_000
TREES, DEPTH, RATE = 40, 3, 0.2

SPAN = "struct<kind:int,start:int,end:int,base:boolean>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: A sign that stands for @, then a domain whose dots may be spelt out.
_AT = re.compile(r"\s?(?:@|[\[({]\s?(?:at|AT|@)\s?[\])}])\s?|\s(?:at|AT)\s(?=\S{1,64}\s(?:dot|DOT)\s)")
_DOT = r"\s?(?:\.|[\[({]\s?(?:dot|DOT|\.)\s?[\])}]|\s(?:dot|DOT)\s)\s?"
_LOOSE_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}")
#: Four numbers whose dots are bracketed, spelt out or set apart.
_LOOSE_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,4}}(?:{_DOT}[0-9]{{1,4}}){{3}}(?![0-9])")
#: Groups of digits, and what may separate the groups of one number.
_GROUP = re.compile(r"[0-9]+")
_GAP = re.compile(r"[\x20().\-/\[\]]{1,3}")
#: Digits of a candidate of any kind, at least and at most.
LEAST_DIGITS, MOST_DIGITS = 4, 20


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their ``@`` so that long runs of letters cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the exact rules, by kind, then start; a match that fails its test is dropped."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def gaps(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What the base spans leave of the text."""
    at = 0
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if a > at:
            yield at, a
        at = max(at, b)
    if at < len(text):
        yield at, len(text)


def runs(text: str, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of every run of consecutive digit groups that has few enough digits, from every group on."""
    groups = [m.span() for m in _GROUP.finditer(text, low, high)]
    joined = [bool(_GAP.fullmatch(text, b, c)) for (_, b), (c, _) in zip(groups, groups[1:], strict=False)]
    for i, (start, _) in enumerate(groups):
        start -= start > low and text[start - 1] == "("
        start -= start > low and text[start - 1] == "+"
        n = 0
        for j in range(i, len(groups)):
            a, b = groups[j]
            n += b - a
            if n > MOST_DIGITS or j > i and not joined[j - 1]:
                break
            if n >= LEAST_DIGITS:
                yield start, b + (b < high and text[b] == ")"), n


def candidates(text: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """Overlapping candidate spans of all kinds, with high recall, in what the spans of ``base`` leave of the text."""
    out: set[tuple[int, int, int]] = set()
    for low, high in gaps(text, base):
        for m in _AT.finditer(text, low, high):
            start = m.start()
            while start > low and m.start() - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            found = _LOOSE_DOMAIN.match(text, m.end(), high) if start < m.start() else None
            if found:
                out.add((0, start, found.end()))
        for a, b, n in runs(text, low, high):
            if n <= 12 and text.count(".", a, b) >= 3:
                out.add((1, a, b))
            if n >= 12:
                out.add((2, a, b))
            if 7 <= n <= 16:
                out.add((3, a, b))
        for pattern in (_IP, _LOOSE_IP):
            for m in pattern.finditer(text, low, high):
                out.add((1, *m.span()))
    return sorted(out)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span itself, and what stands around it."""
    span = text[start:end]
    digits = "".join(_DIGITS.findall(span))
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    groups = re.split(r"[^0-9]+", span.strip("+()[] "))
    signs = re.findall(r"(?<=[0-9])[^0-9]+(?=[0-9])", span)
    group_before = re.search(r"([0-9]+)[\x20().\-/\[\]+]{1,4}$", before)
    group_after = re.match(r"[\x20().\-/\[\]+]{1,4}([0-9]+)", after)
    wordy_before = re.search(r"[\w=\"']\S*$", before)
    return [
        kind,
        end - start,
        len(digits),
        len(groups),
        max(map(len, groups)),
        min(map(len, groups)),
        len({len(g) for g in groups}),
        span.count("."),
        span.count("-"),
        span.count(" "),
        span.count("(") + span.count("["),
        float(span[:1] == "+"),
        float(luhn(digits)) if digits else 0.0,
        float(kind == 1 and any(len(g.lstrip("0")) > 3 or int(g.lstrip("0") or 0) > 255 for g in groups)),
        len(set(digits)),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(bool(wordy_before)),
        float("=" in before[-12:] or ":" in before[-4:]),
        float('"' in before[-6:] or '"' in after[:6]),
        sum(c.isdigit() for c in before[-6:] + after[:6]),
        float(any(c.isdigit() for c in after[:2])),
        sum(c.isalpha() for c in span),
        len(groups[0]),
        len(groups[-1]),
        len(group_before[1]) if group_before else 0,
        len(group_after[1]) if group_after else 0,
        len(set(signs)),
        max(map(len, signs), default=0),
        span.count("/"),
    ]


def respelt(text: str, kind: int, start: int, end: int) -> list[tuple[str, int, int]]:
    """The same data in spellings that the exact rules miss: (text, start, end)."""
    span = text[start:end]
    if kind == 0:
        other = [span.replace("@", " [at] "), span.replace("@", "(at)"), span.replace("@", " at ").replace(".", " dot ")]
    elif kind == 1:
        other = [span.replace(".", d) for d in ("[.]", "(.)", " dot ", "[dot]", " . ")]
    elif kind == 2:
        digits = re.sub(r"\D", "", span)
        other = [re.sub(r"(?<=\d)(?=(?:\d{4})+$)", d, digits) for d in (".", "/")]
    else:  # a bare number is no longer a phone for sure
        other = [s for s in dict.fromkeys((span.lstrip("+"), span.split(" ", 1)[-1].lstrip("+"))) if not s.isdigit()]
    return [(text[:start] + s + text[end:], start, start + len(s)) for s in other]


def decoys(text: str, kind: int, start: int, end: int) -> list[tuple[str, int, int, int]]:
    """What looks like the data but is none: (text, kind, start, end) of failed check digits, parts too large, bare
    numbers and dates made of the same digits."""
    digits = re.sub(r"\D", "", text[start:end])
    other: list[tuple[int, str]] = []
    if kind == 1:
        octets = text[start:end].split(".")
        over = str(int(octets[3].lstrip("0") or 0) + 300)
        other += [(1, d.join([*octets[:3], over])) for d in (".", "[.]", " dot ", " . ")]
    elif kind == 2:
        failed = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        other += [(2, failed), (2, re.sub(r"(?<=\d)(?=(?:\d{4})+$)", " ", failed)), (2, digits[:13]), (1, re.sub(r"(?<=\d)(?=(?:\d{4})+$)", ".", digits[:16]))]
    elif kind == 3:
        date = f"20{digits[:2]}-{int(digits[2:4]) % 12 + 1:02d}-{int(digits[4:6]) % 28 + 1:02d}"
        other += [(3, digits), (2, digits + digits[:2]), (3, date), (3, date + " " + digits[-4:-2]), (3, date.replace("-", ".")), (3, digits[:8])]
    return [(text[:start] + d + text[end:], k, start, start + len(d)) for k, d in other]


def beside(text: str, kind: int, start: int, end: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The same data next to itself, and after a date: text, and where the data stand in it."""
    span = text[start:end]
    if kind == 2:
        spellings = [re.sub(r"\D", "", span)]
    elif kind == 3:
        own = span.split(" ", 1)[-1]
        spellings = [span.lstrip("+"), own, re.sub(r"\D+", "-", own.strip("+()")), re.sub(r"\D", "", own)]
    else:
        return []
    out = []
    for k, s in enumerate(dict.fromkeys(spellings)):
        for first in (s, f"20{start % 30:02d}-{start % 12 + 1:02d}-{end % 28 + 1:02d}"):
            sign = (" ", " / ")[(k + start) % 2]
            at = start + len(first) + len(sign)
            spans = [(kind, start, start + len(s))] * (first == s) + [(kind, at, at + len(s))]
            out.append((text[:start] + first + sign + s + text[end:], spans))
    return out


class Boosted:
    """Gradient-boosted trees for two classes: quantile bins, least-squares splits, Newton leaves.

    Trees grow level by level, each level from sums over all examples: of their number, gradients and curvatures by open
    node, feature and bin. The sums are whole numbers, so they can be taken anywhere and added in any order.
    """

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate = trees, depth, rate
        self.start, self.model = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """From examples at hand."""
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf")) for c in x.T]
        binned, yes = self.binned(x), np.asarray(y).astype(np.int64)
        return self.boost(int(yes.sum()), len(yes), lambda opened: self.sums(binned, yes, 1 - yes, opened))

    def boost(self, yes: int, n: int, told: Callable[[list[int]], np.ndarray]) -> Boosted:
        """From ``told``, which gives the ``sums`` of all examples for the open nodes of the last tree."""
        share = np.clip(yes / n, 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        for _ in range(self.trees):
            tree, opened = {0: 0.0}, [0]
            self.model.append(tree)
            for _ in range(self.depth):
                inner = []
                for node, sums in zip(opened, told(opened), strict=True):
                    inner += self._split(tree, node, sums)
                opened = inner
                if not opened:
                    break
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T, strict=True)], 1)

    def sums(self, binned: np.ndarray, yes: np.ndarray, no: np.ndarray, opened: list[int]) -> np.ndarray:
        """(open node, bin of all features one after the other, 3) of distinct examples that stand for ``yes`` and ``no``."""
        first = np.r_[0, np.cumsum([len(c) + 1 for c in self.cuts])]
        p, n, at = self._probability(binned, self.model[:-1]), yes + no, self._nodes(self.model[-1], binned)
        each = (n, yes * UNIT - n * np.rint(p * UNIT), n * np.rint(p * (1 - p) * UNIT))
        out = np.zeros((len(opened), first[-1], 3), np.int64)
        for i, node in enumerate(opened):
            here = at == node
            cells = (binned[here] + first[:-1]).ravel()
            for k, v in enumerate(each):
                out[i, :, k] = np.bincount(cells, np.repeat(v[here].astype(float), binned.shape[1]), first[-1])
        return out

    def _split(self, tree: dict, node: int, sums: np.ndarray) -> list[int]:
        """Splits a node where that gains most, or makes it a leaf; its children that may be split further."""
        sums, first = sums / [1, UNIT, UNIT], np.r_[0, np.cumsum([len(c) + 1 for c in self.cuts])]
        n, g, h = sums[: first[1]].sum(0)
        best, low = (1e-6, None, None), None
        for f, (a, b) in enumerate(zip(first, first[1:], strict=False) if n >= 20 else ()):
            left = sums[a:b].cumsum(0)[:-1]
            if not len(left):
                continue
            gain = left[:, 1] ** 2 / (left[:, 2] + 1.0) + (g - left[:, 1]) ** 2 / (h - left[:, 2] + 1.0) - g**2 / (h + 1.0)
            gain[(left[:, 0] == 0) | (left[:, 0] == n)] = 0.0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best, low = (gain[k], f, k), left[k]
        if low is None:
            tree[node] = float(g / (h + 1.0))
            return []
        tree[node] = best[1:]
        children = [2 * node + 1, 2 * node + 2]
        for child, (_, cg, ch) in zip(children, (low, np.array([n, g, h]) - low), strict=True):
            tree[child] = float(cg / (ch + 1.0))
        return children

    def _nodes(self, tree: dict, binned: np.ndarray) -> np.ndarray:
        at = np.zeros(len(binned), np.int64)
        for node, what in sorted(tree.items()):  # parents first
            if isinstance(what, tuple):
                here = np.flatnonzero(at == node)
                at[here] = 2 * node + 1 + (binned[here, what[0]] > what[1])
        return at

    def _probability(self, binned: np.ndarray, model: list[dict]) -> np.ndarray:
        score = np.full(len(binned), self.start)
        for tree in model:
            leaves = np.zeros(2 ** (self.depth + 1))
            for node, what in tree.items():
                leaves[node] = what if isinstance(what, float) else 0.0
            score += self.rate * leaves[self._nodes(tree, binned)]
        return 1 / (1 + np.exp(-score))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.of_binned(self.binned(x))

    def of_binned(self, binned: np.ndarray) -> np.ndarray:
        return self._probability(binned, self.model)


class Covered:
    """Places that are taken, as disjoint spans in order: asked and extended by bisection, however many there are."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1  # the last span that begins before b reaches furthest
        return k < 0 or self.ends[k] <= a

    def add(self, a: int, b: int) -> None:
        """Takes a span that is free."""
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


@dataclass
class Model:
    trees: Boosted | None = None
    #: By kind; a threshold above 1 adds nothing of that kind.
    thresholds: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))

    def spans(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(kind, start, end, whether a base span), by kind, then start."""
        base = base_spans(text)
        out = [(k, a, b, True) for k, a, b in base]
        if self.trees is None or not (_AT.search(text) or _DIGITS.search(text)):
            return out
        loose = sorted(candidates(text, base), key=lambda c: (c[1] - c[2], c))  # of equal scores, the longest is first
        if loose:
            scored = [self.trees.probability(np.array([features(text, *c) for c in loose[i : i + SCORED]], float)) for i in range(0, len(loose), SCORED)]
            p, taken = np.concatenate(scored), Covered((a, b) for _, a, b in base)
            enough = np.flatnonzero(p >= np.array(self.thresholds)[[k for k, _, _ in loose]])
            for i in enough[np.argsort(-p[enough], kind="stable")]:
                k, a, b = loose[i]
                if taken.free(a, b):
                    taken.add(a, b)
                    out.append((k, a, b, False))
        return sorted(out)


def threshold(counts: list[tuple[int, int, int]], precision: float) -> float:
    """The lowest score, one half at least, from which on the wanted precision holds; above 1 where it never does.

    ``counts``: (cell, right, wrong) of scores in cells of 1 / ``CELLS``, each at most once. It lies half-way to the next
    lower cell with scores, if there is one.
    """
    told = np.array(sorted(counts, reverse=True), np.int64).reshape(-1, 3)
    right, n = told[:, 1].cumsum(), told[:, 1:].sum(1).cumsum()
    good = np.flatnonzero(right >= precision * n)
    if not len(good) or right[-1] < 5:
        return 2.0
    k = good[-1]
    return max(0.5, float(told[k, 0] + told[k + 1, 0] + 1) / 2 / CELLS if k + 1 < len(told) else 0.5)


def _examples(text: str) -> Iterator[tuple[list[float], bool]]:
    base = base_spans(text)
    real = set(base)
    of_kind = [Covered((a, b) for k, a, b in base if k == kind) for kind in range(len(KINDS))]
    for k, a, b in candidates(text):
        if (k, a, b) in real:
            yield features(text, k, a, b), True
        elif of_kind[k].free(a, b):
            yield features(text, k, a, b), False
    for k, a, b in base:
        near = (text[max(0, a - 40) : b + 40], k, min(a, 40), min(a, 40) + b - a)
        for changed, start, end in respelt(*near):
            yield features(changed, k, start, end), True
            yield from ((features(changed, *c), False) for c in candidates(changed) if c[1] < end and start < c[2] and c != (k, start, end))
        yield from ((features(changed, kind, start, end), False) for changed, kind, start, end in decoys(*near))
        for changed, spans in beside(*near):
            low, high = near[2], spans[-1][2]
            yield from ((features(changed, *c), c in spans) for c in candidates(changed) if c[1] < high and low < c[2])


def example_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(x, held, yes, no): each distinct feature vector, as packed floats, and how many examples of all texts have it.

    Repeated texts are learned from once. A quarter of the texts, by hash, is held back.
    """
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]")).distinct()
    schema = "x binary, held boolean, yes long, no long"

    def frame(sums: dict[tuple[bytes, bool], list[int]]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *n) for key, n in sums.items()], columns=["x", "held", "yes", "no"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[bytes, bool], list[int]] = {}
        for batch in batches:
            for text, held in zip(batch["text"], batch["held"], strict=True):
                for x, y in _examples(text):
                    sums.setdefault((np.array(x, np.float32).tobytes(), bool(held)), [0, 0])[not y] += 1
                    if len(sums) >= BLOCK:
                        yield frame(sums)
                        sums = {}
        yield frame(sums)

    held = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    return texts.select("text", held.alias("held")).mapInPandas(count, schema).groupBy("x", "held").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def _matrix(column: Iterable[bytes], kind: type) -> np.ndarray:
    rows = list(column)
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def quantiles(vectors: DataFrame) -> list[np.ndarray]:
    """By feature, the values at which a whole number of ``BINS``-ths of the examples to fit on is reached."""

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = (batch["yes"] + batch["no"]).to_numpy()
            for f, column in enumerate(_matrix(batch["x"], np.float32).T):
                own, at = np.unique(column, return_inverse=True)
                yield pd.DataFrame({"f": f, "v": own.astype(float), "n": np.bincount(at, n).astype(np.int64)})

    each = vectors.where("not held").mapInPandas(values, "f int, v double, n long").groupBy("f", "v").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("f").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    parts = each.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("f")))
    reached = parts.selectExpr("f", "v", f"upto * {BINS} div all as last", f"(upto - n) * {BINS} div all as before")
    cuts: dict[int, list[float]] = {}
    for r in reached.where(f"last > before and before < {BINS - 1}").select("f", "v").collect():  # at most BINS a feature
        cuts.setdefault(r.f, []).append(r.v)
    return [np.array(sorted(cuts[f])) for f in sorted(cuts)]


def bins(vectors: DataFrame, trees: Boosted) -> DataFrame:
    """``vectors`` summed up by what the trees can tell apart: ``x`` has the kind, then the bins, a byte each."""

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["x"], np.float32)
            batch["x"] = [r.tobytes() for r in np.c_[x[:, 0], trees.binned(x)].astype(np.uint8)]
            yield batch

    return vectors.mapInPandas(binned, vectors.schema).groupBy("x", "held").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def blocks(rows: DataFrame) -> DataFrame:
    """(held, x, yes, no): up to about ``BLOCK`` rows of ``bins`` packed in one."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bool, list[pd.DataFrame]] = {False: [], True: []}

        def block(held: bool) -> pd.DataFrame:
            rows, kept[held] = pd.concat(kept[held]), []
            return pd.DataFrame({"held": [held], "x": [b"".join(rows["x"])], "yes": [rows["yes"].to_numpy(np.int64).tobytes()], "no": [rows["no"].to_numpy(np.int64).tobytes()]})

        for batch in batches:
            for held, some in batch.groupby("held"):
                kept[bool(held)].append(some)
                if sum(map(len, kept[bool(held)])) >= BLOCK:
                    yield block(bool(held))
        for held in kept:
            if kept[held]:
                yield block(held)

    return rows.mapInPandas(pack, "held boolean, x binary, yes binary, no binary")


def _unpacked(batches: Iterator[pd.DataFrame], features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kinds, bins, yes, no) of each block."""
    for batch in batches:
        for x, yes, no in zip(batch["x"], batch["yes"], batch["no"], strict=True):
            both = np.frombuffer(x, np.uint8).reshape(-1, 1 + features).astype(np.int64)
            yield both[:, 0], both[:, 1:], np.frombuffer(yes, np.int64), np.frombuffer(no, np.int64)


def fit(docs: DataFrame, text_col: str, precision: float = PRECISION) -> Model:
    """Trees and thresholds from all documents that hold a digit or ``@``. Too few examples: nothing is added.

    The driver sees sums by bin only. Examples are summed up by what the trees can tell apart, and stay with the executors.
    """
    vectors = materialize(example_counts(docs, text_col), "pii-examples")
    try:
        return _fit(vectors, precision)
    finally:
        discard(vectors)


def _fit(vectors: DataFrame, precision: float) -> Model:
    totals = {r.held: (r.yes, r.yes + r.no) for r in vectors.groupBy("held").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()}
    (yes, n), (_, n_held) = totals.get(False, (0, 0)), totals.get(True, (0, 0))
    if n + n_held < 100 or not 0 < yes < n or not n_held:
        return Model()
    trees = Boosted()
    trees.cuts = quantiles(vectors)
    told_apart = materialize(bins(vectors, trees), "pii-bins")  # so that tasks follow its size
    packed = blocks(told_apart).persist()
    width = len(trees.cuts)

    def told(opened: list[int]) -> np.ndarray:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = [trees.sums(*rest, opened) for _, *rest in _unpacked(batches, width)]
            yield pd.DataFrame({"sums": [sum(sums).tobytes()] if sums else []})

        parts = [np.frombuffer(r.sums, np.int64) for r in packed.where("not held").select("x", "yes", "no").mapInPandas(add, "sums binary").collect()]
        return sum(parts).reshape(len(opened), -1, 3)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for kinds, bins, yes, no in _unpacked(batches, width):
            at = np.searchsorted(np.arange(CELLS + 1) / CELLS, trees.of_binned(bins), side="right") - 1
            yield pd.DataFrame({"kind": kinds, "cell": at, "yes": yes, "no": no}).groupby(["kind", "cell"], as_index=False).sum()

    try:
        trees.boost(yes, n, told)
        scored = packed.where("held").select("x", "yes", "no").mapInPandas(cells, "kind long, cell long, yes long, no long")
        rows = scored.groupBy("kind", "cell").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()  # at most KINDS x CELLS
    finally:
        packed.unpersist()
        discard(told_apart)
    return Model(trees, [threshold([(r.cell, r.yes, r.no) for r in rows if r.kind == k], precision) for k in range(len(KINDS))])


def find(docs: DataFrame, text_col: str, model: Model, out_col: str = "pii") -> DataFrame:
    """``docs`` with an array of spans (kind number, code points, end exclusive, base).

    Null and empty texts have none. Repeated rows get the same spans; of candidates with equal scores the longest, then
    the first, is taken. An empty table stays empty. A column of the name ``out_col`` is replaced; others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"array<{SPAN}>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in shared.value.spans(t or "")] for t in batch], dtype=object)

    return docs.withColumn(out_col, spans(F.col(text_col)))


def redact(docs: DataFrame, text_col: str, model: Model) -> DataFrame:
    """``docs`` whose texts have ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]`` in place of each span; null stays null.

    Where spans of different kinds overlap, the first to start covers what it overlaps, and of two that start together the
    longer one. Repeated rows are redacted alike; an empty table stays empty; all other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def redacted(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for k, a, b, _ in sorted(shared.value.spans(text), key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def covered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([redacted(t) for t in batch], dtype=object)

    return docs.withColumn(text_col, covered(F.col(text_col)))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"])), ",")
