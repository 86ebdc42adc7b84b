"""Toxic passages as maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled training rows (``FIT_DOCS``): token counts by label, smoothed by Dirichlet priors
whose means come from the token's own shorter prefixes, give each token a log-odds score; a constant drift is taken off
so that ordinary text scores below zero. A linear scan finds all maximal segments of a text. On the held-back part of
the sample, clean texts give the Gumbel law of the best segment (Karlin-Altschul: lambda and K), and a logistic curve
over the resulting log significance turns it into a probability.

Scoring covers every row and every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackstream.llm.common import fold, sampled

#: Labelled documents that a model is fitted on, at most (about).
FIT_DOCS = 20_000
#: Seen at least so often in the sample, or the next shorter prefix speaks for it.
MIN_COUNT = 8
PREFIXES = (2, 3, 4, 5, 6, 8)
#: Dirichlet prior: pseudo-counts that a prefix lends to its longer forms.
PRIOR = 8.0
DRIFT = 1.5
#: Segments with at most this expected number in one clean text are called significant.
E_VALUE = 0.01
CACHE_WORDS = 400_000

TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """Prefixes of a word, shortest first, and last the word itself."""
    return [word[:k] for k in PREFIXES if k < len(word)] + ["^" + word]


def segments(scores: list[tuple[int, float]], drops: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last token, score), by the linear-time scan of disjoint candidates.

    ``scores``: (position, score) of the positive tokens; ``drops[i]``: sum of all scores before token i.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    for at, score in scores:
        first, last, before, after = at, at, float(drops[at]), float(drops[at]) + score
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= before:
                k -= 1
            if k < 0 or stack[k][3] >= after:
                stack.append((first, last, before, after))
                break
            first, before = stack[k][0], stack[k][2]  # joins that candidate and all after it
            del stack[k:]
            k -= 1
    return [(a, b, after - before) for a, b, before, after in stack]


@dataclass
class Model:
    """Log-odds by feature, the Gumbel law of clean texts, and the curve to probabilities."""

    odds: dict[str, float]
    drift: float = DRIFT
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    e_value: float = E_VALUE
    cache: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def token(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            found = 0.0
            for feature in reversed(features(word.lower())):
                if feature in self.odds:
                    found = self.odds[feature]
                    break
            self.cache[word] = found = found - self.drift
        return found

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = TOKEN.findall(text)
        each = np.fromiter(map(self.token, words), np.float64, len(words))
        positive = np.flatnonzero(each > 0)
        if not len(positive):
            return len(words), []
        drops = np.concatenate([[0.0], np.cumsum(each)])
        return len(words), segments([(int(i), float(each[i])) for i in positive], drops)

    def log_expected(self, n: int, score: float) -> float:
        """ln of the expected number of segments that score so high in a clean text of n tokens."""
        return self.log_k + math.log(max(n, 1)) - self.lam * score

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """How far all significant segments together are beyond chance (0: nothing is)."""
        return sum(max(0.0, -self.log_expected(n, s)) for _, _, s in found)

    def probability(self, n: int, found: list[tuple[int, int, float]]) -> float:
        x = self.offset + self.slope * math.log1p(self.evidence(n, found))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, x))))

    def judge(self, text: str) -> tuple[float, list[dict]]:
        """Probability of being toxic, and the significant passages (code points, end exclusive)."""
        n, found = self.scan(text)
        score = self.probability(n, found)
        bound = math.log(self.e_value)
        told = [(a, b, s) for a, b, s in found if self.log_expected(n, s) <= bound]
        if not told:
            return score, []
        spans = [m.span() for m in TOKEN.finditer(text)]
        return score, [{"start": spans[a][0], "end": spans[b][1], "score": s} for a, b, s in told]


def count_features(labelled: DataFrame) -> DataFrame:
    """(feature, clean, toxic) counts over (text, toxic) rows, summed within each task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words[int(toxic)].update(w.lower() for w in TOKEN.findall(text or ""))
            sums: dict[str, list[int]] = {}
            for label in (0, 1):
                for word, n in words[label].items():
                    for feature in features(word):
                        sums.setdefault(feature, [0, 0])[label] += n
            yield pd.DataFrame([(f, *n) for f, n in sums.items()], columns=["feature", "clean", "toxic"])

    rows = labelled.select("text", "toxic").mapInPandas(count, "feature string, clean long, toxic long")
    return rows.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_odds(counts: list[tuple[str, int, int]], clean: int, toxic: int, prior: float = PRIOR) -> dict[str, float]:
    """Smoothed log-odds by feature: each prefix is the Dirichlet mean of its longer forms."""
    of = {f: (c, t) for f, c, t in counts}
    base = (toxic + 1) / (clean + toxic + 2)
    rates: dict[str, float] = {}

    def rate(chain: list[str]) -> float:
        if not chain:
            return base
        last = chain[-1]
        if last not in rates:
            below = rate(chain[:-1])
            c, t = of.get(last, (0, 0))
            rates[last] = (t + prior * below) / (c + t + prior)
        return rates[last]

    out = {}
    for feature in of:
        word = feature.removeprefix("^")
        chain = [word[:k] for k in PREFIXES if k < len(word)] + [feature]
        r = rate(chain)
        out[feature] = math.log(r / (1 - r)) - math.log(base / (1 - base))
    return out


def gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and ln K from the best segments of clean texts of n tokens, by moments of the length-corrected scores."""
    used = best > 0
    if used.sum() < 10:
        return 1.0, 0.0
    lam = 1.0
    for _ in range(50):  # the correction for length depends on lambda
        corrected = best[used] - np.log(np.maximum(n[used], 1)) / lam
        new = math.pi / (math.sqrt(6) * max(corrected.std(), 1e-6))
        if abs(new - lam) < 1e-6:
            break
        lam = 0.5 * (lam + min(max(new, 0.05), 20.0))
    corrected = best[used] - np.log(np.maximum(n[used], 1)) / lam
    return lam, lam * (corrected.mean() - np.euler_gamma / lam)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and offset of P(y | x), with a light ridge so that separable data keep finite."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, fit_docs: int = FIT_DOCS, drift: float = DRIFT) -> Model:
    """A model of ``labels.toxic`` from at most about ``fit_docs`` rows of ``labels`` that satisfy ``train``.

    Both tables have ``doc_id``; rows with a null label, id or text are left out. Of the sample, one fifth by id
    calibrates and the rest counts tokens. Without usable rows of both labels, nothing is ever called toxic.
    """
    spark = docs.sparkSession
    rows = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").distinct()
    rows = rows.where(train) if train is not None else rows
    available = rows.count()
    rows = rows.where(sampled(F.col("doc_id"), min(1.0, fit_docs / max(available, 1)))) if available > fit_docs else rows
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(rows), "doc_id")  # at most fit_docs rows
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(5))
    counts = [tuple(r) for r in count_features(texts.where(part != 0)).where(F.col("clean") + F.col("toxic") >= MIN_COUNT).collect()]
    words = [c for c in counts if c[0].startswith("^")]
    model = Model(log_odds(counts, sum(c for _, c, _ in words), sum(t for _, _, t in words)), drift)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<n:bigint,scores:array<double>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [shared.value.scan(t) for t in batch]
            yield pd.DataFrame({"n": [n for n, _ in told], "scores": [[s for _, _, s in found] for _, found in told]})

    held = texts.where(part == 0).select("toxic", scan("text").alias("s")).select("toxic", "s.n", "s.scores").collect()
    y = np.array([r.toxic for r in held], float)
    if not len(y) or y.min() == y.max():
        model.offset, model.slope = -10.0, 0.0
        return model
    n = np.array([r.n for r in held], float)
    best = np.array([max(r.scores, default=0.0) for r in held])
    model.lam, model.log_k = gumbel(best[y == 0], n[y == 0])
    x = np.array([math.log1p(model.evidence(int(r.n), [(0, 0, s) for s in r.scores])) for r in held])
    model.slope, model.offset = logistic(x, y)
    return model


def judge(docs: DataFrame, model: Model, text_col: str, out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column: score (0 to 1) and segments, the significant passages in code points.

    Null and empty texts have no passages and the score of a text without evidence. Repeated rows are judged alike, and of
    passages with equal scores each is told. An empty table stays empty. A column of the name ``out_col`` is replaced; all
    others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting sample

    @F.pandas_udf("struct<score:double,segments:array<struct<start:int,end:int,score:double>>>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            yield pd.DataFrame([own.judge(t or "") for t in batch], columns=["score", "segments"])

    return docs.withColumn(out_col, judged(F.col(text_col)))


def in_training(id_col: str = "doc_id", parts: int = 5) -> Column:
    """Rows that labels may be learned from: all but fold 0."""
    return fold(F.col(id_col), parts) != 0
