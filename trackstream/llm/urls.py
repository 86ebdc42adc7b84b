"""URL filters: explicit host-and-path rules first, association rules for the rest.

FP-growth mines URL token combinations that go with labels, on a bounded sample of labelled pages (``FIT_PAGES``). Tokens
below the support are left out first, as no rule can have them, and of tokens that the same pages have one stands for
all. Rules that conclude a label are pruned by support, confidence and by any simpler rule that is at least as sure. A URL's tokens
find the rules that they satisfy by an inverted index on each rule's rarest token. Every URL is judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackstream.llm.common import discard, materialize, sampled

#: Labelled pages that rules are mined from, at most (about).
FIT_PAGES = 20_000
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.7
#: Labelled pages that a combination is seen in, at least, however few there are.
MIN_PAGES = 10
BLOCK, ALLOW = "label:block", "label:allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one, or for null."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct typed tokens: host labels, path words and query keys; numbers are written ``#``."""

    def typed(kind: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(kind), w))

    numberless = F.regexp_replace(F.lower(path(url)), "[0-9]+", "#")
    query = F.regexp_extract(F.lower(_rest(url)), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda q: F.element_at(F.split(q, "="), 1))
    return F.array_distinct(F.concat(typed("h:", F.split(host(url), r"\.")), typed("p:", F.split(numberless, r"[^\p{L}#]+")), typed("q:", keys)))


@dataclass(frozen=True)
class Rule:
    """An explicit rule: a host with its subdomains, the start of a path, and a verdict."""

    host: str
    path: str
    verdict: str


def explicit(url_host: Column, url_path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):  # the longest is asked first
        fits = ((url_host == rule.host) | url_host.endswith("." + rule.host)) & url_path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.host + rule.path)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def mine(pages: DataFrame, id_col: str, url_col: str, labels: DataFrame, fit_pages: int = FIT_PAGES, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> list[tuple[tuple[str, ...], float]]:
    """Pruned rules (tokens, confidence) that conclude a block. ``labels``: (doc_id, block 0/1).

    Rows with a null id, url or label teach nothing, and repeated rows teach once. A page with both labels counts under
    each. The sample is drawn from labelled pages, so labels of other ids take no place in it. No labelled page at all
    gives no rules.
    """
    rows = labels.select("doc_id", "block").where("doc_id is not null and block in (0, 1)").distinct()
    urls = pages.select(F.col(id_col).alias("doc_id"), F.col(url_col).alias("url")).where("doc_id is not null and url is not null")
    labelled = urls.select("doc_id").distinct().join(rows.select("doc_id").distinct(), "doc_id").count()  # of the pages only
    if labelled < MIN_PAGES:
        return []
    share = min(1.0, fit_pages / labelled)
    drawn = [d if share == 1 else d.where(sampled(F.col("doc_id"), share)) for d in (urls, rows)]
    known = materialize(drawn[0].join(drawn[1], "doc_id").distinct(), "labelled-pages")
    try:
        return _rules(known, support, confidence)
    finally:
        discard(known)


def _rules(known: DataFrame, support: float, confidence: float) -> list[tuple[tuple[str, ...], float]]:
    """Pruned rules of labelled pages (doc_id, url, block), a sample of bounded size."""
    label = F.when(F.col("block") == 1, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    pages_of = known.select(F.col("doc_id"), F.explode(tokens(F.col("url"))).alias("token"), label.alias("label")).distinct()
    n = known.select("doc_id").distinct().count()
    if n < MIN_PAGES:  # by the chance of the sample
        return []
    support = max(support, MIN_PAGES / n)
    uses = pages_of.groupBy("token").agg(F.count_distinct("doc_id").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    kept = uses.where(F.col("n") >= support * n).groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token")  # at most a page's tokens / support
    baskets = pages_of.join(kept, "token").groupBy("doc_id").agg(F.array_union(F.collect_set("token"), F.collect_set("label")).alias("items"))
    bare = known.select("doc_id", label.alias("label")).join(baskets, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("label").alias("items"))
    baskets = baskets.unionByName(bare).select("items").cache()
    try:
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
        found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK)).where(~F.array_contains("antecedent", ALLOW))
        rules = [(tuple(sorted(r.antecedent)), r.confidence) for r in found.select("antecedent", "confidence").collect()]
    finally:
        baskets.unpersist()
    return pruned(rules)


def pruned(rules: list[tuple[tuple[str, ...], float]]) -> list[tuple[tuple[str, ...], float]]:
    """Rules of which no simpler one is at least as sure."""
    index, kept = Index([]), []
    for items, sure in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        if index.best(set(items)) < sure:
            kept.append((items, sure))
            index.by_token.setdefault(items[0], []).append((frozenset(items), sure))
    return kept


class Index:
    """Inverted index from a rule's rarest token to its rules."""

    def __init__(self, rules: list[tuple[tuple[str, ...], float]]):
        uses: dict[str, int] = {}
        for items, _ in rules:
            for item in items:
                uses[item] = uses.get(item, 0) + 1
        self.by_token: dict[str, list[tuple[frozenset[str], float]]] = {}
        for items, sure in rules:
            self.by_token.setdefault(min(items, key=lambda i: (uses[i], i)), []).append((frozenset(items), sure))

    def best(self, found: set[str]) -> float:
        """Confidence of the surest rule whose tokens are all present; 0 where none is."""
        return max((sure for token in found for items, sure in self.by_token.get(token, ()) if items <= found), default=0.0)


def judge(pages: DataFrame, url_col: str, rules: list[Rule], mined: list[tuple[tuple[str, ...], float]]) -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_confidence, which replace columns of these names; others pass through.

    A null url, or one without ``://``, has an empty host and path and is judged by the mined rules alone: allowed. Of
    explicit rules of equal length that fit, the one given last counts. Repeated rows are judged alike; an empty table
    stays empty.
    """
    shared = pages.sparkSession.sparkContext.broadcast(Index(mined))  # bounded by the support

    @F.pandas_udf("double")
    def surest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.best(set(t)) if t is not None else 0.0 for t in batch], dtype=float)

    url = F.col(url_col)
    out = pages.withColumns({"host": F.coalesce(host(url), F.lit("")), "path": F.coalesce(path(url), F.lit(""))})
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    out = out.withColumn("block_confidence", surest(tokens(url)))
    by_method = F.when(F.col("block_confidence") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_method)})
