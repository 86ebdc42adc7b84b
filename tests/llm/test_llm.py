"""Training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import functools
import hashlib
import itertools
import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from trackstream.llm import bpe, components, decontam, fingerprints, katz, licenses, pii, queries, rollups, simhash, toxicity, urls

RANKS = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_decontamination_keeps_one_block_alive(spark, monkeypatch):
    alive, most = [0], [0]
    plain = type(spark.sparkContext).broadcast

    def counted(self, value):
        if isinstance(value, decontam.Windows):
            assert len(value.items) <= 80  # about ``block_windows``
            alive[0] += 1
            most[0] = max(most[0], alive[0])
        made = plain(self, value)
        drop = made.destroy

        def destroy(*a):
            alive[0] -= isinstance(value, decontam.Windows)
            drop(*a)

        made.destroy = destroy
        return made

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(40)], "item_id long, text string")
    texts = [f"a b {' '.join(f'w{i}x{k}' for k in range(20))} c" for i in range(40)]
    got = decontam.scan(docs(spark, texts), bench, "text", "item_id", "text", block_windows=100).collect()
    assert most[0] == 1 and all(r.contamination.n_hit == 20 and r.contamination["items"] == [str(r.doc_id)] for r in got)


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("fp", "node", "own", "bucket", "batch")}) if extra else df


ODD = ["", None, "a", "a b c", "a b c", "A  b\nc", "x" * 3000, "é ü 漢字 🙂", " \n\t ", "word " * 2000, "\x00 \x1c b", "the end"]


# 1 byte-level BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(spark, reference):
    rng = random.Random(5)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x3000), 32, 10])) for _ in range(300)) for _ in range(40)]
    texts += ["ab" * 2000, "z" * 1025, "'S 's I'm  we'll   123456 <|endoftext|>"]
    got = {r.doc_id: r for r in bpe.digests(docs(spark, texts, True), "doc_id", "text", RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs(spark, texts).limit(0), "doc_id", "text", RANKS, P.PATTERN).count() == 0


def test_bpe_long_pieces_and_cache_resets(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 10)
    vocab = bpe.vocabulary(RANKS, P.PATTERN)
    texts = ["abcdefgh" * 50, "one two three four", "one two", "y" * 2000 + "é" * 900]
    assert [x.tolist() for x in bpe.Encoder(vocab).encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    for piece in (b"abracadabra" * 30, b"\xff\xfe" * 20):
        assert vocab._merge_long(piece).tolist() == vocab.encode_pieces([piece])[0].tolist()


# 2 URL filters


def test_url_parts_and_rules(spark):
    given = [
        "http://A.Example.ORG/es/x?y", "https://example.org/en/12#t", "http://b.com/fr/", "b.com/fr/", None, "x://COM", "http://notcom/fr/1", "http://q.com?/fr/", "a://b://c/d",
        "http://com/de/1", "http://example.org", "http://É.org/Z",
    ]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("host_", F.lit(1))
    got = [(r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, "url", queries.URL_RULES, []).orderBy("page_id").collect()]
    assert got == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("b.com", "/fr/", "com/fr/", "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("com", "", None, "allow"), ("notcom", "/fr/1", None, "allow"), ("q.com", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("com", "/de/1", "com/de/", "block"), ("example.org", "", None, "allow"), ("É.org", "/Z", "org/", "allow"),
    ]


def test_rules_are_mined_from_labels(spark):
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'good'}.example.net/p/{i}") for i in range(200)] + [(500, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, block int")
    mined = urls.mine(pages, "page_id", "url", labels)
    assert (("h:spam",), 1.0) in mined and not any("h:good" in items for items, _ in mined)
    got = urls.judge(pages, "url", [], mined)
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == set(range(0, 200, 4))
    assert urls.mine(pages, "page_id", "url", labels.limit(0)) == []
    index = urls.Index([(("a", "b"), 0.9), (("b",), 0.5)])
    assert (index.best({"a", "b"}), index.best({"b"}), index.best({"a"}), index.best(set())) == (0.9, 0.5, 0, 0)


def test_mined_rules_by_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{chr(97 + i)}" for i in range(7)]
    rows, labels = [], []
    for i in range(400):
        chosen = [w for w in words if rng.random() < 0.4]
        block = int({"wa", "wb"} <= set(chosen) or "wc" in chosen and rng.random() < 0.85 or rng.random() < 0.05)
        rows.append((i, f"http://x{i % 3}.net/{'/'.join(chosen)}/both/always?k={i}"))
        labels.append((i, block))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", urls.tokens(F.col("url")).alias("t")).collect()}
    mined = urls.mine(pages, "page_id", "url", spark.createDataFrame(labels, "doc_id long, block int"), support=0.05)
    of = dict(labels)
    index: dict = defaultdict(set)
    for i, ts in tokens.items():
        for t in ts:
            index[t].add(i)
    # of tokens on the very same pages, the first stands for all
    stand = {frozenset(v): min(k for k, x in index.items() if x == v) for v in index.values() if len(v) >= 20}
    items = sorted(stand.values())
    rules = []
    for k in range(1, len(items) + 1):
        for combination in itertools.combinations(items, k):
            seen = set.intersection(*(index[t] for t in combination))
            hits = sum(of[i] for i in seen)
            if hits >= 20 and hits / len(seen) >= urls.MIN_CONFIDENCE:
                rules.append((combination, hits / len(seen)))
    want = []
    for c, sure in rules:
        if not any(set(k) <= set(c) and s >= sure for k, s in want):
            want.append((c, sure))
    assert sorted((c, round(s, 9)) for c, s in mined) == sorted((c, round(s, 9)) for c, s in want) and (("p:wa", "p:wb"), 1.0) in mined
    judged = {r.page_id: (r.verdict, r.block_confidence) for r in urls.judge(pages.withColumn("host", F.lit(1)), "url", [], mined).collect()}
    for i, ts in tokens.items():
        best = max((s for c, s in want if set(c) <= ts), default=0.0)
        assert judged[i] == ("block" if best else "allow", pytest.approx(best))


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None), (2, "http://" + "a" * 5000 + ".com/" + "b/" * 5000)], "page_id long, url string")
    got = urls.judge(pages, "url", queries.URL_RULES, [(("h:a", "p:x"), 0.9)])
    assert got.count() == 4 and {r.verdict for r in got.collect()} == {"allow"} and urls.judge(pages.limit(0), "url", [], []).count() == 0


# 3 fingerprints


def shingles(text, size=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_fingerprints_of_edits(spark):
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + [" ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(5, 90))) for _ in range(700)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs(spark, texts, True), "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        after = texts[i - 1] if i else texts[-1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        a, b, c = shingles(t), shingles(edited), shingles(after)
        if max(len(a | b), len(a | c)) <= fingerprints.K:  # then nothing is estimated
            assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
            assert got[i].near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1)
    assert got[3].fingerprint == got[4].fingerprint and got[0].fingerprint == ""


def test_fingerprints_of_few_and_no_rows(spark):
    (one,) = fingerprints.fingerprint_edits(docs(spark, ["abcdef"]), "doc_id", "text").collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1
    assert fingerprints.fingerprint_edits(docs(spark, []), "doc_id", "text").count() == 0
    same = spark.createDataFrame([(1, "aaa"), (1, "bbb"), (None, "ccc"), (5, None)], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(same, "doc_id", "text").count() == 4


def test_runs_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUNS", 3)
    for n in (100, 400):
        given = spark.createDataFrame([(i * i, f"{i:04d}" * 5) for i in range(n)], "doc_id long, text string")
        got = {r.doc_id: r.next_text for r in fingerprints.with_next(given, "doc_id", ["text"], run=4, run_bytes=200).collect()}
        assert got == {i * i: f"{(i - 1) % n:04d}" * 5 for i in range(n)}
        assert len(fingerprints.id_cuts(given, "doc_id", n * 20 // 200)) >= 0.8 * n / 10  # not the three runs that are left to few bytes


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    left, right = " ".join(words[:2000]), " ".join(words[1000:])
    df = spark.createDataFrame([("g", left), ("g", right), ("h", ""), (None, "a b")], "g string, text string").withColumn("s", fingerprints.sketch(F.col("text")))
    merged = {r.g: r.s for r in fingerprints.merge_groups(df, ["g"], "s").collect()}
    both = df.where("g = 'g'").select(F.collect_list("s").alias("s")).select(fingerprints.merge(F.col("s")[0], F.col("s")[1]).alias("m"), fingerprints.distinct_count(F.col("s")[0]).alias("n"), fingerprints.containment(F.col("s")[0], F.col("s")[1]).alias("c"), fingerprints.resemblance(F.col("s")[0], F.col("s")[1]).alias("r")).first()
    assert merged["g"] == both.m and merged["h"] == [] and len(merged[None]) == 1
    assert both.n == pytest.approx(1996, rel=0.3) and both.c == pytest.approx(0.5, abs=0.2) and both.r == pytest.approx(1 / 3, abs=0.15)
    assert rng


# 4 personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub(r"\D", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans_like_the_patterns():
    rng = random.Random(3)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 555-1234", "+12", "++49 30 1234567", " ", "-", ".", "é", "+", "12", "a@b.c@d.e", "(", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_model_adds_and_base_stays(spark):
    rng = random.Random(4)

    def number(n):
        return "".join(str(rng.randrange(10)) for _ in range(n))

    texts = []
    for i in range(600):
        texts.append(f"und the {rng.choice(['so', 'an'])} +1 ({number(3)}) 555-{number(4)} of user{i}.{number(2)}@mail{i % 9}.example.com ip {rng.randrange(9, 99)}.{rng.randrange(255)}.1.7 in")
        texts.append(f'token = "{number(3)}ab{number(9)}cd{number(12)}" version 1.2.{i} year 20{i % 30:02d} id {number(5)}')
    model = pii.fit(docs(spark, texts), "text")
    assert model.trees is not None
    cases = ["call (415) 555-1234 now", "mail bob.12 [at] mail3.example.com", 'token = "80caf00312470a19c410a04f46e97e3432b5bdae" und', "", None, texts[0]]
    got = pii.find(docs(spark, cases, True), "text", model).orderBy("doc_id").collect()
    for t, r in zip(cases, got, strict=True):
        assert [(s.kind, s.start, s.end) for s in r.pii if s.base] == plain_spans(t or "")
    assert not got[2].pii and [(s.kind, s.base) for s in got[1].pii] == [(0, False)]
    covered = [r.text for r in pii.redact(docs(spark, cases), "text", model).orderBy("doc_id").collect()]
    assert covered[3] == "" and covered[4] is None and "[PHONE]" in covered[5] and "[EMAIL]" in covered[5] and "@" not in covered[5]
    assert pii.fit(docs(spark, []), "text").trees is None and pii.fit(docs(spark, ["x 1"]), "text").trees is None


def test_pii_candidates_side_by_side():
    def proposed(text, base=()):
        return {(pii.KINDS[k], text[a:b]) for k, a, b in pii.candidates(text, base)}

    assert ("phone", "415-555-0100") in proposed("2024-01-05 415-555-0100")
    assert {("phone", "(415) 555-0100"), ("phone", "+1 415-555-0101")} <= proposed("(415) 555-0100 / +1 415-555-0101")
    assert {("phone", f"415555010{i}") for i in range(3)} <= proposed("4155550100 4155550101 4155550102")
    twice = "4465758382889437 4465758382889437"
    assert [c for c in pii.candidates(twice) if c[0] == 2] == [(2, 0, 16), (2, 17, 33)]
    text = "1.2.3.4 415-555-0100 bob [at] mail.com. x@y.de"
    base = pii.base_spans(text)
    assert [text[a:b] for _, a, b in base] == ["x@y.de", "1.2.3.4"]
    assert {("phone", "415-555-0100"), ("email", "bob [at] mail.com")} <= proposed(text, base)
    assert all(b <= s or e <= a for _, a, b in pii.candidates(text, base) for _, s, e in base)
    words = "1 2 3 " * 200
    assert len(pii.candidates(words)) <= 600 * 20 * 2


def test_pii_numbers_side_by_side_are_found(spark):
    rng = random.Random(6)

    def number(n):
        return "".join(str(rng.randrange(10)) for _ in range(n))

    def card():
        body = number(15)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    texts = [f"und {i} the +1 ({number(3)}) 555-{number(4)} so {card()} an" for i in range(600)]
    model = pii.fit(docs(spark, texts), "text")
    one = card()
    cases = [f"so {one} {one} an", "the 4155550100 4155550101 4155550102 so", "the (415) 555-0100 / (415) 555-0101 so"]
    got = [[t[a:b] for _, a, b, _ in model.spans(t)] for t in cases]
    assert got == [[one, one], ["4155550100", "4155550101", "4155550102"], ["(415) 555-0100", "(415) 555-0101"]]
    asked = pii.Model(pii.Boosted(trees=0), [0.0] * 4)
    asked.trees.cuts = [np.array([])] * len(pii.features("a", 0, 0, 1))
    assert asked.spans("BOB AT MAIL DOT COM") == [(0, 0, 19, False)]


def planted(rng, i):
    """A text with personal data in spellings that the exact rules miss: text and [(kind, start, end)]."""

    def n(k):
        return "".join(str(rng.randrange(10)) for _ in range(k))

    def card():
        body = "4" + n(14)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    mail = rng.choice(["{u} [at] {d}", "{u}(at){d}", "{u} at {e}"]).format(u=f"bob{n(2)}.x", d=f"host{i % 7}.example.com", e=f"host{i % 7} dot example dot com")
    ip = rng.choice(["[.]", "(.)", " dot "]).join(str(rng.randrange(1, 256)) for _ in range(4))
    c = card()
    cards = rng.choice([".", "/"]).join(c[k : k + 4] for k in range(0, 16, 4))
    phone = rng.choice([f"({n(3)}) 555-{n(4)}", f"1 ({n(3)}) 555-{n(4)}"])
    noise = [f"version {n(1)}.{n(2)}", f"on 20{rng.randrange(10, 30)}-0{rng.randrange(1, 10)}-1{n(1)}", f"no. {n(5)}", f"token {n(3)}ab{n(9)}cd"]
    parts = [(0, mail), (1, ip), (2, cards), (3, phone), *((None, x) for x in noise)]
    rng.shuffle(parts)
    text, spans = "the", []
    for kind, part in parts:
        text += rng.choice([" und ", " so it is ", " with the ", ", then "])
        if kind is not None:
            spans.append((kind, len(text), len(text) + len(part)))
        text += part
    return text + " end.", spans


def test_pii_of_held_out_spellings(spark):
    """Learned from exactly spelt data only; measured on other documents with planted respellings."""
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "text")
    rng = random.Random(31)
    hit, told, want = Counter(), Counter(), Counter()
    for i in range(400):
        text, spans = planted(rng, i)
        base = {s[:3] for s in model.spans(text) if s[3]}
        got = {s[:3] for s in model.spans(text) if not s[3]}
        for kind in range(4):
            own = {s for s in spans if s[0] == kind and s not in base}
            mine = {s for s in got if s[0] == kind}
            hit[kind] += len(own & mine)
            told[kind] += len(mine)
            want[kind] += len(own)
    figures = {pii.KINDS[k]: (round(hit[k] / max(told[k], 1), 3), round(hit[k] / max(want[k], 1), 3)) for k in range(4)}
    print("precision, recall:", figures)
    assert all(p >= 0.9 and r >= 0.9 for p, r in figures.values()), figures


def test_pii_is_learned_from_every_document(spark):
    """Against trees and thresholds from all examples at hand: more documents than a sample had, one with many spans."""
    rng = random.Random(8)

    def n(k):
        return "".join(str(rng.randrange(10)) for _ in range(k))

    texts = [f"id {i} is {n(7)} in" for i in range(4100)]
    texts += [f"und {n(2)} +1 ({n(3)}) 555-{n(4)} so u{n(2)}@mail.example.com" for _ in range(100)]
    texts += [" ".join(f"+1 ({n(3)}) 555-{n(4)}," for _ in range(510)), "no digits"]
    model = pii.fit(docs(spark, texts + texts[:50]), "text")
    held = {r.text: r.held for r in docs(spark, texts).selectExpr("text", "pmod(xxhash64(text), 4) = 0 as held").collect()}
    each = [(x, y, held[t]) for t in sorted(set(texts)) for x, y in pii._examples(t)]
    x, y, held = (np.array(v, float) for v in zip(*each, strict=True))
    plain = pii.Boosted().fit(x[held == 0], y[held == 0])
    p = plain.probability(x)
    assert model.trees.model == plain.model and (model.trees.probability(x) == p).all()
    for kind, least in enumerate(model.thresholds):
        of = (held == 1) & (x[:, 0] == kind)
        right = [(s, y[of & (p >= s)].mean()) for s in np.unique(p[of]) if s >= 0.5]
        if least > 1:
            assert all(share < pii.PRECISION for _, share in right) or y[of].sum() < 5
        else:
            assert y[of & (p >= least)].mean() >= pii.PRECISION
            assert all(share < pii.PRECISION for s, share in right if s < least - 1 / pii.CELLS)


def test_pii_of_odd_texts(spark):
    texts = ["1.2.3." + "0" * 5000, "1.2.3." + "0" * 5000 + "7", None, "", "1 " * 50_000, "x 4155550100 " * 2]
    model = pii.fit(docs(spark, texts * 30), "text")
    got = pii.find(docs(spark, texts).withColumn("pii", F.lit(1)), "text", model).orderBy("doc_id").collect()
    assert [len([s for s in r.pii if s.base]) for r in got] == [1, 1, 0, 0, 0, 0]
    assert pii.find(docs(spark, []), "text", model).count() == 0


# 5 token rollups


def test_rollup_batches_are_idempotent(spark, tmp_path):
    df = docs(spark, ["a b", "a b c", None, ""], True).withColumn("source", F.when(F.col("doc_id") == 3, None).otherwise(F.col("source")))
    count = {"w": F.size(F.filter(F.split("text", " "), lambda w: w != ""))}
    ledger = rollups.counted(df, "doc_id", {"w": F.coalesce(*count.values())})
    folder = f"{tmp_path}/r"
    rollups.commit(rollups.inserts(ledger), folder, "b1")
    rollups.commit(rollups.inserts(ledger), folder, "b1")
    assert {(r.source, r.n_docs, r.n_tokens) for r in rollups.totals(spark, folder).collect()} == {("s0", 2, 2), ("s1", 1, 3), (None, 1, 0)}
    before = {(r.source, r.n_docs) for r in rollups.totals(spark, folder).collect()}
    assert before == {("s0", 2), ("s1", 1), (None, 1)}
    one = ledger.where("doc_id = 1")
    for _ in range(2):
        rollups.commit(rollups.revisions(one, one.withColumn("n_tokens", F.lit(10).cast("long"))), folder, "b2")
        rollups.commit(rollups.deletes(ledger.where("doc_id = 3")), folder, "b3")
    rollups.commit(rollups.inserts(ledger.limit(0)), folder, "b4")
    got = {(r.source, r.n_docs, r.n_tokens) for r in rollups.totals(spark, folder).collect()}
    assert ("s1", 1, 10) in got and not any(s is None for s, _, _ in got)
    rollups.compact(spark, folder, f"{tmp_path}/c", "all")
    assert {(r.source, r.n_docs, r.n_tokens) for r in rollups.totals(spark, f"{tmp_path}/c").collect()} == got


def test_rollup_retries(spark, tmp_path):
    df = docs(spark, ["a b", "a b c", "x y z"])
    ledger = rollups.counted(df, "doc_id", {"w": F.size(F.split("text", " "))})
    folder, into = f"{tmp_path}/r", f"{tmp_path}/c"

    def sums(at):
        return {r.source: (r.n_docs, r.n_tokens) for r in rollups.totals(spark, at).collect()}

    rollups.commit(rollups.inserts(ledger), folder, "b1")
    rollups.commit(rollups.deletes(ledger.where("doc_id = 0")), folder, "b2")
    assert sums(folder) == {"s0": (1, 3), "s1": (1, 3)}
    rollups.commit(rollups.deletes(ledger.limit(0)), folder, "b2")  # the batch is now empty
    assert sums(folder) == {"s0": (2, 5), "s1": (1, 3)}
    rollups.commit(rollups.deletes(ledger.where("doc_id = 0")), folder, "b2")
    rollups.compact(spark, folder, into, "all")
    assert rollups.folded(spark, into) == ["b1", "b2"] and not rollups.commit(rollups.deletes(ledger.where("doc_id = 0")), into, "b2")
    assert rollups.commit(rollups.inserts(ledger.where("doc_id = 1")), into, "b4") and sums(into) == {"s0": (1, 3), "s1": (2, 6)}
    rollups.compact(spark, into, f"{tmp_path}/d", "more")
    assert rollups.folded(spark, f"{tmp_path}/d") == ["all", "b1", "b2", "b4"] and sums(f"{tmp_path}/d") == sums(into)
    with pytest.raises(ValueError, match="batch name"):
        rollups.commit(rollups.inserts(ledger), folder, "../b")


def test_rollup_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, "a@b c", "en", "s", 0), (1, "plain text", "en", "s", 0), (None, "x@y z", "en", "s", 0), (2, "plain text", "en", "s", 0), (3, "q@r", "en", "s", 0), (3, "q@r", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.tokenizer: (r.n_docs, r.n_tokens) for r in queries.op5_token_rollup(spark, str(tmp_path)).collect()}
    # the copy under id 2 goes; ids 1 and 3 (twice) lose an address each; the row without an id stays as it is
    assert got["words_v1"] == (5, 1 + 2 + 2 + 0 + 0)


def test_rollup_with_a_bpe_version(spark, tmp_path, reference):
    texts = [t or "" for t in ODD]
    ledger = rollups.counted(docs(spark, texts), "doc_id", {"byte_bpe_50k": F.size(bpe.encode(F.col("text"), RANKS, P.PATTERN))})
    rollups.commit(rollups.inserts(ledger), f"{tmp_path}/r", "b1")
    got = rollups.totals(spark, f"{tmp_path}/r").agg(F.sum("n_tokens"), F.sum("n_docs")).first()
    assert tuple(got) == (sum(len(reference.encode_ordinary(t)) for t in texts), len(texts))


# 6 SimHash


def plain_simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, bits=2):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def test_near_duplicates_by_brute_force(spark):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = ODD + rows + [t + " one more word" for t in rows[:40]]
    want = {i: plain_simhash(t or "") for i, t in enumerate(texts)}
    df = docs(spark, texts, True)
    df = df.unionByName(df.where("doc_id = 5")).unionByName(df.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    got = simhash.near_duplicates(df, "doc_id", "text").collect()
    assert len(got) == len(texts) + 2
    groups = plain_components(want)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.fingerprint % 2**64 == want[r.doc_id] and r.component_id == groups[r.doc_id]

    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def join_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("dense", [64, 2])
def test_signatures_are_not_broadcast(spark, dense):
    """Spark estimates exploded rows at the size of those before: at up to 10 MB, it broadcast 66 times as many."""
    prints = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % 2**63 if i % 3 else i, i) for i in range(400)], "fp long, node long")
    plan = join_plan(simhash.links(prints, 2, dense))
    assert "SortMergeJoin" in plan and ("Generate" in plan)
    broadcast = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "ShuffledHashJoin" in line]
    assert all("LeftAnti" in line for line in broadcast)  # crowded values: few, and not made by an explode
    found = simhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string"), "doc_id", "text")
    assert "_salt" in (plan := join_plan(found)) and "SortMergeJoin [fp" in plan


def test_near_copies_broadcast_what_is_measured(spark, monkeypatch):
    """No table of near copies is broadcast for its estimate alone, and the session's settings are as before."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before, seen, plain = [spark.conf.get(k, None) for k in keys], [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: (seen.append([spark.conf.get(k, None) for k in keys]), plain(df, name))[1])
    kept = simhash.keep_one(spark.read.parquet(f"{SF}/documents.parquet").limit(60), "doc_id", "text")
    assert seen and all([int(a), int(b)] == [256 << 10, 10 << 20] for a, b in seen)
    assert [spark.conf.get(k, None) for k in keys] == before
    assert "BroadcastHashJoin" not in join_plan(kept)


def plain_near(texts, similarity=0.8):
    """Groups of (id, text) rows by five-word Jaccard similarity: the (id, text) that stays for each."""
    sets = {}
    for _, t in texts:
        words = t.encode().lower().split()
        sets[t] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {t: t for t in sets}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    ordered = sorted(sets)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            common = len(sets[a] & sets[b])
            if common and common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    best = {}
    for i, t in texts:
        key = (i is None, i if i is not None else 0)
        best[root(t)] = min(best.get(root(t), (key, t)), (key, t))
    return {(None if k[0] else k[1], t) for k, t in best.values()}


def test_near_copies_by_similarity(spark):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(11)
    planted = []
    for t in rows[:80]:
        words = t.split(" ")
        if len(words) >= 60:
            planted += [" ".join(w if i % (len(words) // n) != 30 % (len(words) // n) else rng.choice("xyz") for i, w in enumerate(words)) for n in (1, 2)]
    texts = [t or "" for t in ODD] + rows + planted
    df = docs(spark, texts, True)
    want = plain_near(list(enumerate(texts)))
    got = {(r.doc_id, r.text or "") for r in simhash.keep_one(df, "doc_id", "text").collect()}
    extra = got - want  # copies that no fingerprint proposed
    assert len(want) < len(texts) - 60 and len(got) <= len(want) + 0.05 * len(planted) and len(extra) <= 0.05 * len(planted)
    assert simhash.keep_one(df.limit(0), "doc_id", "text").count() == 0


def test_keep_one_judges_rows_by_their_text(spark):
    a, b = ("one text " + " ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    rows = [(3, a), (5, a), (5, b), (None, b), (None, "alone"), (None, "alone"), (7, None), (8, ""), (9, b), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("k1", F.lit("x"))
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(3, a), (5, b), (None, "alone"), (7, None)], key=str)
    assert simhash.keep_one(df, "doc_id", "text").columns == df.columns


@pytest.mark.parametrize("dense", [24, 64])
def test_a_large_family_of_near_copies_is_one_group(spark, dense, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = []
    for _ in range(300):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(900)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"w{rng.randrange(900)}" for _ in range(90)) for _ in range(50)]
    found = simhash.groups_of_texts(docs(spark, texts), "doc_id", "text", dense=dense)
    got = {r["first"] for r in found.collect()}
    assert {0, *range(300, 350)} <= got and len(got) <= 51 + 3  # recall of at least 0.99


@pytest.mark.parametrize(("bits", "dense"), [(2, 10**9), (2, 2), (1, 10**9), (1, 2), (0, 2)])
def test_links_sparse_and_dense(spark, bits, dense):
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for s in seeds for _ in range(60)})
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)], "fp long, node long")
    got = {r.node: r.component for r in components.components(simhash.links(df, bits, dense)).collect()}
    want = plain_components(dict(enumerate(prints)), bits)
    assert {i: got.get(i, i) for i in want} == want


def test_long_chains_meet(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 300)] + [(1, 1)], "a long, b long")
    got = components.components(edges).collect()
    assert {r.component for r in got} == {100} and len(got) == 201


# 7 licences


def test_license_notices(spark):
    texts = [
        "Foo bar.\nLicensed under the Apache License, Version 2.0.", "x Released under the MIT License. y", "licence plate", "", None,
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3. Word " * 2,
        "This work is licensed under the GNU General Public License, version 2", "lorem " * 5000 + "Licensed under CC BY 4.0 " + "ipsum " * 5000,
    ]
    got = licenses.scan(docs(spark, texts, True), "text").orderBy("doc_id").collect()
    names = [[x.license for x in r.licenses] for r in got]
    assert names[:7] == [["Apache-2.0"], ["MIT"], [], [], [], ["CC-BY-NC-4.0"], ["GPL-3.0", "GPL-3.0"]] and names[8] == ["CC-BY-4.0"]
    assert [(x.license, x.missing) for x in got[7].licenses] == [("GPL-2.0", [])]
    one = got[0].licenses[0]
    assert texts[0][one.start : one.end] == "Licensed under the Apache License, Version 2.0" and not one.missing and not one.added
    assert licenses.scan(docs(spark, []), "text").count() == 0


def test_license_notices_beside_near_twins():
    def names(text):
        return [x["license"] for x in licenses.scan_text(text)]

    apache, mit, gpl, cc = (licenses.TEMPLATES[n] + "." for n in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"))
    assert names(f"{apache} {mit} {cc}") == ["Apache-2.0", "MIT", "CC-BY-NC-4.0"]
    assert names(f"{apache} {gpl} {cc}") == ["Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"]
    rng = random.Random(8)
    for _ in range(30):
        chosen = rng.sample(sorted(set(licenses.TEMPLATES) - {"Apache-2.0"}), 4)
        text = "\n".join(f"{' '.join(rng.choices('the of a lorem ipsum file and'.split(), k=rng.randrange(20)))} xx\n{licenses.TEMPLATES[n]}." for n in chosen)
        assert names(text) == chosen


def test_license_versions_must_be_exact():
    def names(text):
        return [x["license"] for x in licenses.scan_text(text)]

    assert names("Licensed under the Apache License, Version 1.1") == names("Licensed under CC BY 3.0") == []
    assert names("This work is licensed under the GNU General Public License, version 4") == []
    assert names("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1") == []
    assert names(licenses.TEMPLATES["GPL-3.0 header"].replace("version 3", "version 4")) == []
    wrapped = "\n".join(f" * {x}" for x in textwrap.wrap(licenses.TEMPLATES["MIT licence"], 72))
    assert names(f"/*\n{wrapped}.\n */\nint main() {{}}\n") == ["MIT licence"]


def test_licenses_by_brute_force():
    """Every template against every offset of the text, without cues, blocks or savings."""

    def plain(words):
        found = set()
        for name, text in licenses.TEMPLATES.items():
            wording = [w.lower() for w in re.findall(r"[^\W_]+(?:\.[0-9]+)*", text)]
            for i in range(len(words)):
                if words[i : i + len(wording)] == wording:
                    found.add((i, len(wording), name))
        # the longest of overlapping ones stands
        out = []
        for i, n, name in sorted(found, key=lambda x: (-x[1], x[0])):
            if all(i + n <= j or j + m <= i for j, m, _ in out):
                out.append((i, n, name))
        return sorted((i, name) for i, _, name in out)

    rng = random.Random(21)
    filler = "the of and license software permission is under version copyright 2 3.0 redistribution lorem ipsum".split()
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choices(filler, k=rng.randrange(25)) + ["qq"] + licenses.TEMPLATES[rng.choice(sorted(licenses.TEMPLATES))].split() + ["qq"]
        words = [w.lower() for w in re.findall(r"[^\W_]+(?:\.[0-9]+)*", " ".join(parts))]
        text = " ".join(words[i] + ("\n" if rng.random() < 0.1 else "") for i in range(len(words)))
        starts = [m.start() for m in re.finditer(r"\S+", text)]
        got = sorted((starts.index(x["start"]), x["license"]) for x in licenses.scan_text(text) if not x["missing"] and not x["added"])
        assert got == plain(words)


@pytest.mark.parametrize("name", [n for n, t in licenses.TEMPLATES.items() if len(t) > 60])
@pytest.mark.parametrize(("mark", "width"), [("", 72), ("# ", 72), (" * ", 40)])
def test_license_notices_over_lines(name, mark, width):
    lines = textwrap.wrap(licenses.TEMPLATES[name] + ".", width - len(mark))
    text = "This is the file of a program.\n" + "\n".join(mark + line for line in lines) + "\n\n" + "It is the end.\n" * 30
    got = licenses.scan_text(text)
    assert [(x["license"], x["missing"], x["added"]) for x in got] == [(name, [], [])]
    assert " ".join(text[got[0]["start"] : got[0]["end"]].split()).startswith(licenses.TEMPLATES[name][:25])


# 8 Katz


def plain_katz(texts, train, order=2):
    tokens = {i: [*(t or "").encode().lower().split(), "END"] for i, t in texts.items()}
    grams = {n: Counter() for n in range(1, order + 1)}
    padded = {i: ["END"] * (order - 1) + ws for i, ws in tokens.items()}
    for i, ws in padded.items():
        if train(i):
            for n in grams:
                grams[n].update(tuple(ws[k - n + 1 : k + 1]) for k in range(order - 1, len(ws)))
    uni = Counter({g[0]: c for g, c in grams[1].items()})
    n, v = sum(uni.values()), len(uni)
    d = {m: katz.discounts([0] + [sum(c == r for c in grams[m].values()) for r in range(1, 7)]) for m in grams}

    def less(c, m):
        return c * d[m][c] if c <= 5 else c

    kept = sum(less(c, 1) for c in uni.values())
    scale = 1.0 if kept < n - 1e-9 else n / (n + 1)
    pu = {w: scale * less(c, 1) / n for w, c in uni.items()}
    unk = 1 - sum(pu.values())
    after = {m: defaultdict(list) for m in grams}
    for m in grams:
        for g, c in grams[m].items():
            after[m][g[:-1]].append((g[-1], c))

    @functools.cache
    def context(h):
        seen, m = after[len(h) + 1][h], len(h) + 1
        total = sum(c for _, c in seen)
        s = 1.0 if any(x <= 5 for _, x in seen) else total / (total + 1)
        alpha = (1 - s * sum(less(x, m) for _, x in seen) / total) / (1 - sum(p(h[1:], x) for x, _ in seen))
        return total, s, alpha

    def p(h, w):
        if not h:
            return pu.get(w, unk)
        if h not in after[len(h) + 1]:
            return p(h[1:], w)
        total, s, alpha = context(h)
        c = grams[len(h) + 1].get((*h, w), 0)
        return s * less(c, len(h) + 1) / total if c else alpha * p(h[1:], w)

    out = {}
    for i, ws in tokens.items():
        base = sum(math.log10((uni.get(w, 0) + 1) / (n + v + 1)) for w in ws)
        out[i] = (len(ws), sum(w in uni for w in ws), n, base, sum(math.log10(p(tuple(padded[i][k : k + order - 1]), w)) for k, w in enumerate(ws)))
    return out, p, uni, after[order]


def in_train():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2


@pytest.fixture
def katz_texts(spark):
    return dict(enumerate(ODD + ["the cat sat on the mat " * 9, "the dog sat", "\x00 end END"] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]))


@pytest.mark.parametrize(("order", "size"), [(2, (2_000_000, 1_000_000)), (2, (700, 500)), (3, (2_000_000, 1_000_000)), (3, (900, 400)), (1, (900, 400))])
def test_katz_by_brute_force(spark, monkeypatch, katz_texts, order, size):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", size[0])
    monkeypatch.setattr(katz, "PART_TOKENS", size[1])
    monkeypatch.setattr(katz, "MESSAGE", 1)
    want, p, uni, after = plain_katz(katz_texts, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, order)
    got = katz.score(docs(spark, list(katz_texts.values()), True), "doc_id", "text", in_train(), order).collect()
    assert len(got) == len(katz_texts)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9) and r.score == pytest.approx(want[r.doc_id][4], rel=1e-9, abs=1e-9)
    for h in list(after)[:20]:  # each context's probabilities sum to one
        assert sum(p(h, w) for w in uni) + p(h, "never seen") == pytest.approx(1, abs=1e-9)
    assert not [t.name for t in spark.catalog.listTables() if "katz" in t.name]


@pytest.mark.parametrize(("order", "part"), [(2, 1_000_000), (3, 400)])
def test_katz_tables_score_other_texts(spark, monkeypatch, katz_texts, order, part):
    monkeypatch.setattr(katz, "PART_TOKENS", part)
    monkeypatch.setattr(katz, "MESSAGE", 1)
    own = {i: t for i, t in katz_texts.items() if i % 3}
    model = katz.fit(docs(spark, list(katz_texts.values())).where("doc_id % 3 <> 0"), "doc_id", "text", F.lit(True), order)
    want, p, uni, after = plain_katz(katz_texts, lambda i: i in own, order)
    got = katz.score_texts(model, docs(spark, list(katz_texts.values()), True), "doc_id", "text").collect()
    assert len(got) == len(katz_texts)
    for r in got:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.score == pytest.approx(want[r.doc_id][4], rel=1e-9, abs=1e-9)
    # the stored tables: n-grams with their counts, and every context's probabilities sum to one
    hashes = {xxhash.xxh64_intdigest(" " if w == "END" else w, 42): w for w in uni}
    word = {r.id: hashes[r.hash % 2**64] for r in model.words().where("count > 0").collect()}
    assert {w: r for w, r in uni.items()} == {word[r.id]: r["count"] for r in model.words().where("count > 0").collect()}
    grams = {tuple(word[r[k]] for k in range(order)): r["count"] for r in model.grams(order).collect()}
    assert grams == {(*h, w): c for h, seen in after.items() for w, c in seen}
    for r in model.contexts(order).limit(30).collect():
        h = tuple(word[r[k]] for k in range(order - 1))
        below = {w: p(h[1:], w) for w in [*uni, "never seen"]}
        d = model.d[order]
        seen = {w: r.scale * c * (d[c] if c <= 5 else 1) / r.total for w, c in after[h]}
        assert sum(seen.get(w, r.backoff * q) for w, q in below.items()) == pytest.approx(1, abs=1e-9)


def test_katz_messages_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 50)
    monkeypatch.setattr(katz, "PART_TOKENS", 50)
    monkeypatch.setattr(katz, "MESSAGE", 10)
    rng = random.Random(5)
    told = {}
    for n in (200, 800):
        given = docs(spark, [" ".join(f"w{rng.randrange(500)}" for _ in range(24)) for _ in range(n)]).coalesce(1)
        _, table, answers, plan = katz._fit(given, "doc_id", "text", F.lit(True), 2)
        told[n] = answers.where("chunk != '' and n = 2").count()
        assert told[n] <= 25 * n / 10 * 1.5 + table.count() + plan.parts[2] and plan.parts[2] > 3
    assert told[800] <= 5 * told[200]  # four times the corpus; chunks times partitions of a fixed size were sixteen times


def test_katz_tables_have_small_row_groups(spark, monkeypatch):
    """A reader holds a whole row group of long arrays: a file was one, whatever its task had written."""
    import pyarrow.parquet as pq

    for name, value in (("CHUNK_TOKENS", 2000), ("PART_TOKENS", 500), ("GROUP_BYTES", 1 << 14)):
        monkeypatch.setattr(katz, name, value, raising=False)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(100))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    model, table, _, _ = katz._fit(df, "doc_id", "text", F.lit(True), 2)
    for written in (table, *model.tables.values()):
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written.inputFiles()]
        groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
        assert len(groups) > len(files)
        assert all(g.num_rows == 1 or g.total_byte_size < 4 << 14 for g in groups)


def test_katz_without_training_or_rows(spark):
    rows = katz.score(docs(spark, ["a b", None]), "doc_id", "text", F.lit(False)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)}
    assert katz.score(docs(spark, []), "doc_id", "text", F.lit(True)).count() == 0


# 9 toxicity


def test_segments_are_the_maximal_ones():
    def plain(scores):  # the best segment, then the same left and right of it
        best, n = None, len(scores)
        for a in range(n):
            total = 0.0
            for b in range(a, n):
                total += scores[b]
                if total > 0 and (best is None or total > best[2] + 1e-9):
                    best = (a, b, total)
        if best is None:
            return []
        a, b, _ = best
        return plain(scores[:a]) + [best] + [(x + b + 1, y + b + 1, s) for x, y, s in plain(scores[b + 1 :])]

    rng = random.Random(7)
    for _ in range(400):
        scores = [rng.uniform(-3, 3) for _ in range(rng.randrange(1, 25))]
        drops = np.concatenate([[0.0], np.cumsum(scores)])
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], drops)
        assert sum(s for _, _, s in got) == pytest.approx(sum(s for _, _, s in plain(scores)), abs=1e-6)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain(scores)]


def test_toxic_passages(spark):
    rng = random.Random(8)
    plain = [f"w{i}" for i in range(60)]
    bad = ["loser", "idiotic", "idiots", "moronisch"]
    rows, marks = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        toxic = i % 8 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    given = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(None, 1, 1), (77, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(given, labels, toxicity.in_training())
    cases = ["", None, "w1 w2 w3", "w1 " * 30 + "loser idiots loser idiotic" + " w2" * 30, "W5 " * 20000]
    got = [r.toxicity for r in toxicity.judge(docs(spark, cases, True), model, "text").orderBy("doc_id").collect()]
    assert [g.score >= 0.5 for g in got] == [False, False, False, True, False]
    (s,) = got[3].segments
    assert cases[3][s.start : s.end] == "loser idiots loser idiotic" and not got[0].segments
    judged = toxicity.judge(given, model, "text").join(labels, "doc_id").where(~toxicity.in_training())
    assert judged.where((F.col("toxicity.score") >= 0.5) != (F.col("toxic") == 1)).count() == 0
    empty = toxicity.fit(given, labels.limit(0))
    assert empty.judge("loser loser")[0] < 0.5


# 10 decontamination


def plain_hits(text, items, size=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hit, found = set(), set()
    for item, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        if not own:
            continue
        k = min(size, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_windows", [10**6, 200])
def test_decontamination_by_brute_force(spark, block_windows):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.choice([2, 5, 13, 20, 30])))) for i in range(30)] + [(100, None), (101, "!!"), (2, "x Y z")]
    texts = [t or "" for t in ODD]
    for _ in range(120):
        words = [rng.choice("abcdefg") for _ in range(rng.randrange(60))]
        item = (rng.choice(items)[1] or "").split()
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at]) + ", " + "-".join(item[rng.randrange(len(item) + 1) if item else 0 :]).upper() + "\n" + " ".join(words[at:]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, texts, True)
    judged = decontam.scan(df, bench, "text", "item_id", "text", block_windows=block_windows)
    dirty = set()
    for r in judged.collect():
        n, hit, found = plain_hits(texts[r.doc_id], items)
        assert (r.contamination.n_words, r.contamination.n_hit, r.contamination["items"]) == (n, hit, found), r.doc_id
        dirty |= {r.doc_id} if hit and 20 * hit >= n else set()
    again = decontam.scan(df.withColumn("contamination", F.lit(1)), bench.unionByName(bench), "text", "item_id", "text")
    assert sorted(map(str, again.collect())) == sorted(map(str, judged.select(again.columns).collect()))
    left = decontam.remove_documents(df, bench, "text", "item_id", "text")
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - dirty and left.columns == df.columns
    assert decontam.scan(df.limit(0), bench, "text", "item_id", "text").count() == 0
    assert decontam.scan(df, bench.limit(0), "text", "item_id", "text").where("contamination.n_hit > 0").count() == 0


@pytest.mark.parametrize("block_windows", [10**6, 3])
def test_decontamination_cuts_spans(spark, block_windows):
    item = " ".join(f"q{i}" for i in range(15))
    texts = [f"Keep this. {item.upper()}! And that {item}", "nothing", None]
    rest = " ".join(f"q{i}" for i in range(1, 15))
    bench = spark.createDataFrame([(1, item), (2, rest)], "item_id long, text string")
    got = [r.text for r in decontam.remove_spans(docs(spark, texts), bench, "text", "item_id", "text", block_windows=block_windows).orderBy("doc_id").collect()]
    assert got == ["Keep this. ! And that ", "nothing", None]


# Compression decides, long texts, samples, hot windows


def test_license_notices_come_through_compression(monkeypatch):
    """Planted notices with as many changed words as are tolerated: what the exact comparison would confirm wins by its
    saving; with noise for a ranking hardly any does."""
    rng = random.Random(3)
    filler = "the of a lorem ipsum file and code data value which returns with some text about things in this module".split()
    known = licenses._of(None)
    planted = []
    for _ in range(8):
        for name, wording in licenses.TEMPLATES.items():
            words = wording.split()
            for i in rng.sample([i for i, w in enumerate(words) if not re.search("[0-9]", w)], int(rng.choice([0, 0.05, 0.1]) * len(words))):
                words[i] = rng.choice(filler)
            text = " ".join(rng.choices(filler, k=rng.randrange(90)) + words + rng.choices(filler, k=rng.randrange(90)))
            if any(True for _ in licenses.confirm(text, known.words[name])):
                planted.append((name, text))
    won = [dict(known.winners(text)) for _, text in planted]
    assert sum(name in w for (name, _), w in zip(planted, won, strict=True)) >= 0.99 * len(planted)
    assert sum(map(len, won)) < 4.5 * len(won)  # of eighteen templates
    assert sum(bool(known.winners(" ".join(rng.choices(filler, k=150)))) for _ in range(40)) <= 4
    found = [sum(any(x["license"] == name for x in licenses.scan_text(text)) for name, text in planted)]
    noise = random.Random(1)
    monkeypatch.setattr(licenses.Templates, "ranked", lambda self, window: [(name, noise.randrange(40), 30) for name in self.own])
    found.append(sum(any(x["license"] == name for x in licenses.scan_text(text)) for name, text in planted))
    assert found[0] >= 0.7 * len(planted) and found[1] < 0.6 * found[0]


def test_whole_licences_as_templates():
    folder = Path("/usr/share/common-licenses")
    names = [n for n in ("Apache-2.0", "MPL-2.0", "GPL-3") if (folder / n).exists()]
    if not names:
        pytest.skip("no licence texts on this machine")
    texts = {f"{n} whole": (folder / n).read_text() for n in names}
    for n in names:
        text = "words before\n" + texts[f"{n} whole"].replace("Copyright", "copyright", 1) + "\nwords after"
        found = licenses.scan_text(text, texts)
        assert [x["license"] for x in found] == [f"{n} whole"] and found[0]["end"] - found[0]["start"] > 0.95 * len(text)


def test_very_long_texts_of_licences_and_numbers():
    unit = " ".join(["filler"] * 400) + " " + licenses.TEMPLATES["GPL-3.0 header"] + " "
    began = time.time()
    assert len(licenses.scan_text(unit * 300)) == 300 and time.time() - began < 60
    rng = np.random.default_rng(0)
    x = rng.random((2000, 30))
    model = pii.Model(pii.Boosted().fit(x, (x[:, 0] > 0.5).astype(float)), [0.3] * 4)
    r = random.Random(2)
    text = " ".join(r.choice([f"u{r.randrange(10**6)}@mail.example.com", f"{r.randrange(10**9, 10**10)}", f"{r.randrange(256)}.{r.randrange(256)}.7.9"]) for _ in range(60_000))
    began = time.time()
    spans = model.spans(text)
    assert len(text) > 900_000 and time.time() - began < 40 and len(spans) > 30_000
    taken = sorted((a, b) for _, a, b, base in spans if not base)
    assert all(b <= c for (_, b), (c, _) in zip(taken, taken[1:], strict=False))


def test_covered_places_by_brute_force():
    r = random.Random(6)
    for _ in range(200):
        start = [(a, a + r.randrange(1, 5)) for a in (r.randrange(40) for _ in range(r.randrange(5)))]
        covered, plain = pii.Covered(start), list(start)
        for _ in range(20):
            a = r.randrange(45)
            b = a + r.randrange(1, 6)
            free = not any(a < e and s < b for s, e in plain)
            assert covered.free(a, b) == free
            if free:
                covered.add(a, b)
                plain.append((a, b))


def test_labels_of_other_documents_leave_the_sample_alone(spark):
    pages = spark.range(2000).selectExpr("id as page_id", "if(id % 10 = 0, concat('http://a.example/casino/', id), concat('http://b.example/news/', id)) as url")
    few = spark.range(2000).selectExpr("id as doc_id", "if(id % 10 = 0, 1, 0) as block")
    many = few.unionByName(spark.range(10_000, 2_010_000).selectExpr("id as doc_id", "0 as block"))
    rules = [urls.mine(pages, "page_id", "url", labels, fit_pages=1000) for labels in (few, many)]
    assert rules[0] and rules[0] == rules[1] and all(sure > 0.9 for _, sure in rules[0])


def test_a_window_of_very_many_items_is_dealt_out(spark):
    shared = " ".join(f"word{i}" for i in range(13))
    bench = spark.range(3000).selectExpr("concat('i', id) as item_id", f"'{shared}' as text").unionByName(spark.createDataFrame([(None, shared)], "item_id string, text string"))
    found = decontam.windows(bench, "item_id", "text", 13)
    assert found.count() == 3001
    got = decontam.scan(spark.createDataFrame([(1, f"a {shared} b"), (2, "nothing here")], "doc_id long, text string"), bench, "text", "item_id", "text", block_windows=500)
    one, two = got.orderBy("doc_id").collect()
    assert one.contamination["items"] == sorted(f"i{i}" for i in range(3000)) and one.contamination["n_hit"] == 13 and two.contamination["n_hit"] == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_by_joins_gives_the_same(spark, monkeypatch, katz_texts, order):
    """Beyond the size up to which documents travel as chunks, the same counts and scores come from plain joins."""
    df = docs(spark, list(katz_texts.values()), True)
    df = df.unionByName(df.where("doc_id = 3")).unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    told = []
    for limit in (10**12, -1):
        monkeypatch.setattr(katz, "JOINED_TOKENS", limit)
        told.append(sorted(map(tuple, katz.score(df, "doc_id", "text", in_train(), order).select(*columns).collect()), key=str))
    assert len(told[0]) == len(told[1]) == len(katz_texts) + 2
    for a, b in zip(*told, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)
    assert katz.score(df.limit(0), "doc_id", "text", in_train(), order).count() == 0


def test_katz_refuses_ids_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(katz, "PART_TOKENS", 1)
    asked = spark.createDataFrame([("c", 2**31 - 2, [1, 2, 3], [1, 1, 1])], "chunk string, bucket int, hashes array<long>, seen array<int>")
    for name, kind in (f.split() for f in katz.ASKED.split(", ")):
        asked = asked if name in asked.columns else asked.withColumn(name, F.lit(None).cast(kind))
    with pytest.raises(Exception, match="31-bit ids"):
        katz.answer_words(asked.select(*[f.split()[0] for f in katz.ASKED.split(", ")]), katz.Plan({1: 2**30})).collect()
