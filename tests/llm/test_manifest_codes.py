"""Word BPE, Merkle manifests, vector codes and crowds of near copies, against libraries, SQL and brute force."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.test_llm import plain_near
from trackstream.llm import merkle, queries, simhash, vectorcodes, wordbpe

WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def plain_oracle(name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(con.sql(queries.oracle_sql()[name]).fetchall(), key=str)


# word BPE


def test_word_bpe_of_many_texts(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeinrst ") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("aeé'sİΣσß日本1٣ ½<|>́‍\n\x1c\x85!?🙂") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += ["<|startoftext|>Hello<|endoftext|> x <|endoftext|><|startoftext|", "a" * 5000, "lo" * 1500, "xyz" * 90, "", " ", "ÇA Café", "ΑΣ ΑΣ.", "it's we'll 12345"]
    vocab = wordbpe.vocabulary(WORDS)
    got = wordbpe.Encoder(vocab).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert vocab.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_compatible_pairs_by_exact_merging():
    """Two tokens stay two exactly if merging their symbols gives them back."""
    vocab, rng = wordbpe.vocabulary(WORDS), random.Random(2)
    symbols = {}

    def of(t):
        if t not in symbols:
            symbols[t] = [t] if vocab.rank[t] < 0 else of(int(vocab.left[t])) + of(int(vocab.right[t]))
        return symbols[t]

    whole = vocab.token_at[vocab.token_at >= 0].tolist()
    pairs = [(rng.choice(whole[:6000]), rng.choice(whole[:6000])) for _ in range(3000)]
    pairs += [(int(vocab.left[t]), int(vocab.right[t])) for t in rng.sample([t for t in whole if vocab.rank[t] >= 0], 500)]
    pairs = [(a, b) for a, b in pairs if a not in set(vocab.last.tolist()) and not vocab.tokens[a].endswith("</w>")]
    told = vocab.compatible(*(np.array(x) for x in zip(*pairs, strict=True)))
    for (a, b), fits in zip(pairs, told.tolist(), strict=True):
        assert fits == (vocab.merge(of(a) + of(b)).tolist() == [a, b])
    assert 0 < told.sum() < len(pairs)


def test_word_bpe_only_merges_words_that_fail(monkeypatch):
    vocab = wordbpe.WordVocabulary(WORDS)
    seen = []
    exact = wordbpe.WordVocabulary._merge_matrix
    monkeypatch.setattr(wordbpe.WordVocabulary, "_merge_matrix", lambda self, ids, sizes: (seen.append(len(ids)), exact(self, ids, sizes))[1])
    words = [w.encode() for w in ("hello", "world", "the", "streaming", "tokenization", "qzxv", "unbelievable")]
    vocab.encode_pieces(words)
    assert sum(seen) < len(words)


def test_word_bpe_of_rows(spark, library):
    rows = [(1, "Hello, WORLD it's", "x"), (1, "Hello, WORLD it's", "x"), (2, None, "y"), (None, "", "z"), (3, "word " * 30_000, None), (4, "é" * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("decoded", F.lit(1))
    got = {r.doc_id: r for r in wordbpe.digests(df, "doc_id", "text", WORDS).collect()}
    assert wordbpe.digests(df, "doc_id", "text", WORDS).count() == 6 and wordbpe.digests(df.limit(0), "doc_id", "text", WORDS).count() == 0
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[key]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# Merkle manifest


def digest(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_tree(leaves):
    witness, level = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for k in range(0, len(level), 3):
            run = level[k : k + 3]
            for j, (_, own) in enumerate(run):
                for i in own:
                    witness[i].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            above.append((digest(*[d for d, _ in run]), [i for _, own in run for i in own]))
        level = above
    return level[0][0], witness


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100])
def test_a_tree_grows_leaf_by_leaf(n):
    leaves = [digest(str(i)) for i in range(n)]
    tree = merkle.Tree()
    for x in leaves:
        tree.append(x)
    assert tree.finish() == plain_tree(leaves)[0] and tree.witness == plain_tree(leaves)[1]


def plain_manifest(groups):
    """{(group, leaf): (subroot, root, witness)} of lists of leaves by group key."""
    names = sorted(groups, key=str.encode)
    below = {g: plain_tree(groups[g]) for g in names}
    root, above = plain_tree([below[g][0] for g in names])
    return {(g, leaf): (below[g][0], root, w + above[k]) for k, g in enumerate(names) for leaf, w in zip(groups[g], below[g][1], strict=True)}


@pytest.mark.parametrize("levels", [1, 2])
def test_appended_batches_give_the_witnesses_of_the_whole(spark, monkeypatch, levels):
    """Blocks of 3 or 9 leaves, so several levels of blocks; four batches, of which some leave groups alone."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rng = random.Random(levels)
    groups, state, at = {}, None, 0
    for batch in ({"1a": 10, "1b": 1}, {"1a": 17, "0": 3}, {"1b": 2}, {"1a": 1, "1b": 30, "1c": 9}):
        rows = []
        for g, n in batch.items():
            for _ in range(n):
                at += 1
                rows.append((g, at, digest(str(at))))
                groups.setdefault(g, []).append(digest(str(at)))
        rng.shuffle(rows)
        leaves = spark.createDataFrame(rows, "grp string, id long, digest string").withColumn("row", F.struct("id"))
        state = merkle.append(leaves, state)
        want = plain_manifest(groups)
        group_of = {x: g for g, xs in groups.items() for x in xs}
        got = merkle.witnesses(spark, state)
        got = got.select("leaf", "subroot", "root", "witness", merkle.fold(F.col("leaf"), F.col("witness")).alias("folded")).collect()
        assert len(got) == len(want)
        for r in got:
            subroot, root, witness = want[group_of[r.leaf], r.leaf]
            assert (r.subroot, r.root, [tuple(s) for s in r.witness], r.folded) == (subroot, root, witness, root)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (2, "s", "en", 3, "a\nb"), (1, "s", None, 0, ""), (1, "s", None, 0, ""), (3, "", "en", 1, "é" * 5000), (5, "t", "x", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("grp", F.lit(1)).withColumn("digest", F.lit("x"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    told = {r: digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r]) for r in rows}
    groups = {}
    for doc_id, source, lang, n, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        groups.setdefault("0" if source is None else "1" + source, []).append(told[doc_id, source, lang, n, text])
    want = plain_manifest(groups)
    got = merkle.manifest(df.select(*fields, "grp", "digest"), "doc_id", "source", fields).collect()
    assert len(got) == 7
    for r in got:
        options = [w for (_, leaf), w in want.items() if leaf == r.leaf]
        assert (r.subroot, r.root) == options[0][:2]
    tamper = df.withColumn("text", F.when(F.col("doc_id") == 2, "ab").otherwise(F.col("text")))
    bad = merkle.manifest(tamper, "doc_id", "source", fields).first()
    assert bad.root != got[0].root
    assert merkle.manifest(df.limit(0), "doc_id", "source", fields).count() == 0


def test_manifest_query_equals_sql(spark):
    got = sorted(map(tuple, queries.op12_merkle(spark, SF).collect()), key=str)
    assert got == plain_oracle("op12_merkle")


# vector codes


def plain_kmeans(vectors, rounds=6, entries=16):
    """(codes, errors, books) by all distances in exact integers; vectors in order of id."""
    parts = [[v[p * len(v) // 8 : (p + 1) * len(v) // 8] for v in vectors] for p in range(8)]
    books = [[list(x) for x in ps[:entries]] for ps in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, ps in enumerate(parts):
            own = [nearest(x, books[p])[1] for x in ps]
            for k in range(len(books[p])):
                mine = [x for x, o in zip(ps, own, strict=True) if o == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[nearest(x, books[p]) for x in ps] for p, ps in enumerate(parts)]
    return ["".join(f"{f[i][1]:02x}" for f in found) for i in range(len(vectors))], [sum(f[i][0] for f in found) for i in range(len(vectors))], books


@pytest.mark.parametrize("rewrite", [0.0, 0.25, 2.0])
def test_vector_codes_by_brute_force(spark, rewrite):
    """Clustered and tied vectors; the table written anew every round, sometimes, or never."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 16))
    values = np.concatenate([centres[rng.integers(9, size=150)] + rng.normal(scale=0.05, size=(150, 16)), rng.integers(-2, 3, size=(60, 16)) / 4096, np.tile(centres[:1], (8, 1))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], "id long, v array<float>").repartition(3)
    whole = [[int(np.floor(np.float64(x) * 4096)) for x in v] for v in values]
    codes, errors, books = plain_kmeans(whole)
    table, found, told = vectorcodes.fit(df, "id", "v", rewrite=rewrite)
    assert [b.entries.tolist() for b in found] == books
    got = {r.id: (r.code, r.error) for r in vectorcodes.encode(table, found).collect()}
    assert got == {i: (c, e) for i, (c, e) in enumerate(zip(codes, errors, strict=True))}
    if rewrite == 0.25:
        assert min(t["distances"] for t in told[1:]) < 12  # of 16: the balls rule some out


def test_vector_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[float(i + j) / 7 for j in range(8)] for i in range(5)]
    rows = [(3, good[0], 1), (3, good[1], None), (None, good[2], None), (1, good[3], 2), (9, good[4], 2), (4, None, 1), (5, [nan] * 8, 1), (6, [inf] + [0.0] * 7, 1), (7, [None] + [0.0] * 7, 1), (1, good[3], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit(1)).withColumn("n", F.lit(2))
    got = vectorcodes.compress(df, "vec_id", "embedding", "label").collect()
    assert sorted((r.vec_id for r in got), key=str) == sorted([3, 3, None, 1, 9, 1], key=str)
    order = sorted(((i, v) for i, v, _ in rows if v in good), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    codes, errors, _ = plain_kmeans([[int(np.floor(np.float64(np.float32(x)) * 4096)) for x in v] for _, v in order])
    assert sorted((r.code, r.error) for r in got) == sorted(zip(codes, errors, strict=True))
    sums = {}
    label_of = {(i, tuple(v)): lab for i, v, lab in rows if v in good}
    for (i, v), e in zip(order, errors, strict=True):
        sums[label_of[i, tuple(v)]] = sums.get(label_of[i, tuple(v)], 0) + e
    assert {r.label_error for r in got} == set(sums.values())
    assert vectorcodes.compress(df.limit(0), "vec_id", "embedding", "label").count() == 0
    assert vectorcodes.compress(df.where("vec_id = 4"), "vec_id", "embedding", "label").count() == 0
    with pytest.raises(Exception, match="equal numbers"):
        vectorcodes.compress(df.unionByName(spark.createDataFrame([(8, [1.0] * 16, 1)], "vec_id long, embedding array<float>, label int"), allowMissingColumns=True), "vec_id", "embedding", "label").collect()


def test_vector_query_equals_sql(spark):
    got = sorted(map(tuple, queries.op11_vector_codes(spark, SF).collect()), key=str)
    assert got == plain_oracle("op11_vector_codes")


# crowds of near copies


def kept(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["first"] for r in simhash.groups_of_texts(df, "doc_id", "text", **options).collect()}


def test_permutations_of_one_bag_keep_their_own_copies(spark):
    """Texts of the same words in other orders are no near copies; each has one that swaps its last two words."""
    rng, bag, texts = random.Random(5), [f"w{i}" for i in range(60)], []
    for _ in range(300):
        rng.shuffle(bag)
        texts += [" ".join(bag), " ".join([*bag[:-2], bag[-1], bag[-2]])]
    assert kept(spark, texts) == set(range(0, 600, 2))


def test_crowds_that_share_a_template_keep_their_links(spark, monkeypatch):
    """Three quarters of each text are alike, too few for a link; every third has a true near copy. All ways of crowds."""
    rng, template, texts = random.Random(6), [f"t{i}" for i in range(150)], []
    for k in range(150):
        own = [f"v{rng.randrange(10**6)}" for _ in range(50)]
        texts.append(" ".join(template + own))
        if k % 3 == 0:
            texts.append(" ".join(template + own[:-3] + ["x", "y", "z"]))
    want = {i for i, _ in plain_near(list(enumerate(texts)))}
    assert kept(spark, texts, dense=4) == want
    monkeypatch.setattr(simhash, "FEW", 3)
    monkeypatch.setattr(simhash, "BLOCK", (8, 16))
    assert kept(spark, texts, dense=4) == want


def test_rarest_shingles_find_every_pair(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(3, 30))) for _ in range(25)]
    texts = sorted({" ".join(w if rng.random() > 0.04 else "zz" for w in b.split()) for b in base for _ in range(6)})
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    nodes = spark.createDataFrame([(i, len(s), t) for i, (t, s) in enumerate(zip(texts, sets, strict=True))], "node long, weight int, text string")
    keys = {}
    for r in simhash.prefix_keys(nodes, 0.8, 5).collect():
        keys.setdefault(r.key, set()).add(r.node)
    assert want and all(any({i, j} <= k for k in keys.values()) for i, j in want)
    assert sum(map(len, keys.values())) < 0.7 * sum(map(len, sets))


def test_planted_short_edits_are_found(spark):
    rng, texts = random.Random(9), []
    for words in (40, 60, 100, 200):
        for _ in range(60):
            text = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(words)]
            copy = list(text)
            for _ in range(1 if words < 60 else 2):
                copy[rng.choice([1, 2, len(copy) - 2, rng.randrange(len(copy))])] = "edited"
            texts += [" ".join(text), " ".join(copy)]
    want = {i for i, _ in plain_near(list(enumerate(texts)))}
    got = kept(spark, texts)
    assert want <= got and len(got - want) <= 0.02 * (len(texts) - len(want)) and len(texts) - len(want) > 150
